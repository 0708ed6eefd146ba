"""Ordered operators over frames and intervals: shots, runs, gaps, merges, samples.

What depends only on neighbours is a window expression.  What depends on the rows kept before is an aggregate over the ordered
array of one video's (or shot's) rows, whose size a single video bounds, or a pandas function over that group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import let

# Defaults that change results.
MIN_SHOT, MAX_GAP, RADIUS, STEP, GUARD, DEDUP_BITS, DEDUP_WINDOW = 500, 5000, 600, 200, 250, 8, 15000
VAD_MAX, VAD_OVERLAP, VAD_GAP = 30000, 1000, 300


def grouped_fold(rows: DataFrame, keys: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """fold(list of row dicts in order) -> list of row dicts, for each group of keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.sort_values(order, kind="stable").to_dict("records")
        out = fold([{k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in records])
        return pd.DataFrame(out, columns=names) if out else pd.DataFrame({n: pd.Series(dtype="object") for n in names})

    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return rows.groupBy(*keys).applyInPandas(run, schema)


# ---------------------------------------------------------------- shots


def shots_from_starts(starts: DataFrame) -> DataFrame:
    """starts (video_id, start_frame_id, confidence, last_frame_id) as inclusive shots, with the confidence of the boundary
    that ends each, and ids by position."""
    w = Window.partitionBy("video_id").orderBy("start_frame_id")
    out = starts.withColumns({"end_frame_id": F.coalesce(F.lead("start_frame_id").over(w) - 1, F.col("last_frame_id")), "ends_with": F.lead("confidence").over(w), "n": F.row_number().over(w) - 1})
    return out.select("video_id", F.concat(F.col("video_id").cast("string"), F.lit(":shot:"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("shot_id"), "start_frame_id", "end_frame_id", F.col("ends_with").alias("confidence"))


def suppress_boundaries(boundaries: DataFrame, least: int = MIN_SHOT) -> DataFrame:
    """boundaries (video_id, timestamp_ms, confidence): one nearer than least to the last kept replaces it if surer, else goes."""

    def fold(rows):
        kept = []
        for r in rows:
            if kept and r["timestamp_ms"] - kept[-1]["timestamp_ms"] < least:
                if (r["confidence"] or 0.0) > (kept[-1]["confidence"] or 0.0):
                    kept[-1] = r
            else:
                kept.append(r)
        return kept

    kind = boundaries.schema["video_id"].dataType.simpleString()
    return grouped_fold(boundaries.select("video_id", "timestamp_ms", "confidence"), ["video_id"], ["timestamp_ms"], fold, f"video_id {kind}, timestamp_ms long, confidence double")


def score_runs(scores: DataFrame, threshold: float) -> DataFrame:
    """scores (video_id, frame_id, score): runs of adjacent frames at or above threshold, as their first highest frame."""
    above = scores.where(F.col("score") >= threshold)
    w = Window.partitionBy("video_id").orderBy("frame_id")
    islands = above.withColumn("island", F.col("frame_id") - F.row_number().over(w))
    return islands.groupBy("video_id", "island").agg(F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"), F.max("score").alias("score"), F.count("*").alias("length")).drop("island")


def anchors(shots: DataFrame, max_gap: int = MAX_GAP, guard: int = GUARD) -> DataFrame:
    """Anchor times of shots (video_id, shot_id, start_ms, end_ms): the middle, subdivisions of long shots, and guards near
    both ends; each (time, reason) once."""
    duration = F.col("end_ms") - F.col("start_ms")
    parts = F.ceil(duration / max_gap)
    cuts = F.when(parts > 1, F.transform(F.sequence(F.lit(1), (parts - 1).cast("int")), lambda i: F.struct((F.col("start_ms") + F.floor(duration * i / parts)).cast("long").alias("t"), F.lit("subdivision").alias("reason")))).otherwise(F.array().cast("array<struct<t:bigint,reason:string>>"))
    middle = F.array(F.struct(F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("t"), F.lit("representative").alias("reason")))
    guards = F.when(duration > 2 * guard, F.array(F.struct((F.col("start_ms") + guard).alias("t"), F.lit("guard").alias("reason")), F.struct((F.col("end_ms") - guard).alias("t"), F.lit("guard").alias("reason")))).otherwise(F.array().cast("array<struct<t:bigint,reason:string>>"))
    return shots.select("video_id", "shot_id", "start_ms", "end_ms", F.explode(F.array_distinct(F.concat(middle, cuts, guards))).alias("a")).select("video_id", "shot_id", "start_ms", "end_ms", F.col("a.t").alias("anchor_ms"), F.col("a.reason").alias("reason"))


def best_near_anchor(points: DataFrame, frames: DataFrame, radius: int = RADIUS, bias: float = 0.25) -> DataFrame:
    """For each anchor the frame (video_id, frame_id, timestamp_ms, quality) of its shot within radius that has the highest
    quality less bias * distance / radius; the first on a tie."""
    f = frames.select("video_id", "frame_id", F.col("timestamp_ms").alias("__t"), "quality", F.explode(F.sequence(F.floor((F.col("timestamp_ms") - radius) / radius), F.floor((F.col("timestamp_ms") + radius) / radius))).alias("__cell"))
    met = points.withColumn("__cell", F.floor(F.col("anchor_ms") / radius)).join(f, ["video_id", "__cell"]).where((F.abs(F.col("__t") - F.col("anchor_ms")) <= radius) & F.col("__t").between(F.col("start_ms"), F.col("end_ms")))
    score = F.col("quality") - bias * F.abs(F.col("__t") - F.col("anchor_ms")) / radius
    return met.groupBy("video_id", "shot_id", "anchor_ms", "reason").agg(F.max_by("frame_id", F.struct(score, -F.col("__t"), -F.col("frame_id"))).alias("frame_id"), F.round(F.max(score), 6).alias("score"))


def frame_quality(sharpness: Column, black: Column, blur: Column, face: Column | None = None, text: Column | None = None, weights=(1.0, 5.0, 1.0, 0.0, 0.0)) -> Column:
    extra = (face if face is not None else F.lit(0.0)) * weights[3] + (text if text is not None else F.lit(0.0)) * weights[4]
    return weights[0] * F.log1p(sharpness) - weights[1] * black - weights[2] * blur + extra


def _replaced(kept: Column, at: Column, row: Column) -> Column:
    """kept with row in place at (from 1)."""
    return F.transform(kept, lambda k, i: F.when(i + 1 == at, row).otherwise(k))


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and rows: a group's rows as an array of structs, sorted by order.  A video or a shot bounds a group."""
    others = [c for c in rows.columns if c not in order]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("rows"))


def perceptual_dedup(frames: DataFrame, bits: int = DEDUP_BITS, window: int = DEDUP_WINDOW) -> DataFrame:
    """frames (video_id, shot_id, frame_id, timestamp_ms, priority, quality, hash): of frames of a shot within window and
    bits of one another, the one of higher (priority, quality) stays in the earlier's place.

    A frame is compared with the kept ones in the places after the last that lies more than window back, and with the
    latest like one of these.
    """
    columns = ["video_id", "shot_id", "frame_id", "timestamp_ms", "priority", "quality", "hash"]

    def step(kept: Column, r: Column) -> Column:
        like = lambda k: (k["shot_id"] == r["shot_id"]) & (F.bit_count(k["hash"].bitwiseXOR(r["hash"])) <= bits)
        far = F.array_max(F.transform(kept, lambda k, i: F.when(r["timestamp_ms"] - k["timestamp_ms"] > window, i)))
        twin = lambda far: F.array_max(F.transform(kept, lambda k, i: F.when((i > far) & like(k), i)))

        def placed(twin: Column) -> Column:
            held = F.get(kept, twin)
            better = F.struct(r["priority"], r["quality"]) > F.struct(held["priority"], held["quality"])
            return F.when(twin.isNull(), F.concat(kept, F.array(r))).when(better, _replaced(kept, twin + 1, r)).otherwise(kept)

        # both places are looked for once a frame, not once for each kept one
        return let(let(F.coalesce(far, F.lit(-1)), twin), placed)

    rows = in_order(frames.select(*columns[:-1], F.col("hash").cast("long").alias("hash")), ["video_id"], ["timestamp_ms", "frame_id"])
    none = F.filter("rows", lambda r: F.lit(False))
    out = rows.select(F.explode(F.aggregate("rows", none, step)).alias("r"))
    return out.select(*(F.col(f"r.{c}") for c in columns))


def fill_gaps(chosen: DataFrame, frames: DataFrame, shots: DataFrame, limit: int = MAX_GAP, strict: bool = False) -> DataFrame:
    """(video_id, shot_id, frame_id, timestamp_ms, added): as long as a gap of a shot (its ends included) is above limit, the
    unused frame inside it nearest to min(right - 1, left + limit) is added.

    Frames of different gaps don't meet, so each round fills all of a shot's gaps at once.  A gap without an unused frame
    stays, or with strict is an error.
    """
    at = ["video_id", "shot_id"]
    point = lambda df: df.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "frame_id"))).alias("x"))
    free = frames.select(*at, "frame_id", "timestamp_ms").join(chosen.select("video_id", "frame_id"), ["video_id", "frame_id"], "left_anti")
    both = point(chosen).withColumnRenamed("x", "used").join(point(free).withColumnRenamed("x", "free"), at, "left").join(shots.select(*at, "start_ms", "end_ms"), at)

    def gaps(times: Column) -> Column:
        return F.filter(F.zip_with(F.slice(times, F.lit(1), F.size(times) - 1), F.slice(times, F.lit(2), F.size(times) - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right"))), lambda g: g["right"] - g["left"] > limit)

    def times(used: Column) -> Column:
        return F.array_sort(F.concat(F.array("start_ms", "end_ms"), F.transform(used, lambda u: u["timestamp_ms"])))

    def filled(used: Column, _: Column) -> Column:
        def nearest(g: Column) -> Column:
            goal = F.least(g["right"] - 1, g["left"] + limit)
            inside = F.filter("free", lambda f: (f["timestamp_ms"] > g["left"]) & (f["timestamp_ms"] < g["right"]))
            return F.array_min(F.transform(inside, lambda f: F.struct(F.abs(f["timestamp_ms"] - goal).alias("off"), f["timestamp_ms"].alias("timestamp_ms"), f["frame_id"].alias("frame_id"))))

        found = F.filter(F.transform(gaps(times(used)), nearest), lambda f: f.isNotNull())
        return F.concat(used, F.transform(found, lambda f: F.struct(f["timestamp_ms"].alias("timestamp_ms"), f["frame_id"].alias("frame_id"))))

    # a round adds a frame at least, or there is none left to add
    rounds = F.sequence(F.lit(0), F.coalesce(F.size("free"), F.lit(0)))
    out = both.withColumn("free", F.coalesce("free", F.filter("used", lambda u: F.lit(False)))).withColumn("all", F.aggregate(rounds, F.col("used"), filled))
    if strict:
        out = out.withColumn("all", F.when(F.size(gaps(times(F.col("all")))) > 0, F.raise_error(F.concat(F.lit("no unused frame can fill a gap of shot "), F.col("shot_id").cast("string")))).otherwise(F.col("all")))
    each = out.select(*at, "used", F.explode("all").alias("f"))
    return each.select(*at, F.col("f.frame_id").cast("long").alias("frame_id"), F.col("f.timestamp_ms").cast("long").alias("timestamp_ms"), (~F.array_contains("used", F.col("f"))).alias("added"))


# ---------------------------------------------------------------- speech


def merge_intervals(spans: DataFrame, gap: int = VAD_GAP) -> DataFrame:
    """spans (video_id, start_ms, end_ms) merged where the next starts within gap of the furthest end so far."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(F.col("start_ms") <= reach + gap, 0).otherwise(1)).withColumn("__group", F.sum("__new").over(w))
    return marked.groupBy("video_id", "__group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_spans")).drop("__group")


def merge_confidence(spans: DataFrame, gap: int = VAD_GAP) -> DataFrame:
    """As merge_intervals, with the running pairwise mean of the confidences, which depends on their order."""

    def fold(rows):
        out: list[dict] = []
        for r in rows:
            if out and r["start_ms"] <= out[-1]["end_ms"] + gap:
                last = out[-1]
                last["end_ms"] = max(last["end_ms"], r["end_ms"])
                if r["confidence"] is not None:
                    last["confidence"] = r["confidence"] if last["confidence"] is None else (last["confidence"] + r["confidence"]) / 2
            else:
                out.append(dict(r))
        return out

    kind = spans.schema["video_id"].dataType.simpleString()
    return grouped_fold(spans.select("video_id", "start_ms", "end_ms", "confidence"), ["video_id"], ["start_ms", "end_ms"], fold, f"video_id {kind}, start_ms long, end_ms long, confidence double")


def split_intervals(spans: DataFrame, most: int = VAD_MAX, overlap: int = VAD_OVERLAP) -> DataFrame:
    """Intervals cut into chunks of at most most, each starting overlap before the last one's end."""
    step = most - overlap
    n = F.when(F.col("end_ms") - F.col("start_ms") <= most, 1).otherwise(F.ceil((F.col("end_ms") - F.col("start_ms") - overlap) / step))
    out = spans.withColumn("__i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return out.withColumns({"start_ms": F.col("start_ms") + F.col("__i") * step, "end_ms": F.least("end_ms", F.col("start_ms") + F.col("__i") * step + most)}).drop("__i")


def speech_segments(spans: DataFrame, media: DataFrame, most: int = VAD_MAX, overlap: int = VAD_OVERLAP, gap: int = VAD_GAP) -> DataFrame:
    """Voice activity clamped to the media, merged and split."""
    inside = spans.join(media.select("video_id", "duration_ms"), "video_id").select("video_id", F.greatest(F.lit(0), "start_ms").cast("long").alias("start_ms"), F.least("end_ms", "duration_ms").cast("long").alias("end_ms")).where("end_ms > start_ms")
    return split_intervals(merge_intervals(inside, gap), most, overlap)


def dedup_segments(segments: DataFrame, look_back: int = 4) -> DataFrame:
    """segments (video_id, start_ms, end_ms, text, avg_logprob, n_words): one with the same text as one of the last kept ones
    and half of the shorter in common, or a start within 500 ms, replaces the oldest such if it is likelier (or has more
    words), else goes.  text is the normalised text.  Ids are numbered anew.
    """
    columns = ["start_ms", "end_ms", "text", "avg_logprob", "n_words"]

    def step(kept: Column, r: Column) -> Column:
        def twin(k: Column, i: Column) -> Column:
            common = F.least(k["end_ms"], r["end_ms"]) - F.greatest(k["start_ms"], r["start_ms"])
            shorter = F.greatest(F.lit(1), F.least(k["end_ms"] - k["start_ms"], r["end_ms"] - r["start_ms"]))
            near = (common / shorter >= 0.5) | (F.abs(k["start_ms"] - r["start_ms"]) <= 500)
            return F.when((i >= F.size(kept) - look_back) & k["text"].eqNullSafe(r["text"]) & near, i)

        at = F.array_min(F.transform(kept, twin))
        held, low = F.get(kept, at), F.lit(-999.0)
        better = (F.coalesce(r["avg_logprob"], low) > F.coalesce(held["avg_logprob"], low)) | (r["n_words"] > held["n_words"])
        return F.when(at.isNull(), F.concat(kept, F.array(r))).when(better, _replaced(kept, at + 1, r)).otherwise(kept)

    rows = segments.select("video_id", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.col("text").cast("string"), F.col("avg_logprob").cast("double"), F.col("n_words").cast("long"))
    rows = in_order(rows, ["video_id"], ["start_ms", "end_ms", "text"])
    kept = F.aggregate("rows", F.filter("rows", lambda r: F.lit(False)), step)
    # replaced ones may stand out of order
    placed = F.array_sort(F.transform(kept, lambda k, i: F.struct(k["start_ms"].alias("start_ms"), k["end_ms"].alias("end_ms"), i.alias("i"), k.alias("row"))))
    out = rows.select("video_id", F.posexplode(placed).alias("i", "p")).select("video_id", "i", F.col("p.row").alias("r"))
    return out.select("video_id", *(F.col(f"r.{c}") for c in columns), F.concat(F.lit("asr:"), F.col("video_id").cast("string"), F.lit(":"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("segment_id"))


def offset_words(words: Column, offset: Column, start: Column, end: Column) -> Column:
    """Words (start_ms, end_ms, word) of a chunk in the video's time, those outside left out, the rest clipped."""
    moved = F.transform(words, lambda w: F.struct((w["start_ms"] + offset).alias("start_ms"), (w["end_ms"] + offset).alias("end_ms"), w["word"].alias("word")))
    return F.transform(F.filter(moved, lambda w: (w["end_ms"] > start) & (w["start_ms"] < end)), lambda w: F.struct(F.greatest(w["start_ms"], start).alias("start_ms"), F.least(w["end_ms"], end).alias("end_ms"), w["word"].alias("word")))


# ---------------------------------------------------------------- frame index


def normalise_timeline(decoded: DataFrame) -> DataFrame:
    """decoded (video_id, decode_index, raw_timestamp_ms) from zero, with contiguous frame ids; a negative time is an error."""
    w = Window.partitionBy("video_id").orderBy("decode_index")
    origin = F.first_value("raw_timestamp_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = decoded.withColumns({"timeline_origin_ms": origin, "timestamp_ms": F.col("raw_timestamp_ms") - origin, "frame_id": (F.row_number().over(w) - 1).cast("long")})
    return out.withColumn("timestamp_ms", F.when(F.col("timestamp_ms") < 0, F.raise_error(F.lit("a frame lies before the first one")).cast("long")).otherwise(F.col("timestamp_ms")))


def order_faults(frames: DataFrame) -> DataFrame:
    """Rows whose time runs back, whose frame_id does not grow, or whose position is not their frame_id."""
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    by_id = Window.partitionBy("video_id").orderBy("frame_id")
    out = frames.withColumns({"__pos": F.row_number().over(by_id) - 1, "__prev_t": F.lag("timestamp_ms").over(by_id), "__prev_f": F.lag("frame_id").over(w)})
    fault = F.when(F.col("timestamp_ms") < F.col("__prev_t"), "time runs back").when(F.col("frame_id") <= F.col("__prev_f"), "frame id does not grow").when(F.col("__pos") != F.col("frame_id"), "frame ids are not contiguous")
    return out.withColumn("fault", fault).where("fault is not null").select("video_id", "frame_id", "timestamp_ms", "fault")


def variable_rate(frames: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Whether a video's positive time steps differ from their median by more than tolerance (false below 3 rows or 2 steps)."""
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    steps = frames.withColumn("d", F.col("timestamp_ms") - F.lag("timestamp_ms").over(w))
    middle = steps.groupBy("video_id").agg(F.count("*").alias("n"), F.median(F.when(F.col("d") > 0, F.col("d"))).alias("m"), F.count_if(F.col("d") > 0).alias("k"))
    off = steps.where("d > 0").join(middle, "video_id").groupBy("video_id").agg(F.max(F.abs(F.col("d") - F.col("m"))).alias("off"))
    return middle.join(off, "video_id", "left").select("video_id", F.coalesce((F.col("n") >= 3) & (F.col("k") >= 2) & (F.col("off") > tolerance), F.lit(False)).alias("is_variable_frame_rate"))


def decimate(frames: DataFrame, fps: float) -> DataFrame:
    """Frames at least 1000 / fps ms after the last one taken."""

    def fold(rows):
        out, last = [], None
        for r in rows:
            if last is None or r["timestamp_ms"] - last >= 1000.0 / fps:
                out.append(r)
                last = r["timestamp_ms"]
        return out

    kind = frames.schema["video_id"].dataType.simpleString()
    return grouped_fold(frames.select("video_id", "frame_id", "timestamp_ms"), ["video_id"], ["timestamp_ms", "frame_id"], fold, f"video_id {kind}, frame_id long, timestamp_ms long")


def two_stage_sample(frames: DataFrame, requests: DataFrame, coarse_fps: float = 2, dense_fps: float = 24, dense_radius: int = 500, seeds: int = 2, budget: int = 200) -> DataFrame:
    """Frames of each request (request_id, video_id, center_ms, radius): every coarse step inside the window; the seeds nearest to
    the centre; every dense step around those; nearest to the centre first, up to budget."""
    f = frames.join(requests, "video_id").where(F.col("timestamp_ms").between(F.col("center_ms") - F.col("radius"), F.col("center_ms") + F.col("radius")))

    def thin(df, fps):
        w = Window.partitionBy("request_id", F.floor(F.col("timestamp_ms") * fps / 1000)).orderBy("timestamp_ms", "frame_id")
        return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

    near = Window.partitionBy("request_id").orderBy(F.abs(F.col("timestamp_ms") - F.col("center_ms")), "timestamp_ms", "frame_id")
    coarse = thin(f, coarse_fps).withColumn("__seed", F.row_number().over(near))
    around = coarse.where(F.col("__seed") <= seeds).select("request_id", F.col("timestamp_ms").alias("__t")).groupBy("request_id").agg(F.collect_list("__t").alias("__at"))
    dense = thin(f.join(around, "request_id").where(F.exists("__at", lambda t: F.abs(F.col("timestamp_ms") - t) <= dense_radius)).drop("__at"), dense_fps)
    both = coarse.drop("__seed").withColumn("stage", F.lit("coarse")).unionByName(dense.withColumn("stage", F.lit("dense"))).groupBy("request_id", "video_id", "frame_id", "timestamp_ms", "center_ms").agg(F.min("stage").alias("stage"))
    return both.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= budget).drop("center_ms")


# ---------------------------------------------------------------- positions


def evidence_ranks(rows: DataFrame, kind: str) -> DataFrame:
    """Deterministic ids: position over a video's rows by frame, box and text."""
    w = Window.partitionBy("video_id").orderBy("frame_id", "bbox", "normalized_text", "raw_text")
    return rows.withColumn("evidence_id", F.concat_ws(":", F.lit(kind), F.col("video_id").cast("string"), F.col("frame_id").cast("string"), (F.row_number().over(w) - 1).cast("string")))


def middle_row(frames: DataFrame) -> DataFrame:
    """The row in the middle (n // 2) of each video by time and frame."""
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    return frames.withColumns({"__r": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy("video_id"))}).where("__r = floor(__n / 2) + 1").drop("__r", "__n")


def audit_sample(frames: DataFrame, shots: DataFrame, least: int = 3, most: int = 7) -> DataFrame:
    """First, middle and last frames and those at shot boundaries, the first max(least, most) of a video."""
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    f = frames.withColumns({"position": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy("video_id"))})
    edges = shots.select("video_id", F.explode(F.array("start_frame_id", "end_frame_id")).alias("frame_id")).distinct().withColumn("edge", F.lit(True))
    f = f.join(edges, ["video_id", "frame_id"], "left").where(F.expr("position in (0, floor(__n / 2), __n - 1)") | F.col("edge"))
    return f.withColumn("__r", F.row_number().over(Window.partitionBy("video_id").orderBy("position"))).where(F.col("__r") <= max(least, most)).select("video_id", "frame_id", "timestamp_ms", "position")


def largest_gap(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """The largest step between consecutive frames of a shot, its ends included."""
    ends = shots.select("video_id", "shot_id", F.explode(F.array("start_ms", "end_ms")).alias("t"))
    both = frames.select("video_id", "shot_id", F.col("timestamp_ms").alias("t")).unionByName(ends)
    w = Window.partitionBy("video_id", "shot_id").orderBy("t")
    return both.withColumn("gap", F.lead("t").over(w) - F.col("t")).groupBy("video_id", "shot_id").agg(F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("largest_gap_ms"))


def shot_overlaps(shots: DataFrame) -> DataFrame:
    """Shots that start before the one before them has ended."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "shot_id")
    return shots.withColumns({"prev_shot_id": F.lag("shot_id").over(w), "__end": F.lag("end_ms").over(w)}).where("start_ms < __end").drop("__end")
