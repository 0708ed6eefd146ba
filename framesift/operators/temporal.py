"""As-of lookups, interval joins, neighbour links and windows over timelines.

As-of lookups union probes with the timeline and carry the nearest rows along one window sort per video, so a probe
costs a row of that sort and not a scan of the timeline.  Interval joins are cut into time buckets, so that they are equi
joins on (video, bucket) with a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the time buckets of interval joins (ms); near the length of most intervals, so that few buckets hold each.
BUCKET = 60_000


def timeline(key: str = "video_id", time: str = "timestamp_ms", frame: str = "frame_id"):
    return Window.partitionBy(key).orderBy(time, frame)


def as_of(probes: DataFrame, frames: DataFrame, at: str = "t", clamp: bool = True) -> DataFrame:
    """probes (probe_id, video_id, t) with before, after and nearest as structs (timestamp_ms, frame_id).

    before is the last frame at or before t, after the first at or after it; with clamp, the first or last frame where
    there is none.  nearest takes the earlier of two as near.  Frames at one time: before and nearest give the largest
    and smallest frame_id that bisection would meet: an exact match is the first frame at that time.
    """
    line = frames.select("video_id", F.col("timestamp_ms").alias("ms"), F.struct("timestamp_ms", "frame_id").alias("f"))
    first_at = line.groupBy("video_id", "ms").agg(F.min("f").alias("first"), F.max("f").alias("last"))
    both = first_at.select("video_id", "ms", "first", "last", F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id")).unionByName(
        probes.select("video_id", F.col(at).cast("long").alias("ms"), F.lit(None).cast("struct<timestamp_ms:bigint,frame_id:bigint>").alias("first"), F.lit(None).cast("struct<timestamp_ms:bigint,frame_id:bigint>").alias("last"), "probe_id")
    )
    w = Window.partitionBy("video_id").orderBy("ms")
    up_to, on_from, whole = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumns({
        "exact": F.max("first").over(Window.partitionBy("video_id", "ms")),
        "prev": F.max("last").over(up_to), "next": F.min("first").over(on_from),
        "lowest": F.min("first").over(whole), "highest": F.max("last").over(whole),
    }).where("probe_id is not null")
    before = F.coalesce("exact", "prev", "lowest") if clamp else F.coalesce("exact", "prev")
    after = F.coalesce("exact", "next", "highest") if clamp else F.coalesce("exact", "next")
    near_prev = F.coalesce(F.col("ms") - F.col("prev.timestamp_ms"), F.lit(1 << 60))
    near_next = F.coalesce(F.col("next.timestamp_ms") - F.col("ms"), F.lit(1 << 60))
    nearest = F.coalesce("exact", F.when(near_prev <= near_next, F.col("prev")).otherwise(F.col("next")))
    return both.select("probe_id", "video_id", F.col("ms").alias(at), before.alias("before"), after.alias("after"), nearest.alias("nearest"))


def as_of_error(probes: DataFrame, frames: DataFrame) -> DataFrame:
    """Nearest frame and its absolute error."""
    out = as_of(probes, frames)
    return out.select("probe_id", "video_id", "t", F.col("nearest.frame_id").alias("frame_id"), F.abs(F.col("nearest.timestamp_ms") - F.col("t")).alias("absolute_error_ms"))


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], key: str = "video_id", width: int = BUCKET, how: str = "inner") -> DataFrame:
    """Rows of left with rows of right of the same key whose closed intervals overlap.

    Each interval goes to the time buckets it covers; of the buckets that two share, the first one keeps the pair.
    Column names of the two sides must differ but for key.  Sides are merged and never broadcast: a plan's sizes don't count
    the rows that the buckets add.
    """
    (a, b), (c, d) = left_span, right_span
    x = left.withColumn("__bucket", _buckets(F.col(a), F.col(b), width))
    y = right.withColumn("__bucket", _buckets(F.col(c), F.col(d), width))
    met = x.hint("merge").join(y.hint("merge"), [key, "__bucket"]).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__bucket") == F.floor(F.greatest(a, c) / width))).drop("__bucket")
    if how == "inner":
        return met
    rest = left.join(met.select(*left.columns).distinct(), left.columns, "left_anti")
    return met.unionByName(rest, allowMissingColumns=True)


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str = "timestamp_ms") -> DataFrame:
    """points (probe_id, video_id, at, shot_id or null) with the shot they lie in: the given one, else the last that starts
    at or before the point and has not ended; null in a gap."""
    spans = intervals.select("video_id", F.struct("start_timestamp_ms", "end_timestamp_ms", "shot_id").alias("s"))
    both = points.select("video_id", F.col(at).alias("ms"), F.lit(1).alias("kind"), "probe_id", F.col("shot_id").alias("given"), F.lit(None).cast("struct<start_timestamp_ms:bigint,end_timestamp_ms:bigint,shot_id:string>").alias("s")).unionByName(
        spans.select("video_id", F.col("s.start_timestamp_ms").alias("ms"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["probe_id"].dataType).alias("probe_id"), F.lit(None).cast("string").alias("given"), "s")
    )
    last = F.max("s").over(Window.partitionBy("video_id").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("last", last).where("kind = 1")
    inside = F.when(F.col("ms") <= F.col("last.end_timestamp_ms"), F.col("last.shot_id"))
    return out.select("probe_id", "video_id", F.col("ms").alias(at), F.coalesce("given", inside).alias("shot_id"))


def neighbours(frames: DataFrame) -> DataFrame:
    """frames with the frame and time before and after, in order of time and frame."""
    w = timeline()
    return frames.withColumns({"prev_frame_id": F.lag("frame_id").over(w), "prev_timestamp_ms": F.lag("timestamp_ms").over(w), "next_frame_id": F.lead("frame_id").over(w), "next_timestamp_ms": F.lead("timestamp_ms").over(w)})


def contained_frames(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """segments (segment_id, video_id, start_ms, end_ms) with the frames inside, in order; empty without any."""
    line = frames.select("video_id", F.col("frame_id").alias("__frame"), F.col("timestamp_ms").alias("__t"))
    met = interval_join(segments, line, ("start_ms", "end_ms"), ("__t", "__t"))
    inside = met.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__t", "__frame"))), lambda x: x["__frame"]).alias("frames"))
    return segments.join(inside, "segment_id", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<bigint>")))


def frame_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames with the segments that contain them, by start and id."""
    s = segments.select("video_id", F.col("segment_id").alias("__segment"), F.col("start_ms").alias("__a"), F.col("end_ms").alias("__b"))
    line = frames.select("video_id", "frame_id", "timestamp_ms")
    met = interval_join(line, s, ("timestamp_ms", "timestamp_ms"), ("__a", "__b"))
    linked = met.groupBy("video_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__a", "__segment"))), lambda x: x["__segment"]).alias("segments"))
    return line.join(linked, ["video_id", "frame_id"], "left").withColumn("segments", F.coalesce("segments", F.array().cast("array<string>")))


def overlapping_shots(segments: DataFrame, shots: DataFrame, width: int = BUCKET) -> DataFrame:
    """segments with the shots they overlap, by start."""
    s = shots.select("video_id", F.col("shot_id").alias("__shot"), F.col("start_timestamp_ms").alias("__a"), F.col("end_timestamp_ms").alias("__b"))
    met = interval_join(segments, s, ("start_ms", "end_ms"), ("__a", "__b"), width=width)
    out = met.groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__a", "__shot"))), lambda x: x["__shot"]).alias("shots"))
    return segments.join(out, "segment_id", "left").withColumn("shots", F.coalesce("shots", F.array().cast("array<string>")))


def context(segments: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """Segments of the same video that overlap the interval of a target (segment_id, video_id, start_ms, end_ms) widened by
    radius, by start and end."""
    target = targets.select("video_id", F.col("segment_id").alias("target_id"), F.greatest(F.lit(0), F.col("start_ms") - radius).alias("__a"), (F.col("end_ms") + radius).alias("__b"))
    return interval_join(segments, target, ("start_ms", "end_ms"), ("__a", "__b"), width=max(BUCKET, radius)).drop("__a", "__b").orderBy("target_id", "start_ms", "end_ms")


def segment_links(segments: DataFrame, frames: DataFrame, shots: DataFrame, media: DataFrame, width: int = BUCKET) -> DataFrame:
    """The link row of each segment: representative (nearest to the middle), frame before its start and after its end,
    frames inside and shots overlapped.  Ends are clamped to the duration; a start beyond it is an error."""
    s = segments.join(media.select("video_id", "duration_ms"), "video_id")
    s = s.withColumn("end_ms", F.when(F.col("start_ms") > F.col("duration_ms"), F.raise_error(F.concat(F.lit("segment starts after its video ends: "), "segment_id")).cast("long")).otherwise(F.least("end_ms", "duration_ms"))).drop("duration_ms")
    probe = lambda at: s.select(F.col("segment_id").alias("probe_id"), "video_id", at.alias("t"))
    middle = as_of(probe(F.floor((F.col("start_ms") + F.col("end_ms")) / 2)), frames).select(F.col("probe_id").alias("segment_id"), F.col("nearest.frame_id").alias("representative_frame_id"))
    before = as_of(probe(F.col("start_ms")), frames).select(F.col("probe_id").alias("segment_id"), F.col("before.frame_id").alias("before_frame_id"))
    after = as_of(probe(F.col("end_ms")), frames).select(F.col("probe_id").alias("segment_id"), F.col("after.frame_id").alias("after_frame_id"))
    return contained_frames(s, frames).join(overlapping_shots(s, shots, width).select("segment_id", "shots"), "segment_id").join(middle, "segment_id").join(before, "segment_id").join(after, "segment_id")


def interval_keyframes(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """requests (segment_id, video_id, start_ms, end_ms) with the frames inside, or the bracket around an empty one."""
    inside = contained_frames(requests, frames)
    probe = lambda c: requests.select(F.col("segment_id").alias("probe_id"), "video_id", F.col(c).alias("t"))
    a = as_of(probe("start_ms"), frames).select(F.col("probe_id").alias("segment_id"), F.col("before.frame_id").alias("__a"))
    b = as_of(probe("end_ms"), frames).select(F.col("probe_id").alias("segment_id"), F.col("after.frame_id").alias("__b"))
    out = inside.join(a, "segment_id").join(b, "segment_id")
    return out.withColumn("frames", F.when(F.size("frames") > 0, F.col("frames")).otherwise(F.array_distinct(F.array("__a", "__b")))).drop("__a", "__b")


def window_by_radius(requests: DataFrame, frames: DataFrame, shots: DataFrame, segments: DataFrame, media: DataFrame, width: int = BUCKET) -> DataFrame:
    """requests (segment_id, video_id, t, radius) as windows clamped to the media: representative, keyframes, shots in the
    order of the frames, overlapping segments, and whether the window was clamped."""
    r = requests.join(media.select("video_id", "duration_ms"), "video_id")
    r = r.withColumns({"start_ms": F.greatest(F.lit(0), F.col("t") - F.col("radius")), "end_ms": F.least("duration_ms", F.col("t") + F.col("radius"))})
    r = r.withColumn("clamped", (F.col("t") - F.col("radius") < 0) | (F.col("t") + F.col("radius") > F.col("duration_ms"))).drop("duration_ms")
    keyed = interval_keyframes(r, frames)
    near = as_of(r.select(F.col("segment_id").alias("probe_id"), "video_id", "t"), frames).select(F.col("probe_id").alias("segment_id"), F.col("nearest.frame_id").alias("representative_frame_id"))
    seen = overlapping_shots(r, shots, width).select("segment_id", "shots")
    said = segments.select("video_id", F.col("segment_id").alias("__segment"), F.col("start_ms").alias("__a"), F.col("end_ms").alias("__b"))
    spoken = interval_join(r, said, ("start_ms", "end_ms"), ("__a", "__b"), width=width).groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__a", "__segment"))), lambda x: x["__segment"]).alias("asr"))
    return keyed.join(near, "segment_id").join(seen, "segment_id").join(spoken, "segment_id", "left").withColumn("asr", F.coalesce("asr", F.array().cast("array<string>")))


def canonical(candidates: DataFrame, frames: DataFrame, media: DataFrame, radius: int = 1500) -> DataFrame:
    """candidates (candidate_id, video_id, timestamp_ms, window_start_ms, window_end_ms, sources) snapped to the nearest
    keyframe, with a window (their own, or by radius) clamped to the media and the registry added to their sources."""
    near = as_of(candidates.select(F.col("candidate_id").alias("probe_id"), "video_id", F.col("timestamp_ms").alias("t")), frames).select(F.col("probe_id").alias("candidate_id"), F.col("nearest.frame_id").alias("frame_id"), F.col("nearest.timestamp_ms").alias("__t"))
    c = candidates.drop("frame_id").join(near, "candidate_id").join(media.select("video_id", "duration_ms"), "video_id")
    start = F.greatest(F.lit(0), F.coalesce("window_start_ms", F.col("timestamp_ms") - radius))
    end = F.least("duration_ms", F.coalesce("window_end_ms", F.col("timestamp_ms") + radius))
    return c.withColumns({"window_start_ms": start, "window_end_ms": end, "sources": F.array_distinct(F.concat("sources", F.array(F.lit("temporal_registry"))))}).withColumn("timestamp_ms", F.col("__t")).drop("__t", "duration_ms")


def overlap_ranked(intervals: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with windows (frame_id, timestamp_ms, start, end) ranked for each interval by overlap, distance to the
    middle, time, frame; the nearest frame to the middle where none overlaps."""
    f = frames.select("video_id", "frame_id", "timestamp_ms", F.col("start").alias("__a"), F.col("end").alias("__b"))
    met = interval_join(intervals, f, ("start_ms", "end_ms"), ("__a", "__b"))
    overlap = F.least("end_ms", "__b") - F.greatest("start_ms", "__a")
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    w = Window.partitionBy("segment_id").orderBy(F.desc("overlap"), F.abs(F.col("timestamp_ms") - middle), "timestamp_ms", "frame_id")
    ranked = met.withColumn("overlap", overlap).withColumn("rank", F.row_number().over(w)).select("segment_id", "video_id", "frame_id", "timestamp_ms", "overlap", "rank")
    rest = intervals.join(ranked.select("segment_id"), "segment_id", "left_anti")
    near = as_of(rest.select(F.col("segment_id").alias("probe_id"), "video_id", middle.alias("t")), frames)
    return ranked.unionByName(near.select(F.col("probe_id").alias("segment_id"), "video_id", "nearest.frame_id", "nearest.timestamp_ms", F.lit(0).cast("long").alias("overlap"), F.lit(1).alias("rank")))


def uniform_samples(windows: DataFrame, frames: DataFrame, step: int) -> DataFrame:
    """Nearest frames to times every step ms of windows (segment_id, video_id, start_ms, end_ms), each once; never empty."""
    times = windows.select("segment_id", "video_id", F.posexplode(F.sequence("start_ms", F.greatest("start_ms", "end_ms"), F.lit(step))).alias("i", "t"))
    probes = times.select(F.struct("segment_id", "i").alias("probe_id"), "video_id", "t")
    return as_of(probes, frames).select("probe_id.segment_id", "probe_id.i", "nearest.frame_id").groupBy("segment_id", "frame_id").agg(F.min("i").alias("position"))


def equal_probes(media: DataFrame, n: int = 5) -> DataFrame:
    """(probe_id, video_id, t): n equally spaced times inside each video."""
    return media.select("video_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "duration_ms").select(F.concat_ws(":", "video_id", F.col("i").cast("string")).alias("probe_id"), "video_id", F.floor(F.col("duration_ms") * F.col("i") / (n + 1)).alias("t"))


def registry(frames: DataFrame, shots: DataFrame, segments: DataFrame, media: DataFrame) -> dict[str, DataFrame]:
    """Linked frames, shots and segment links of a corpus."""
    linked = neighbours(frames).join(frame_segments(frames, segments).select("video_id", "frame_id", "segments"), ["video_id", "frame_id"], "left")
    return {"frames": linked, "shots": shots, "asr_links": segment_links(segments, frames, shots, media)}


def relink(linked: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """A stored frame table with its segment links made anew."""
    return linked.drop("segments").join(frame_segments(frames, segments).select("video_id", "frame_id", "segments"), ["video_id", "frame_id"], "left")


def near_in_time(rows: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """Rows of others (other_id, video_id, other_t) within window ms of rows (row_id, video_id, t), other rows only."""
    r = rows.withColumns({"__a": F.greatest(F.lit(0), F.col("t") - window), "__b": F.col("t") + window})
    return interval_join(r, others, ("__a", "__b"), ("other_t", "other_t")).where("row_id <> other_id").drop("__a", "__b")
