"""Shot boundaries from sampled histograms, and a video's keyframes from its shots: the ordered operators as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import sequences

# Defaults of the histogram detector.
SAMPLE_EVERY, DISTANCE = 500, 0.48
#: What stays when two keyframes are alike: guards before gap fillers and subdivisions, representatives before all.
PRIORITY = {"representative": 4, "guard": 3, "max_gap": 2, "subdivision": 1}


def histogram_boundaries(frames: DataFrame, every: int = SAMPLE_EVERY, distance: float = DISTANCE) -> DataFrame:
    """frames (video_id, frame_id, timestamp_ms, histogram): boundaries (video_id, frame_id, timestamp_ms, confidence) where a
    sampled frame's histogram lies further than distance from the sample before it.  One frame in every ms is a sample."""
    first = Window.partitionBy("video_id", F.floor(F.col("timestamp_ms") / every)).orderBy("timestamp_ms", "frame_id")
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    sampled = frames.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    far = sampled.withColumn("__before", F.lag("histogram").over(w)).where("__before is not null")
    far = far.withColumn("confidence", S.bhattacharyya(F.col("__before"), F.col("histogram")))
    return far.where(F.col("confidence") > distance).select("video_id", "frame_id", "timestamp_ms", "confidence")


def shots(boundaries: DataFrame, frames: DataFrame) -> DataFrame:
    """Shots (video_id, shot_id, start_frame_id, end_frame_id, start_ms, end_ms, confidence) between boundaries; a video
    without any is one shot."""
    ends = frames.groupBy("video_id").agg(F.min("frame_id").alias("first_frame_id"), F.max("frame_id").alias("last_frame_id"))
    starts = ends.select("video_id", F.col("first_frame_id").alias("start_frame_id"), F.lit(None).cast("double").alias("confidence"), "last_frame_id")
    starts = starts.unionByName(boundaries.join(ends, "video_id").where("frame_id > first_frame_id").select("video_id", F.col("frame_id").alias("start_frame_id"), F.col("confidence").cast("double").alias("confidence"), "last_frame_id"))
    cut = sequences.shots_from_starts(starts)
    at = lambda name: frames.select("video_id", F.col("frame_id").alias(f"{name}_frame_id"), F.col("timestamp_ms").alias(f"{name}_ms"))
    # a shot may end at a frame number that wasn't sampled: its last frame is the one before the next shot
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    before = frames.select("video_id", F.lag("timestamp_ms").over(w).alias("before_ms"), F.col("frame_id").alias("next_frame_id"))
    out = cut.join(at("start"), ["video_id", "start_frame_id"]).withColumn("next_frame_id", F.col("end_frame_id") + 1)
    out = out.join(before, ["video_id", "next_frame_id"], "left").join(frames.groupBy("video_id").agg(F.max("timestamp_ms").alias("last_ms")), "video_id")
    return out.select("video_id", "shot_id", "start_frame_id", "end_frame_id", "start_ms", F.coalesce("before_ms", "last_ms").alias("end_ms"), "confidence")


def extract(cuts: DataFrame, frames: DataFrame, max_gap: int = sequences.MAX_GAP, radius: int = sequences.RADIUS, bits: int = sequences.DEDUP_BITS, window: int = sequences.DEDUP_WINDOW) -> DataFrame:
    """Keyframes (video_id, keyframe_seq, shot_id, frame_id, timestamp_ms, reason): of each shot the best frame near each
    anchor, without perceptual copies, and with the gaps above max_gap filled.

    cuts: video_id, shot_id, start_ms, end_ms; frames: video_id, frame_id, timestamp_ms, quality, hash.
    """
    best = sequences.best_near_anchor(sequences.anchors(cuts, max_gap), frames, radius)
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("reason")], F.lit(0))
    chosen = best.withColumn("priority", rank).groupBy("video_id", "shot_id", "frame_id").agg(F.max_by("reason", "priority").alias("reason"), F.max("priority").alias("priority"))
    chosen = chosen.join(frames.select("video_id", "frame_id", "timestamp_ms", "quality", "hash"), ["video_id", "frame_id"])
    kept = sequences.perceptual_dedup(chosen, bits, window)
    inside = frames.select("video_id", "frame_id", "timestamp_ms").join(cuts, "video_id").where(F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms"))).select("video_id", "shot_id", "frame_id", "timestamp_ms")
    filled = sequences.fill_gaps(kept.select("video_id", "shot_id", "frame_id", "timestamp_ms"), inside, cuts, max_gap)
    named = filled.join(chosen.select("video_id", "shot_id", "frame_id", "reason"), ["video_id", "shot_id", "frame_id"], "left")
    order = Window.partitionBy("video_id").orderBy("timestamp_ms", "frame_id", "shot_id")
    return named.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("keyframe_seq"), "shot_id", "frame_id", "timestamp_ms", F.coalesce("reason", F.lit("max_gap")).alias("reason"))
