"""Groups of quality rules over a run's tables, as issue rows (severity, rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quality


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def corpus(media: DataFrame, sources: DataFrame) -> DataFrame:
    """media (video_id, path, sha256) against what lies in the store (path, sha256): ids once, sources there, checksums equal."""
    there = sources.select("path", F.col("sha256").alias("found"))
    return _all([
        quality.duplicates(media, ["video_id"], "P0", "duplicate video"),
        quality.orphans(media, sources, ["path"], "P0", "missing source"),
        quality.violations(media.join(there, "path"), F.col("sha256") == F.col("found"), F.col("video_id"), "P0", "checksum differs"),
        quality.violations(media, quality.sha256_hex(F.col("sha256")), F.col("video_id"), "P1", "not a checksum"),
    ])


def artifacts(registry: DataFrame, files: DataFrame) -> DataFrame:
    """registry (path, sha256) of completed modules against files (path, sha256)."""
    return _all([quality.orphans(registry, files, ["path"], "P0", "missing artifact"), quality.mismatches(registry.join(files.select("path"), "path", "left_semi"), files, ["path"], ["sha256"], "P0", "artifact has changed")])


def frame_index(frames: DataFrame, tolerance: int = 2) -> DataFrame:
    """frames (video_id, frame_id, timestamp_ms, pts, time_base_num, time_base_den, origin_ms): from zero, contiguous, one origin, times
    that follow from the presentation stamps."""
    w = Window.partitionBy("video_id").orderBy("frame_id")
    placed = frames.withColumns({"__pos": F.row_number().over(w) - 1, "__before": F.lag("timestamp_ms").over(w)})
    videos = frames.groupBy("video_id").agg(F.countDistinct("origin_ms").alias("origins"), F.min("timestamp_ms").alias("first"))
    key = F.concat_ws("/", "video_id", "frame_id")
    return _all([
        quality.duplicates(frames, ["video_id", "frame_id"], "P0", "duplicate frame"),
        quality.violations(placed, F.col("__pos") == F.col("frame_id"), key, "P0", "frame ids are not contiguous"),
        quality.violations(placed, F.coalesce(F.col("timestamp_ms") >= F.col("__before"), F.lit(True)), key, "P0", "time runs back"),
        quality.violations(videos, F.col("origins") == 1, F.col("video_id"), "P0", "several origins"),
        quality.violations(videos, F.col("first") == 0, F.col("video_id"), "P1", "the first frame isn't at zero"),
        quality.violations(frames, quality.pts_agree(F.col("pts"), F.col("time_base_num"), F.col("time_base_den"), F.col("timestamp_ms"), F.col("origin_ms"), tolerance), key, "P1", "time and stamp differ"),
    ])


def keyframes(keys: DataFrame, frames: DataFrame, shots: DataFrame, max_gap: int) -> DataFrame:
    """keys (video_id, frame_id, timestamp_ms, shot_id), frames (video_id, frame_id, timestamp_ms), shots (video_id, shot_id, start_ms,
    end_ms): once, as in the frame index, in their shots, each shot with one, no gap above max_gap, no overlaps."""
    from .sequences import largest_gap, shot_overlaps

    inside = keys.join(shots, ["video_id", "shot_id"])
    return _all([
        quality.duplicates(keys, ["video_id", "frame_id"], "P0", "duplicate keyframe"),
        quality.mismatches(keys, frames, ["video_id", "frame_id"], ["timestamp_ms"], "P0", "keyframe isn't as in the index"),
        quality.orphans(keys, shots, ["video_id", "shot_id"], "P0", "unknown shot"),
        quality.violations(inside, F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms")), F.concat_ws("/", "video_id", "frame_id"), "P1", "keyframe outside its shot"),
        quality.orphans(shots, keys, ["video_id", "shot_id"], "P0", "shot without a keyframe"),
        quality.violations(largest_gap(keys.select("video_id", "shot_id", "timestamp_ms"), shots), F.col("largest_gap_ms") <= max_gap, F.concat_ws("/", "video_id", "shot_id"), "P1", "gap too large"),
        quality.issues(shot_overlaps(shots), "P1", "shots overlap", F.concat_ws("/", "video_id", "shot_id")),
    ])


def required(videos: DataFrame, artifacts: DataFrame, kinds: list[str]) -> DataFrame:
    """An issue for each video (video_id) and kind without an artifact (video_id, kind)."""
    wanted = videos.select("video_id", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    return quality.orphans(wanted, artifacts, ["video_id", "kind"], "P0", "missing artifact")


def modality(rows: DataFrame, frames: DataFrame, key: str, confidence: Column | None = None, interval: tuple[Column, Column, Column] | None = None, least: float = 0.5) -> DataFrame:
    """Evidence rows (key, video_id, frame_id): ids once, frames known; intervals (start, end, duration) in range; low confidences counted."""
    found = [quality.duplicates(rows, [key], "P0", "duplicate id")]
    if "frame_id" in rows.columns:
        found.append(quality.orphans(rows, frames, ["video_id", "frame_id"], "P0", "unknown frame"))
    else:
        found.append(quality.orphans(rows, frames, ["video_id"], "P0", "unknown video"))
    if interval is not None:
        start, end, duration = interval
        found.append(quality.violations(rows, quality.closed_interval(start, end) & (end <= duration), F.col(key), "P1", "interval out of range"))
    if confidence is not None:
        low = rows.agg(F.count_if(F.coalesce(confidence, F.lit(0.0)) < least).alias("n")).where("n > 0")
        found.append(quality.issues(low, "P2", "low confidence", F.col("n")))
    return _all(found)
