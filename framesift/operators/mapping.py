"""Decoded frames named by the frame index: presentation stamps to frame ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved(decoded: DataFrame, index: DataFrame, strict: bool = True) -> DataFrame:
    """decoded (video_id, pts, time_base, timestamp_ms, ...) with frame_id by (video_id, pts, time_base) of the index.

    A frame that the index lacks, or holds at another time, is an error; without strict it is a row with its fault.
    """
    known = index.select("video_id", "pts", "time_base", "frame_id", F.col("timestamp_ms").alias("__indexed"))
    out = decoded.join(known, ["video_id", "pts", "time_base"], "left")
    fault = F.when(F.col("frame_id").isNull(), "not in the index").when(F.col("__indexed") != F.col("timestamp_ms"), "times differ")
    out = out.withColumn("fault", fault)
    if strict:
        name = F.concat_ws("/", F.col("video_id").cast("string"), F.col("pts").cast("string"))
        out = out.withColumn("frame_id", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("decoded frame "), name, F.lit(": "), F.col("fault"))).cast(index.schema["frame_id"].dataType)).otherwise(F.col("frame_id")))
    return out.drop("__indexed") if not strict else out.drop("__indexed", "fault")
