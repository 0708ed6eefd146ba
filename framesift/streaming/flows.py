"""Streaming forms of the bucket, gap-merge and session operators.

Each takes a streaming DataFrame with an event-time column and gives a streaming DataFrame; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 second", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling (or sliding) windows; rows later than `late` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def gap_merge(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events with gaps below `gap`."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_into(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function that keeps the latest row of each key in a Parquet table, one version a batch.

    A batch builds on the last whole version before it, whatever numbers lie between; one that runs again gives the same version.
    """
    from ..operators.state import latest
    from ..sources.readers import versions

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        rows = batch.unionByName(spark.read.parquet(f"{path}/v={max(before)}")) if before else batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def sessions(events: DataFrame, time: str, expire_ms: int = 24 * 3600 * 1000, most: int = 5) -> DataFrame:
    """(session_id, revision, active) after each batch of events (session_id, kind, payload): start, refine, undo, reset, confirm,
    held as state that expires without events."""
    import pandas as pd

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        revision, active = state.get if state.exists else (0, [])
        active = list(active)
        rows = pd.concat([*batches])
        for kind, payload in rows.sort_values(time)[["kind", "payload"]].itertuples(index=False):
            if kind == "refine" and len(active) >= most:
                continue
            active = [*active, payload] if kind == "refine" else active[:-1] if kind == "undo" else active if kind == "confirm" else []
            revision += kind in ("refine", "undo", "reset")
        state.update((revision, active))
        state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({"session_id": [key[0]], "revision": [revision], "active": [active]})

    kind = events.schema["session_id"].dataType.simpleString()
    return events.groupBy("session_id").applyInPandasWithState(run, f"session_id {kind}, revision long, active array<string>", "revision long, active array<string>", "update", "ProcessingTimeTimeout")
