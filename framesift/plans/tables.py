"""The driver's tables, seen as evidence: how each stands in for frames, intervals, detections and states."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on one machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file:{tempfile.gettempdir()}/framesift-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_folders: dict[tuple[str, str], str] = {}


def session_folder(spark: SparkSession, name: str) -> str:
    """A folder that the queries of a session share."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _folders:
        _folders[key] = scratch(spark, name)
        if _folders[key].startswith("file:/"):
            atexit.register(shutil.rmtree, "/" + _folders[key].removeprefix("file:").lstrip("/"), ignore_errors=True)
    return _folders[key]


def millis(ts: Column) -> Column:
    """Milliseconds of a zone-less time, whatever the session's zone."""
    return F.unix_millis(ts.cast("timestamp")) - F.unix_millis(F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp)"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), millis(F.col("ts")).alias("timestamp_ms"), "event_type", "value", "props")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are a video's frames; a video is a user."""
    return events(spark, sf_dir).where("event_type = 'view'").select("video_id", "frame_id", "timestamp_ms", "value")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases look for frames."""
    return events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), "video_id", F.col("timestamp_ms").alias("t"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are segments that last their value in minutes."""
    return events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").cast("string").alias("segment_id"), "video_id", F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + F.floor(F.col("value") * 60000)).cast("long").alias("end_ms"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two signups lies a shot, the last hour of which is a gap."""
    from pyspark.sql.window import Window

    e = events(spark, sf_dir).where("event_type = 'signup'")
    w = Window.partitionBy("video_id").orderBy("timestamp_ms", "event_id")
    return e.withColumn("end", F.lead("timestamp_ms").over(w)).where("end is not null").select("video_id", F.col("event_id").cast("string").alias("shot_id"), F.col("timestamp_ms").alias("start_timestamp_ms"), F.greatest(F.col("timestamp_ms"), F.col("end") - 3600000).alias("end_timestamp_ms"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("video_id").agg(F.max("timestamp_ms").alias("duration_ms"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the boxes of a frame: the order is the frame, its flag the label."""
    l = read(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 100) / 100.0, (F.col("l_suppkey") % 100) / 100.0
    label = F.concat(F.lower("l_returnflag"), F.lower("l_linestatus"))
    return l.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("detection_id"), (F.col("l_orderkey") % 64).alias("video_id"), F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("long").alias("position"), label.alias("label"), label.alias("canonical_label"), x.alias("x"), y.alias("y"), (F.col("l_quantity") / 50.0).alias("confidence"))


EVENTS = "ev as (select event_id, user_id as video_id, event_id as frame_id, cast(epoch_us(ts) // 1000 as bigint) as timestamp_ms, event_type, value, props from events)"
FRAMES = f"{EVENTS}, fr as (select video_id, frame_id, timestamp_ms, value from ev where event_type = 'view')"
PROBES = f"{FRAMES}, pr as (select event_id as probe_id, video_id, timestamp_ms as t from ev where event_type = 'purchase')"
SEGMENTS = f"{PROBES}, sg as (select cast(event_id as varchar) as segment_id, video_id, timestamp_ms as start_ms, cast(timestamp_ms + floor(value * 60000) as bigint) as end_ms from ev where event_type = 'click')"
SHOTS = f"{SEGMENTS}, sh as (select video_id, cast(event_id as varchar) as shot_id, timestamp_ms as start_timestamp_ms, greatest(timestamp_ms, nxt - 3600000) as end_timestamp_ms from (select *, lead(timestamp_ms) over (partition by video_id order by timestamp_ms, event_id) as nxt from ev where event_type = 'signup') where nxt is not null)"
DETECTIONS = "det as (select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as detection_id, l_orderkey % 64 as video_id, l_orderkey as frame_id, cast(l_linenumber as bigint) as position, lower(l_returnflag) || lower(l_linestatus) as canonical_label, (l_partkey % 100) / 100.0::double as x, (l_suppkey % 100) / 100.0::double as y, l_quantity / 50.0 as confidence from lineitem)"
