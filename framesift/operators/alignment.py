"""Alignment of ordered events to one video's frames.

pools: (query_id, event_index, pos, video_id, frame_id, timestamp_ms, score), pos the order within an event's pool; at most
TOP candidates of an event take part, so a query is a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 20


def one_video(pools: DataFrame, fused: DataFrame) -> DataFrame:
    """pools of the video of each query's best fused candidate (query_id, video_id, score)."""
    best = fused.groupBy("query_id").agg(F.max_by("video_id", F.struct("score", -F.col("pos"))).alias("video_id"))
    return pools.join(best, ["query_id", "video_id"], "left_semi")


def top(pools: DataFrame, n: int = TOP) -> DataFrame:
    w = Window.partitionBy("query_id", "event_index").orderBy(F.desc("score"), "pos")
    return pools.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _candidates(pools: DataFrame) -> DataFrame:
    """query_id and events: for each event, in order, its candidates by rank.  Queries that lack an event's candidates are left out."""
    c = F.struct("rank", "frame_id", "timestamp_ms", "score")
    by_event = top(pools).groupBy("query_id", "event_index").agg(F.array_sort(F.collect_list(c)).alias("c"))
    out = by_event.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("event_index", "c"))).alias("e"), F.max("event_index").alias("last"))
    return out.where(F.size("e") == F.col("last") + 1).select("query_id", F.transform("e", lambda x: x["c"]).alias("events"))


def best_path(events: Column, compat: bool = False) -> Column:
    """The candidates, one an event, of non-decreasing times and the highest sum; the first of equals.  Null without any.

    Paths grow by an event at a time: a candidate continues the best path that ends no later.  compat: a candidate that
    continues none begins a path of its own; if that wins in the end, it is too short, and there is none.
    """
    start = lambda c: F.struct(c["score"].alias("sum"), c["timestamp_ms"].alias("t"), F.array(c).alias("path"))

    def grown(paths: Column, event: Column) -> Column:
        def continued(c: Column) -> Column:
            before = F.transform(paths, lambda p, i: F.when(p["t"] <= c["timestamp_ms"], F.struct((p["sum"] + c["score"]).alias("sum"), (-i).alias("first"), F.concat(p["path"], F.array(c)).alias("path"))))
            best = F.array_max(before)
            own = start(c) if compat else F.lit(None)
            return F.when(best.isNotNull(), F.struct(best["sum"].alias("sum"), c["timestamp_ms"].alias("t"), best["path"].alias("path"))).otherwise(own)

        return F.filter(F.transform(event, continued), lambda p: p.isNotNull())

    ends = F.aggregate(F.slice(events, F.lit(2), F.size(events)), F.transform(F.get(events, F.lit(0)), start), grown)
    best = F.array_max(F.transform(ends, lambda p, i: F.struct(p["sum"].alias("sum"), (-i).alias("first"), p["path"].alias("path"))))
    return F.when(F.size(best["path"]) == F.size(events), best["path"])


def greedy_path(events: Column) -> Column:
    """Each event's best candidate, or, where that is before the event ahead, the first candidate that isn't (if any)."""

    def grown(path: Column, event: Column) -> Column:
        at, best = F.element_at(path, -1)["timestamp_ms"], F.get(event, F.lit(0))
        later = F.get(F.filter(event, lambda c: c["timestamp_ms"] >= at), F.lit(0))
        return F.concat(path, F.array(F.when(best["timestamp_ms"] >= at, best).otherwise(F.coalesce(later, best))))

    return F.aggregate(F.slice(events, F.lit(2), F.size(events)), F.array(F.get(F.get(events, F.lit(0)), F.lit(0))), grown)


def align(pools: DataFrame, compat: bool = False, method: str = "auto") -> DataFrame:
    """The hypothesis of each query: by the best path, else greedily."""
    found = _candidates(pools)
    found = found.withColumn("dp", best_path(F.col("events"), compat) if method in ("auto", "dp") else F.lit(None))
    if method in ("auto", "greedy"):
        path, name = F.coalesce(F.col("dp"), greedy_path(F.col("events"))) if method == "auto" else greedy_path(F.col("events")), F.when(F.col("dp").isNotNull(), "dp").otherwise("greedy")
    else:
        path, name = F.col("dp"), F.lit("dp")
    out = found.select("query_id", name.alias("method"), F.posexplode(path).alias("event_index", "c"))
    return out.select("query_id", F.col("event_index").cast("long").alias("event_index"), F.col("c.frame_id").cast("long").alias("frame_id"), F.col("c.timestamp_ms").cast("long").alias("timestamp_ms"), F.col("c.score").cast("double").alias("score"), "method")


def best_sum(pools: DataFrame, events: int) -> DataFrame:
    """(query_id, score): the highest sum over non-decreasing sequences, by one join an event; the candidates of a query
    are bounded by top()."""
    p = top(pools)
    state = p.where("event_index = 0").select("query_id", F.col("timestamp_ms").alias("t"), "score")
    for k in range(1, events):
        step = p.where(F.col("event_index") == k).select("query_id", F.col("timestamp_ms").alias("u"), F.col("score").alias("s"))
        state = state.join(step, "query_id").where("t <= u").groupBy("query_id", "u", "s").agg(F.max("score").alias("best")).select("query_id", F.col("u").alias("t"), (F.col("best") + F.col("s")).alias("score"))
    return state.groupBy("query_id").agg(F.max("score").alias("score"))


def hypotheses(aligned: DataFrame) -> DataFrame:
    """(query_id, frames, aggregate score, whether frames strictly increase)."""
    out = aligned.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("event_index", "frame_id"))).alias("f"), F.sum("score").alias("aggregate_score"), F.first("method").alias("method"))
    frames = F.transform("f", lambda x: x["frame_id"])
    return out.select("query_id", frames.alias("frames"), "aggregate_score", "method").withColumn("valid", (F.size("frames") >= 2) & F.forall(F.zip_with(F.slice("frames", F.lit(1), F.size("frames") - 1), F.slice("frames", F.lit(2), F.size("frames") - 1), lambda a, b: a < b), lambda x: x))
