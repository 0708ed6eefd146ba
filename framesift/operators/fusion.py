"""Reciprocal-rank fusion, diversity and caps over ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import in_order

# Constants of fusion.
RRF_K, DEDUP_MS, SOFT_WEIGHT, PER_VIDEO = 60, 1000, 0.5, 5
SOFT_BRANCHES = ("object", "metadata")


def by_identity(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """hits (model, video_id, frame_id, rank, similarity) fused by frame: the sum of 1 / (k + rank), with each model's score
    and rank; ordered by score, number of models, video, frame."""
    out = hits.groupBy("video_id", "frame_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"),
        F.count("*").alias("n_models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "similarity")))).alias("model_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.col("rank").cast("long"))))).alias("model_ranks"),
    )
    return out


def identity_order():
    return [F.desc("rrf_score"), F.desc("n_models"), F.asc("video_id"), F.asc("frame_id")]


def by_bucket(hits: DataFrame, k: int = RRF_K, width: int = DEDUP_MS, soft: float = SOFT_WEIGHT) -> DataFrame:
    """hits (branch, branch_pos, pos, video_id, frame_id, timestamp_ms, rank) fused by video and time bucket: soft branches
    weigh less; the row of least rank (then branch, then position) stands for the bucket."""
    weight = F.when(F.col("branch").isin(*SOFT_BRANCHES), soft).otherwise(1.0)
    first = F.struct("rank", "branch_pos", "pos")
    return hits.withColumn("bucket", F.floor(F.col("timestamp_ms") / width)).groupBy("video_id", "bucket").agg(
        F.sum(weight / (k + F.col("rank"))).alias("score"),
        F.min_by(F.struct("frame_id", "timestamp_ms"), first).alias("r"),
        F.array_sort(F.collect_set("branch")).alias("branches"),
        F.min(F.struct("branch_pos", "pos")).alias("seen"),
    ).select("video_id", "bucket", "score", "r.frame_id", "r.timestamp_ms", "branches", "seen")


def bucket_order():
    return [F.desc("score"), F.asc("seen")]


def complete_late(rankings: DataFrame, models: int = 4, k: int = RRF_K) -> DataFrame:
    """Fusion of complete rankings: each of models must rank each id exactly once; else an error."""
    out = rankings.groupBy("video_id", "frame_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("n"), F.countDistinct("model").alias("m"))
    ok = (F.col("n") == models) & (F.col("m") == models)
    return out.withColumn("score", F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("a model lacks or repeats an id")).cast("double"))).select("video_id", "frame_id", "score")


def cap_per_video(ranked: DataFrame, cap: int = PER_VIDEO, order=None, limit: int = 100) -> DataFrame:
    """At most cap rows a video in the given order, ranked anew."""
    order = order or [F.desc("score"), F.asc("pos")]
    kept = ranked.withColumn("__v", F.row_number().over(Window.partitionBy("video_id").orderBy(*order))).where(F.col("__v") <= cap).drop("__v")
    top = kept.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of limit rows


def suppress_near(ranked: DataFrame, window: int = DEDUP_MS) -> DataFrame:
    """ranked (query_id, video_id, frame_id, timestamp_ms, rank) without frames within window of a better one kept."""

    columns = ["query_id", "video_id", "frame_id", "timestamp_ms", "rank"]
    far = lambda kept, r: F.forall(kept, lambda k: F.abs(k["timestamp_ms"] - r["timestamp_ms"]) > window)
    rows = in_order(ranked.select(*columns), ["query_id", "video_id"], ["rank"])
    kept = F.aggregate("rows", F.filter("rows", lambda r: F.lit(False)), lambda kept, r: F.when(far(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return rows.select("query_id", "video_id", F.explode(kept).alias("r")).select("query_id", "video_id", "r.frame_id", "r.timestamp_ms", "r.rank")


def round_robin(ranked: DataFrame, limit: int) -> DataFrame:
    """One frame of each video in turn, videos by their best rank, ranked anew within a query."""
    w = Window.partitionBy("query_id", "video_id").orderBy("rank")
    turn = ranked.withColumns({"__turn": F.row_number().over(w), "__first": F.min("rank").over(Window.partitionBy("query_id", "video_id"))})
    return turn.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("__turn", "__first"))).where(F.col("new_rank") <= limit).drop("__turn", "__first")


def diversify(ranked: DataFrame, limit: int, window: int = DEDUP_MS) -> DataFrame:
    return round_robin(suppress_near(ranked, window), limit)
