"""Ranked-retrieval metrics, error rates and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CUTOFFS = (1, 5, 20, 50, 100)


def first_relevant(queries: DataFrame, ranking: DataFrame, relevant: DataFrame, item: str = "video_id") -> DataFrame:
    """The least rank of a relevant item for each query; null without any."""
    met = ranking.join(relevant.select("query_id", item).distinct(), ["query_id", item], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(met, "query_id", "left")


def hit_and_mrr(first: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """hit_at_k for each cutoff and mrr, a query without a hit counting 0."""
    return first.agg(F.count("*").alias("n_queries"), *(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in cutoffs), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def final_score(first: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Mean of the recall flags at the cutoffs, over queries."""
    flags = sum((F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0)) for k in cutoffs), F.lit(0.0))
    return first.agg(F.avg(flags / len(cutoffs)).alias("final_score"))


def frame_hits(ranking: DataFrame, relevant: DataFrame, cutoffs=(1, 5, 20)) -> DataFrame:
    """Share of the queries with relevant frames that have one among their first k."""
    asked = relevant.select("query_id").distinct()
    met = ranking.join(relevant.select("query_id", "video_id", "frame_id").distinct(), ["query_id", "video_id", "frame_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return asked.join(met, "query_id", "left").agg(*(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in cutoffs))


def character_error_rate(pairs: DataFrame) -> DataFrame:
    """pairs (key, expected, actual): summed edit distance over summed length (each at least 1)."""
    return pairs.agg((F.sum(F.levenshtein("expected", "actual")) / F.sum(F.greatest(F.lit(1), F.length("expected")))).alias("cer"))


def word_error_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg((F.sum(T.word_errors(F.col("expected"), F.col("actual"))) / F.sum(F.greatest(F.lit(1), F.size(T.tokens(F.col("expected")))))).alias("wer"))


def interval_hits(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """selected (run, query_id, rank, video_id, timestamp_ms) against labelled intervals: hit rate at 1 and 5 by run."""
    inside = selected.join(labels, ["query_id", "video_id"]).where(F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms"))).groupBy("run", "query_id").agg(F.min("rank").alias("first_rank"))
    all_of = selected.select("run", "query_id").distinct()
    return all_of.join(inside, ["run", "query_id"], "left").groupBy("run").agg(*(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in (1, 5)))


def latency_delta(runs: DataFrame, baseline: str, refined: str) -> DataFrame:
    """runs (run, query_id, latency_ms): nearest-rank p50 and p95 of each and their differences."""
    at = lambda run, p: F.expr(f"percentile_disc({p}) within group (order by case when run = '{run}' then latency_ms end)")
    out = runs.agg(*(at(r, p).alias(f"{name}_p{int(p * 100)}") for r, name in ((baseline, "baseline"), (refined, "refined")) for p in (0.5, 0.95)))
    return out.withColumns({f"delta_p{p}": F.col(f"refined_p{p}") - F.col(f"baseline_p{p}") for p in (50, 95)})


def latency_summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Nearest-rank p50, p95 and p99 (the value at ceil(p * n)), median, mean, max and count."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return rows.groupBy(*(keys or [])).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def cohort_samples(samples: DataFrame, cohorts=("feedback", "no_feedback")) -> DataFrame:
    """Sorted elapsed times of each cohort; both cohorts are always there."""
    dim = samples.sparkSession.createDataFrame([(c,) for c in cohorts], "cohort string")
    got = samples.groupBy("cohort").agg(F.array_sort(F.collect_list("elapsed_ms")).alias("samples"))
    return dim.join(got, "cohort", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<bigint>")))
