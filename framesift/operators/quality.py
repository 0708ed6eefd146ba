"""Data-quality rules: each gives issue rows (severity, rule, key), and a report sums them up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("P0", "P1", "P2")


def issues(rows: DataFrame, severity: str, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def duplicates(rows: DataFrame, keys: list[str], severity: str = "P0", rule: str = "duplicate key") -> DataFrame:
    return issues(rows.groupBy(*keys).count().where("count > 1"), severity, rule, F.concat_ws("/", *keys))


def orphans(rows: DataFrame, parents: DataFrame, on: list[str], severity: str = "P0", rule: str = "unknown reference") -> DataFrame:
    """Rows whose reference has no parent."""
    return issues(rows.join(parents.select(*on).distinct(), on, "left_anti"), severity, rule, F.concat_ws("/", *on))


def violations(rows: DataFrame, good: Column, key: Column, severity: str = "P1", rule: str = "constraint") -> DataFrame:
    """Rows for which the constraint is not true (null counts as a violation)."""
    return issues(rows.where(~F.coalesce(good, F.lit(False))), severity, rule, key)


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], severity: str = "P0", rule: str = "values differ") -> DataFrame:
    """Keys of left whose columns differ from right's, or that right lacks."""
    r = right.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns), F.col("__there").isNull())
    return issues(left.join(r, keys, "left").where(differs), severity, rule, F.concat_ws("/", *keys))


def key_sets_differ(left: DataFrame, right: DataFrame, keys: list[str], severity: str = "P0", rule: str = "key sets differ") -> DataFrame:
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return issues(a.exceptAll(b).unionByName(b.exceptAll(a)), severity, rule, F.concat_ws("/", *keys))


def several_runs(rows: DataFrame, column: str = "preprocess_run_id") -> DataFrame:
    """An issue if a table has more than one run (or none)."""
    return issues(rows.agg(F.countDistinct(column).alias("n")).where("n <> 1"), "P0", "not exactly one run", F.col("n"))


def duration_gap(audio: Column, video: Column, floor_ms: int = 1500, share: float = 0.02) -> Column:
    """Whether audio and video durations agree within max(floor, share)."""
    return F.abs(audio - video) <= F.greatest(F.lit(float(floor_ms)), video * share)


def pts_agree(pts: Column, numerator: Column, denominator: Column, timestamp_ms: Column, origin_ms: Column, tolerance: int = 2) -> Column:
    return F.abs(pts * numerator * 1000 / denominator - origin_ms - timestamp_ms) <= tolerance


def unit_box(b: Column) -> Column:
    return (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= 1) & (b["y2"] <= 1) & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])


def closed_interval(start: Column, end: Column) -> Column:
    return (start >= 0) & (end >= start)


def sha256_hex(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def both_or_neither(a: Column, b: Column) -> Column:
    return a.isNull() == b.isNull()


def report(found: list[DataFrame]) -> DataFrame:
    """Counts by severity and the gate: no P0."""
    every = reduce(DataFrame.unionByName, found)
    return every.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES)).withColumn("gate", F.col("p0") == 0)


def by_rule(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).groupBy("severity", "rule").agg(F.count("*").alias("n"))


def stable_eligible(report_row: DataFrame, statuses: DataFrame) -> DataFrame:
    """Whether a run passes the gate with every module completed or disabled."""
    done = statuses.agg(F.bool_and(F.col("status").isin("completed", "disabled")).alias("done"))
    return report_row.join(F.broadcast(done), F.lit(True)).select("gate", "done", (F.col("gate") & F.coalesce("done", F.lit(False))).alias("eligible"))


def counts_match(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Row counts of tables against a manifest (name, n)."""
    got = reduce(DataFrame.unionByName, (t.agg(F.lit(name).alias("name"), F.count("*").alias("found")) for name, t in tables.items()))
    return got.join(manifest, "name", "full").withColumn("ok", F.col("found").eqNullSafe(F.col("n")))
