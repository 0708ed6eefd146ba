"""Seams for models: rows go in by batches, rows come out; a failing item fails alone.

An adapter is a callable of a list of row dicts that returns, for each, a list of result dicts (or a vector or score).  It is
pickled to the executors and may load its model on its first call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import pending


def _columns(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema).fields]


def run(rows: DataFrame, adapter: Callable[[list[dict]], list[list[dict]]], schema: str, keys: list[str], batch: int = 32) -> DataFrame:
    """Results (keys, schema) with status and error: one row a result, one row with status failed for an item that fails.

    A batch that fails, or gives a wrong number of answers, is tried item by item.
    """
    fields = _columns(schema)
    key_schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def one(items: list[dict]) -> list[list[dict]]:
        out = adapter(items)
        if len(out) != len(items):
            raise ValueError(f"{len(out)} answers for {len(items)} items")
        return out

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = pdf.to_dict("records")
            for lo in range(0, len(items), batch):
                part, found = items[lo : lo + batch], []
                try:
                    answers = [(x, a, None) for x, a in zip(part, one(part), strict=True)]
                except Exception:  # whatever the model raises
                    answers = []
                    for x in part:
                        try:
                            answers.append((x, one([x])[0], None))
                        except Exception as e:
                            answers.append((x, None, f"{type(e).__name__}: {e}"))
                for x, answer, error in answers:
                    key = {k: x[k] for k in keys}
                    if error is not None:
                        found.append({**key, "status": "failed", "error": error})
                    found += [{**key, **{f: r.get(f) for f in fields}, "status": "ready", "error": None} for r in answer or []]
                yield pd.DataFrame(found, columns=[*keys, *fields, "status", "error"])

    return rows.mapInPandas(apply, f"{key_schema}, {schema}, status string, error string")


def resume(rows: DataFrame, cached: DataFrame, adapter, schema: str, keys: list[str], batch: int = 32) -> DataFrame:
    """As run, for rows whose key and fingerprint are not cached; cached results are taken over."""
    todo, reuse = pending(rows, cached.select(*keys, "fingerprint").distinct(), keys)
    done = run(todo, adapter, schema, keys, batch).join(rows.select(*keys, "fingerprint"), keys)
    kept = cached.join(reuse, [*keys, "fingerprint"], "left_semi")
    return kept.unionByName(done, allowMissingColumns=True)


def report(results: DataFrame, items: DataFrame, key: str = "video_id") -> DataFrame:
    """Counts for each video: items, results and failures."""
    n = items.groupBy(key).agg(F.count("*").alias("n_items"))
    r = results.groupBy(key).agg(F.count_if(F.col("status") == "ready").alias("n_results"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return n.join(r, key, "left").fillna(0, ["n_results", "n_failed"])


def summary(rows: DataFrame, reports: DataFrame, label: str = "canonical_label", low: str = "below_threshold") -> DataFrame:
    """One row over a modality's rows and its videos' reports (n_items, n_results, n_failed): counts, and rows by label."""
    sums = reports.agg(F.count("*").alias("n_videos"), *(F.sum(c).alias(c) for c in ("n_items", "n_results", "n_failed")))
    labels = rows.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(low)).alias("low"))
    counts = labels.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum("low"), F.lit(0)).alias("n_below_threshold"), F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("x"))
    return sums.join(counts, F.lit(True)).select("n_videos", "n_items", "n_results", "n_failed", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_below_threshold", F.map_from_entries("x").alias("label_counts"))


def consolidated(rows: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """A modality's rows of all videos, or of those accepted (video_id)."""
    return rows if accepted is None else rows.join(accepted.select("video_id").distinct(), "video_id", "left_semi")


def vectors(rows: DataFrame, column: str, encoder: Callable[[list], list[list[float]]], out: str = "embedding") -> DataFrame:
    """rows with the vector that an encoder gives for a column's values, L2-normalised."""
    from ..functions.scalars import unit

    def encode(x: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in e] for e in encoder(list(x))])

    encode.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return rows.withColumn(out, unit(F.pandas_udf(encode, T.ArrayType(T.DoubleType()))(F.col(column))))


def scores(rows: DataFrame, column: str, scorer: Callable[[list], list[float]], out: str = "visual_score") -> DataFrame:
    def score(x: pd.Series) -> pd.Series:
        return pd.Series([float(v) for v in scorer(list(x))])

    score.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return rows.withColumn(out, F.pandas_udf(score, T.DoubleType())(F.col(column)))
