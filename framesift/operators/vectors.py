"""Exact nearest neighbours by inner product, several models, and composed queries."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import fusion

# Defaults of search and feedback.
CANDIDATES, POOL, ALPHA = 200, 500, 0.75
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096


def checked(vectors: DataFrame, dim: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """vectors (vec_id, embedding) that are finite, of one size and of unit length; else an error."""
    v = F.col("embedding")
    good = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (F.abs(S.norm(v) - 1) <= tolerance)
    if dim:
        good &= F.size(v) == dim
    return vectors.withColumn("embedding", F.when(good, v).otherwise(F.raise_error(F.lit("a vector is not finite, of the size or of unit length")).cast(vectors.schema["embedding"].dataType)))


def faults(vectors: DataFrame, dim: int, tolerance: float = 1e-4) -> DataFrame:
    """Rows that fail a check, with the first reason."""
    v = F.col("embedding")
    reason = F.when(v.isNull(), "missing").when(F.size(v) != dim, "size").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.abs(S.norm(v) - 1) > tolerance, "not of unit length")
    return vectors.select("vec_id", reason.alias("fault")).where("fault is not null")


def nearest(vectors: DataFrame, query, k: int, id_column: str = "vec_id") -> DataFrame:
    """The k vectors of highest inner product with a query Column or list; ties by id."""
    q = query if not isinstance(query, list) else F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_column, S.dot(F.col("embedding"), S.unit(q)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """For a set of queries (query_id, q), the k nearest of each: a local top k in each scan task, then by query.

    The queries are counted and go in blocks of about block rows, which bounds what is broadcast whatever their number;
    scoring stays in the scan, and only k rows a query and task are shuffled.  A task multiplies matrices; what may be among
    the k nearest by that is scored again as S.dot does, in the order of the dimensions, so equal vectors tie.
    """
    context = vectors.sparkSession.sparkContext
    n = max(1, math.ceil(queries.count() / block))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("similarity", DoubleType())])
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def top(part: DataFrame) -> DataFrame:
        asked = context.broadcast(part.select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow())
        scored = doubles.mapInArrow(functools.partial(_local_nearest, asked, k), schema)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    return functools.reduce(DataFrame.unionByName, (top(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)) for i in range(n)))


#: Queries and vectors of one matrix of products.
TILE = (512, 4096)


def _matrix(lists, dim: int):
    """Rows of dim doubles, and which lists are that: not null, of this size, without nulls; the others are rows of 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
    own = lists.filter(pa.array(good)).flatten()
    filled = np.zeros((len(lists), dim))
    filled[good] = np.asarray(pc.fill_null(own, 0.0)).reshape(int(good.sum()), dim)
    if own.null_count:
        holes = np.zeros((len(lists), dim), bool)
        holes[good] = np.asarray(own.is_null()).reshape(int(good.sum()), dim)
        good &= ~holes.any(axis=1)
    return filled, good


def _local_nearest(asked, k: int, batches):
    """Of a task's vectors, the k first of each query by similarity (nulls last, NaN first) and id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    queries = asked.value
    sizes = np.asarray(pc.fill_null(pc.list_value_length(queries["q"]), -1))
    groups = [(dim, np.flatnonzero(sizes == dim), *_matrix(queries["q"].filter(pa.array(sizes == dim)), max(dim, 0))) for dim in np.unique(sizes)]
    tiles = [(dim, rows[i : i + TILE[0]], q[i : i + TILE[0]], fine[i : i + TILE[0]]) for dim, rows, q, fine in groups for i in range(0, len(rows), TILE[0])]
    best = [None] * len(tiles)
    types = None
    for batch in batches:
        types = batch.schema.field("vec_id").type
        for start in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(start, TILE[1])
            ids = part.column("vec_id")
            ids = np.array([*ids.to_pylist(), None], object)[:-1] if ids.null_count else ids.to_numpy(zero_copy_only=False)
            known = {}
            for at, (dim, _, q, fine) in enumerate(tiles):
                if dim not in known:
                    known[dim] = _matrix(part.column("embedding"), max(dim, 0))
                new = _tile_nearest(*known[dim], ids, q, fine & (dim >= 0), k)
                best[at] = new if best[at] is None else _first(*(np.concatenate(x) for x in zip(best[at], new, strict=True)), k)
    for (_, rows, _, _), found in zip(tiles, best, strict=True):
        if found is not None:
            q, kind, score, ids = found
            yield pa.RecordBatch.from_arrays([queries["query_id"].take(pa.array(rows[q])).combine_chunks(), pa.array(ids, type=types), pa.array(score, mask=kind == 0)], names=["query_id", "vec_id", "similarity"])


def _tile_nearest(x, good, ids, q, fine, k: int):
    with np.errstate(all="ignore"):
        near = q @ x.T
        near[np.isnan(near)] = np.inf
        near[:, ~good], near[~fine] = -np.inf, -np.inf
        # twice what rounding can make of two orders of a sum
        slack = 4 * max(q.shape[1], 1) * np.finfo(float).eps * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0))
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(q), -np.inf)
        least = np.where(np.isfinite(slack), least - slack, -np.inf)
        at, of = np.nonzero(near >= least[:, None])
        score = np.zeros(len(at))
        for d in range(q.shape[1]):
            score += x[of, d] * q[at, d]
    kind = np.where(good[of] & fine[at], np.where(np.isnan(score), 2, 1), 0)
    return _first(at, kind, np.where(kind == 1, score, np.where(kind == 2, np.nan, 0.0)), ids[of], k)


def _first(q, kind, score, ids, k: int):
    """The first k of each query: by kind, score and id."""
    places = ids
    if ids.dtype == object:  # strings, or with nulls, which come first
        none = np.array([i is None for i in ids], bool)
        places = np.full(len(ids), -1)
        places[~none] = np.unique(ids[~none], return_inverse=True)[1]
    order = np.lexsort((places, -np.nan_to_num(score, nan=0.0, posinf=np.inf, neginf=-np.inf), -kind, q))
    sorted_q = q[order]
    first = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    kept = order[rank < k]
    return q[kept], kind[kept], score[kept], ids[kept]


def multi_model(models: dict[str, DataFrame], queries: dict[str, list[float]], limit: int, candidates: int = CANDIDATES) -> tuple[DataFrame, bool]:
    """hits of each model that has vectors and a query of their size, fused by frame; and whether a model was left out.

    Each model's table: vec_id, video_id, frame_id, timestamp_ms, embedding.
    """
    parts, used = [], 0
    for name, table in models.items():
        head = table.select(F.size("embedding").alias("d")).first()
        if name not in queries or head is None or head["d"] != len(queries[name]):
            continue
        used += 1
        hits = nearest(table, queries[name], max(limit, candidates)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))
        parts.append(hits.join(table.select("vec_id", "video_id", "frame_id"), "vec_id").withColumn("model", F.lit(name)))
    if not parts:
        raise ValueError("no model can answer the query")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return fusion.by_identity(hits).orderBy(*fusion.identity_order()).limit(limit), used < len(models)


def mean_vector(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The normalised mean of the vectors of each group."""
    long = vectors.select(*keys, F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(*keys).agg(S.unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])).alias("embedding"))


def feedback_pool(models: dict[str, DataFrame], size: int = POOL) -> DataFrame:
    """The fused candidates of the first size hits of each model's ranking (vec_id, video_id, frame_id, rank): only frames
    that every model has, ranks contiguous, with each model's vec_id."""
    hits = None
    for name, ranked in models.items():
        part = ranked.where(F.col("rank") <= size).select(F.lit(name).alias("model"), "vec_id", "video_id", "frame_id", "rank", F.col("similarity"))
        hits = part if hits is None else hits.unionByName(part)
    refs = hits.groupBy("video_id", "frame_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "vec_id")))).alias("refs"), F.countDistinct("model").alias("m")).where(F.col("m") == len(models)).drop("m")
    fused = fusion.by_identity(hits).join(refs, ["video_id", "frame_id"])
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(*fusion.identity_order())))


def rerank(pool: DataFrame, queries: dict[str, tuple[list[float], list[float]]], alpha: float = ALPHA) -> DataFrame:
    """pool (model, video_id, frame_id, embedding) by composed queries (text, image) of each model, fused late."""
    composed = None
    for name, (text, image) in queries.items():
        row = pool.sparkSession.range(1).select(F.lit(name).alias("model"), S.blend(F.array(*map(F.lit, text)), F.array(*map(F.lit, image)), alpha).alias("q"))
        composed = row if composed is None else composed.unionByName(row)
    scored = pool.join(F.broadcast(composed), "model").withColumn("score", S.dot(F.col("embedding"), F.col("q")))
    w = Window.partitionBy("model").orderBy(F.desc("score"), "video_id", "frame_id")
    return fusion.complete_late(scored.withColumn("rank", F.row_number().over(w)), len(queries)).orderBy(F.desc("score"), "video_id", "frame_id")
