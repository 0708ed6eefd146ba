"""Shared helpers: durable intermediate tables, word hashing over Arrow buffers, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- durable tables

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only on one machine where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = getattr(shared_dir, "fallback", None) or tempfile.mkdtemp(prefix="framesift-")
        shared_dir.fallback = base
    return base.rstrip("/") + "/framesift"


def durable(df: DataFrame, name: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that a lost executor costs no recomputation.

    No dictionary is tried for the columns in plain: those of hashes have too many values for one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._framesift_path = path
    return out


def temporary(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the interpreter ends."""
    _written.append((spark, path))
    return path


def release(df: DataFrame | None) -> None:
    """Delete a durable table that no later plan reads."""
    path = getattr(df, "_framesift_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def named_rows(documents: DataFrame) -> tuple[DataFrame, Column, Column]:
    """documents, and two numbers that name a row however a scan is split and whatever executors are alive: a hash of its
    file and its place in it.  What isn't a plain read of Parquet files is written as such first."""
    for written in (False, True):
        try:
            meta = documents.metadataColumn("_metadata")
            file, place = F.xxhash64(meta["file_path"]), meta["row_index"]
            documents.select(file, place)  # not analysed before
            return documents, file, place
        except AnalysisException:
            if written:
                raise
            documents = durable(documents, "rows")


#: Bits of a filter over hashes.  It never grows, so its FILTER_BITS / 64 rows can be broadcast; a full one lets more rows through.
FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame, hashed: str) -> DataFrame:
    """(__word, __bits): a bit for each hash in keys, to be joined by same_word and has_bit."""
    at = F.pmod(F.col(hashed), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(hashed), F.lit(64)).cast("int"))
    words = keys.select(F.shiftright(at, 6).alias("__word"), bit.alias("__bits"))
    return F.broadcast(words.groupBy("__word").agg(F.bit_or("__bits").alias("__bits")))


def same_word(hashed: str) -> Column:
    return F.shiftright(F.pmod(F.col(hashed), F.lit(FILTER_BITS)), 6) == F.col("__word")


def has_bit(hashed: str) -> Column:
    """Whether a row joined with its word of a filter (null where there is none) may be among the filter's keys."""
    return F.coalesce(F.getbit(F.col("__bits"), F.pmod(F.col(hashed), F.lit(64)).cast("int")), F.lit(0)) == 1


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            if spark._jsc.sc().isStopped():
                return
            _remove(spark, path)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


# ---------------------------------------------------------------- workers


def lean(run: Callable) -> Callable:
    """run, a function of batches, which gives its memory back when its task ends: Spark keeps the worker for later tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return task


#: Rows of an Arrow batch: whole texts are in it, which the JVM holds outside its heap, and never gives back.
BATCH_ROWS = 2500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, in batches of BATCH_ROWS rows at most (a setting of the session, which this lowers) and lean."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return df.mapInArrow(lean(run), schema)


# ---------------------------------------------------------------- words of a batch of texts

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SLICE = 1 << 19  # bytes hashed at once; bounds the working memory whatever the batch or the text size

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_pow_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _pow_cache.get(base)
    if got is None or len(got) < n:
        got = _pow_cache[base] = _powers(base, max(n, _SLICE + 1024))
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SLICE) -> list[tuple[int, int]]:
    """Ranges of texts of about limit bytes each (one text at least)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs without ASCII white space, and the number of words up to each text (n + 1)."""
    inside = ~SPACE[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of words; lower folds A-Z."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _SLICE, "right")))
        size = int(ends[j - 1]) - at
        with np.errstate(over="ignore"):
            total = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(table[raw[at : at + size]] * powers(_BASE, size), out=total[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((total[b] - total[a]) * powers(_INVERSE, size)[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (the last k - 1 positions have none)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
    return mix(out)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds over DataFrames; each round is a durable table, and the driver
    sees only a count and a checksum of a round.  Stars are pre-aggregated before their shuffle.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, state = durable(edges, "edges"), None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = durable(small, "edges")
        release(current)
        current = after
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
