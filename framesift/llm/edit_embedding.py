"""Document fingerprints by a randomised edit embedding.

A pointer walks through the characters of a text: at step j it emits the character it stands on and moves on by a random
bit that step and character determine.  All texts share the bits, so texts at a small edit distance give sequences at a
small Hamming distance.  Positions of the sequence are sampled by a shared nested rule: level r holds the positions whose
random value has r trailing zero bits, and a text takes the finest level at which at most MOST positions stay.  The
fingerprint is the level and, for each position, a 4-bit hash of what was emitted there.  Fingerprints of any two levels
compare at the coarser one; their likeness is the share of equal positions, corrected for chance.

Candidates for near copies come from bands of sampled bits, and are verified by their likeness.

Null texts count as empty; an empty text's fingerprint is that of no characters and is like another empty one's only.  Texts
of any length are walked whole.  Repeated rows have equal fingerprints.  Other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, mapped, mix, release

#: Sampled positions of a fingerprint, at most.
MOST = 128
#: Texts that are left over below which each is walked through on its own.
FEW = 30
#: Bits of a character's class by which the shared table is read; steps after which the table repeats.
_CLASS, _PERIOD = 64, 1 << 16
_BITS = mix(np.arange(1, _PERIOD + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_folded = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567))
_KIND, _SYMBOL = (_folded % np.uint64(_CLASS)).astype(np.uint8), ((_folded >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)
_WIDE = 1 << 22  # characters walked through together


def _level(j: np.ndarray) -> np.ndarray:
    """Trailing zeros of a step's random value."""
    v = mix(j.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))
    low = v & (~v + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)).astype(np.int64)


_levels = _level(np.arange(1 << 16))


def levels(n: int) -> np.ndarray:
    global _levels
    if len(_levels) < n:
        _levels = _level(np.arange(max(n, 2 * len(_levels))))
    return _levels[:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts given as code points, walked through side by side."""
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total < _WIDE):
            group.append(order[at])
            total += len(texts[order[at]])
            at += 1
        for i, f in zip(group, _walk([texts[i] for i in group]), strict=True):
            out[i] = f
    return out


def _walk(texts: list[np.ndarray]) -> list[str]:
    """texts by falling length."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(1, np.uint32)])
    kind, symbol = _KIND[flat], _SYMBOL[flat]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    stop = first + size
    steps = 3 * int(size[0]) if len(size) else 0
    level = levels(steps + 1)
    # a text of n characters takes about 2 n steps; the finest level it may need leaves some MOST / 2 of them
    finest = np.maximum(0, np.ceil(np.log2(np.maximum(2 * size, 1) / MOST)).astype(np.int64))
    live = int(np.count_nonzero(size))
    alive = np.arange(live)
    pos, halt = first[:live].copy(), stop[:live]
    limit = 3 * size
    got: list[list[np.ndarray]] = []  # texts, step and symbols of sampled steps
    coarsest = int(finest[-1]) if len(finest) else 0
    j = 0
    while len(alive) > FEW:
        k = kind[pos]
        if level[j] >= coarsest:
            got.append([alive, np.int64(j), symbol[pos]])
        pos = pos + ((_BITS[j % _PERIOD] >> k) & np.uint64(1)).astype(np.int64)
        j += 1
        on = pos < halt
        on &= j < limit[alive]
        if not on.all():
            alive, pos, halt = alive[on], pos[on], halt[on]
    single: dict[int, tuple[list[int], list[int]]] = {}
    if len(alive):
        bits, lev = _BITS.tolist(), level.tolist()
        for a, p, h in zip(alive.tolist(), pos.tolist(), halt.tolist(), strict=True):
            kinds, marks, base, step, most, fine = kind[p:h].tobytes(), symbol[p:h].tobytes(), 0, j, int(limit[a]), int(finest[a])
            n, where, what = h - p, [], []
            while base < n and step < most:
                if lev[step] >= fine:
                    where.append(step)
                    what.append(marks[base])
                base += bits[step % _PERIOD] >> kinds[base] & 1
                step += 1
            single[a] = (where, what)
    if got:
        who = np.concatenate([g[0] for g in got])
        when = np.repeat(np.array([g[1] for g in got]), [len(g[0]) for g in got])
        what = np.concatenate([g[2] for g in got])
        fine = level[when] >= finest[who]
        who, when, what = who[fine], when[fine], what[fine]
        by = np.argsort(who, kind="stable")
        who, when, what = who[by], when[by], what[by]
        bound = np.searchsorted(who, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = (int(bound[i]), int(bound[i + 1])) if got else (0, 0)
        w, s = when[a:b] if got else np.zeros(0, np.int64), what[a:b] if got else np.zeros(0, np.uint8)
        if i in single:
            w, s = np.concatenate([w, np.array(single[i][0], np.int64)]), np.concatenate([s, np.array(single[i][1], np.uint8)])
        r = int(finest[i])
        lw = level[w]
        while np.count_nonzero(lw >= r) > MOST:
            r += 1
        keep = lw >= r
        s = s[keep]
        out.append(f"{r:02x}" + s.tobytes().hex()[1::2])
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: share of equal sampled positions at the coarser of the two levels, corrected for chance."""
    if a == b:
        return 1.0
    if len(a) <= 2 or len(b) <= 2:
        return 0.0
    r = max(int(a[:2], 16), int(b[:2], 16))
    x, y = _coarsen(a, r), _coarsen(b, r)
    n, m = max(len(x), len(y)), min(len(x), len(y))
    if not m:
        return 0.0
    equal = sum(p == q for p, q in zip(x, y, strict=False)) / n
    return max(0.0, min(1.0, (equal - _CHANCE) / (1 - _CHANCE)))


#: Equal 4-bit symbols of unlike prose, as its characters are not evenly spread.
_CHANCE = 1 / 10
_kept: dict[int, np.ndarray] = {}


def _coarsen(f: str, r: int) -> str:
    own, body = int(f[:2], 16), f[2:]
    if own == r:
        return body
    if own not in _kept or len(_kept[own]) < len(body):
        n = (1 << own) * MOST * 4 + 64
        lv = levels(n)
        _kept[own] = lv[lv >= own]
    return "".join(c for c, v in zip(body, _kept[own].tolist(), strict=False) if v >= r)


# ---------------------------------------------------------------- documents


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, as texts are held as Python strings."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the next document's text by falling doc_id (after the last: the first)."""
    return _placed(documents).mapInArrow(_pairs, "doc_id long, text string, next_text string")


def _keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of parts partitions a number that Spark's repartition deals to it, so that each range has a task of its own."""
    found: dict[int, int] = {}
    size = 16 * parts
    while len(found) < parts:
        rows = spark.range(size).select(F.pmod(F.hash("id"), F.lit(parts)).alias("part"), "id").groupBy("part").agg(F.min("id").alias("id")).collect()
        found, size = {r["part"]: r["id"] for r in rows}, 4 * size
    return [found[i] for i in range(parts)]


def _placed(documents: DataFrame) -> DataFrame:
    """Documents in ranges of falling doc_id, in their order, so that each one's next is behind it in its task.

    Texts go through one shuffle, by ranges of doc_id; each range also gets the first document of the range after it,
    of which there are as many as ranges.  Nulls in doc_id come last; ties go by text.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(documents.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or [])) if parts > 1 else []
    # range 0 holds the largest ids; nulls are in the last one.  A row's cuts are found by bisection.
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series((len(edges) - np.searchsorted(edges, ids.to_numpy(), "right")).astype(np.int32))

    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(range_of(F.coalesce("doc_id", F.lit(0)))))
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")).alias("head")).select("bucket", "head.doc_id", "head.text")
    heads = durable(heads, "heads")
    there = [r["bucket"] for r in heads.select("bucket").orderBy("bucket").collect()]  # one for each range at most
    before = dict(zip(there, [there[-1], *there[:-1]], strict=True)) if there else {}
    goes = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    moved = heads.withColumn("bucket", goes[F.col("bucket")]) if before else heads
    both = rows.withColumn("extra", F.lit(False)).unionByName(moved.withColumn("extra", F.lit(True)))
    keys = F.lit(np.array(_keys(spark, len(cuts) + 1), np.int64))
    return both.repartition(len(cuts) + 1, F.get(keys, "bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row before
    for b in _cut(batches):
        bucket, ids, texts, extra = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "doc_id", "text", "extra"))
        out: list[tuple] = []
        for k, i, t, e in zip(bucket, ids, texts, extra, strict=True):
            if held is not None and held[0] == k:
                out.append((held[1], held[2], t))
            held = None if e else (k, i, t)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "text", "next_text"])


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pairs(batches):
            lo, n = 0, b.num_rows
            texts, nexts = b.column(1).to_pylist(), b.column(2).to_pylist()
            while lo < n:
                hi, total = lo, 0
                while hi < n and total < _WIDE // 2:
                    total += len(texts[hi]) + len(nexts[hi])
                    hi += 1
                own = texts[lo:hi]
                edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(own, nexts[lo:hi], strict=True)]
                # each text is the one before's next one, but at the ends of a run
                all_texts = {*own, *edited, *nexts[lo:hi]}
                listed = list(all_texts)
                marks = dict(zip(listed, fingerprints([codes(t) for t in listed]), strict=True))
                f, g, h = ([marks[t] for t in x] for x in (own, edited, nexts[lo:hi]))
                sha = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in own], pa.int64()), pa.array(sha), pa.array(f), pa.array(g), pa.array([likeness(x, y) for x, y in zip(f, g, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(f, h, strict=True)], pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                lo = hi

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _placed(documents).transform(mapped, run, schema)


def near_links(marked: DataFrame, bands: int = 16, width: int = 8, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of documents (doc_id, fingerprint) whose fingerprints share a band and are verified as alike.

    Rows of one fingerprint form a class, named by its smallest doc_id, to which each is linked.  A class has bands at its own
    level and at the next coarser one, so that texts on both sides of a step in level meet.  A band's bucket is resolved in
    rounds: each class is compared with the bucket's smallest one, and those that aren't like it go on to the next round
    without it, until none is left.  A bucket of members that are alike gives as many pairs as members, not their square.
    """

    def keys(f: str) -> list[tuple[int, str]]:
        own = int(f[:2], 16)
        return [(k, f"{r:02x}:{body[k * width : (k + 1) * width]}") for r, body in ((own, f[2:]), (own + 1, _coarsen(f, own + 1))) for k in range(bands) if len(body) >= (k + 1) * width]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, f, k, key) for i, f in zip(*(b.column(c).to_pylist() for c in (0, 1)), strict=True) for k, key in keys(f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], ["a", "f", "band", "key"])

    marked = marked.where("doc_id is not null")
    named = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")
    members = marked.join(named.withColumnRenamed("doc_id", "a"), "fingerprint").where("a <> doc_id").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness")).distinct()
    left = durable(named.mapInArrow(cut, "a long, f string, band int, key string"), "bands")
    links = []

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = pa.array([likeness(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, near], [*b.schema.names, "likeness"])

    while True:
        lead = left.groupBy("band", "key").agg(F.min(F.struct("a", "f")).alias("lead"), F.count("*").alias("n")).where("n > 1")
        pairs = left.join(lead, ["band", "key"]).where("a <> lead.a").select("band", "key", F.col("lead.a").alias("a"), F.col("lead.f").alias("f"), F.col("a").alias("b"), F.col("f").alias("g"))
        met = durable(pairs.mapInArrow(verify, "band int, key string, a long, f string, b long, g string, likeness double"), "pairs")
        release(left)
        if met.isEmpty():
            break
        links.append(met.where(F.col("likeness") >= least).select("a", "b", "likeness"))
        left = durable(met.where(F.col("likeness") < least).select(F.col("b").alias("a"), F.col("g").alias("f"), "band", "key"), "bands")
    out = members
    for found in links:
        out = out.unionByName(found)
    return out.dropDuplicates(["a", "b"])
