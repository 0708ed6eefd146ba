"""Quality rules: an isolation forest on rule statistics, with its threshold calibrated from labelled rows.

The forest and its threshold are fitted on all labelled rows: trees are random cuts, which need no rows; the executors
count the good rows of every leaf and of every score, and the driver holds counts of fixed size.  Every row is scored.  A
null or empty text has no words and fails the base rule (n_words < 20).  With no labelled rows only the base rule decides.
Texts of any length are read whole.  Repeated rows are scored alike; input columns pass through ``clean`` untouched,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_filter, durable, has_bit, mapped, release, same_word, slices, text_buffers, windows, word_bounds, word_hashes

TREES, DEPTH, KEEP_GOOD = 100, 12, 0.995
#: Ranges of scores within which sums run; their totals are all that the driver holds of the scores.
_RANGES = 1 << 16
MIN_WORDS, MAX_REPEAT = 20, 30
#: Words of a window whose distinct words are counted.
WINDOW = 200
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = " \t\n\x0b\x0c\r"
#: Of the forest, in order: roots of shares of symbols, characters a word, repeated lines, repeated words, capitals, marks and words
#: that repeat the one before; mean and least share of distinct words.
_FEATURES = ("symbols", "chars", "again", "repeat", "upper", "marks", "same", "distinct", "least")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rule counts (n x 5, in the order of COUNTS) and the forest's features (n x 9) of whole texts."""
    counts, features = [np.zeros((0, 5), np.int64)], [np.zeros((0, 9))]
    raw_all, offsets_all = text_buffers(column)
    for lo, hi in slices(offsets_all):
        raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
        starts, ends, first = word_bounds(raw, offsets)
        hashes, n = word_hashes(raw, starts, ends, False), np.diff(first)
        chars = _per_text(((raw & 0xC0) != 0x80) & ~_space(raw), offsets)
        symbols, marks, upper = (_per_text(m[raw], offsets) for m in (_SYMBOLS, _MARKS, _UPPER))
        rows, dup, repeat, same, distinct = hi - lo, np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros((hi - lo, 2))
        again = np.zeros(rows)
        data = raw.tobytes()
        for i in range(rows):
            lines = [x for x in data[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            once = set(lines)
            dup[i] = len(lines) - len(once)
            if dup[i]:  # a repeated short line weighs little
                again[i] = 1 - sum(map(len, once)) / sum(map(len, lines))
            w = hashes[first[i] : first[i + 1]]
            if len(w) > 1:
                same[i] = np.count_nonzero(w[1:] == w[:-1])
                distinct[i] = _distinct(w)
            if len(w) > 8:
                repeat[i] = _covered(windows(w, 8), len(w))
        words = np.maximum(n, 1)
        counts.append(np.stack([n, chars, symbols, dup, repeat], 1))
        # roots spread small shares, so that a few table bars or repeats stand apart from none
        features.append(np.stack([np.sqrt(symbols / words), np.sqrt(chars / words), np.sqrt(again), np.sqrt(repeat / words), np.sqrt(upper / np.maximum(chars, 1)), np.sqrt(marks / words), np.sqrt(same / words), distinct[:, 0], distinct[:, 1]], 1))
    return np.concatenate(counts), np.concatenate(features)


def _space(raw: np.ndarray) -> np.ndarray:
    from .common import SPACE

    return SPACE[raw]


def _distinct(w: np.ndarray) -> tuple[float, float]:
    """Mean and least share of distinct words in the windows of WINDOW words one after another; the last one ends with the
    text and reaches back into the one before, as shares of fewer words would be higher."""
    size = min(len(w), WINDOW)
    full = len(w) // size * size
    parts = w[:full].reshape(-1, size)
    if full < len(w):
        parts = np.concatenate([parts, w[None, -size:]])
    parts = np.sort(parts, axis=1)
    share = (1 + np.count_nonzero(parts[:, 1:] != parts[:, :-1], axis=1)) / size
    return float(share.mean()), float(share.min())


def _covered(grams: np.ndarray, n: int) -> int:
    """Words inside windows that occur twice or more."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    equal = g[1:] == g[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    at = order[twice]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 8, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n] > 0))


class Cuts:
    """TREES trees of random cuts, DEPTH deep: feature and cut of each inner node, whose children are 2 i + 1 and 2 i + 2.

    Cuts are drawn over the part of a feature's range (lo, hi) that a node covers, so that space without rows is parted
    from them after a few cuts.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, seed: int = 7):
        rng, spread = np.random.default_rng(seed), np.flatnonzero(hi > lo)
        # rows that don't differ can't be parted
        self.feature, self.cut = np.zeros((TREES, 2**DEPTH - 1), np.int8), np.full((TREES, 2**DEPTH - 1), np.inf)
        for t in range(TREES if len(spread) else 0):
            low, high = lo[None, :], hi[None, :]
            for level in range(DEPTH):
                node, first = np.arange(2**level), 2**level - 1
                f = spread[rng.integers(len(spread), size=2**level)]
                cut = rng.uniform(low[node, f], high[node, f])
                self.feature[t, first : 2 * first + 1], self.cut[t, first : 2 * first + 1] = f, cut
                low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
                high[2 * node, f] = low[2 * node + 1, f] = cut

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row of x falls in, in each tree (TREES x n)."""
        out, row = np.zeros((TREES, len(x)), np.int64), np.arange(len(x))
        for t in range(TREES):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, self.feature[t, at]] >= self.cut[t, at])
            out[t] = at - (2**DEPTH - 1)
        return out

    def count(self, x: np.ndarray) -> np.ndarray:
        """Rows of x in each leaf (TREES x 2**DEPTH)."""
        at = self.leaves(x) + (np.arange(TREES) * 2**DEPTH)[:, None]
        return np.bincount(at.ravel(), minlength=TREES * 2**DEPTH).reshape(TREES, -1)


class Forest:
    """Isolation forest over all of x, or over rows whose numbers in the leaves of cuts are given: TREES trees, each an array
    of (feature, cut, left, right, path length).  A node with one row or none is not parted further."""

    def __init__(self, x: np.ndarray | None, lo: np.ndarray, hi: np.ndarray, counts: np.ndarray | None = None):
        cuts, self.trees = Cuts(lo, hi), []
        counts = cuts.count(x) if counts is None else counts
        # rows of every node, the root first
        levels = [counts]
        for _ in range(DEPTH):
            levels.insert(0, levels[0].reshape(TREES, -1, 2).sum(2))
        rows, level = np.concatenate(levels, 1), np.repeat(np.arange(DEPTH + 1), 2 ** np.arange(DEPTH + 1))
        length = level + _average(rows)
        inner = (rows > 1) & (level < DEPTH)
        for t in range(TREES):
            parted = np.flatnonzero(inner[t])
            # rows of a node are rows of the nodes above it, so those are parted too
            kept = np.sort(np.concatenate([[0], 2 * parted + 1, 2 * parted + 2]))
            at = np.searchsorted(kept, parted)
            tree = np.stack([np.full(len(kept), -1.0), np.zeros(len(kept)), np.arange(len(kept)), np.arange(len(kept)), length[t, kept]], 1)
            tree[at, 0], tree[at, 1] = cuts.feature[t, parted], cuts.cut[t, parted]
            tree[at, 2], tree[at, 3] = np.searchsorted(kept, 2 * parted + 1), np.searchsorted(kept, 2 * parted + 2)
            self.trees.append(tree)
        self.depth, self.norm = DEPTH, DEPTH + float(_average(rows[:1, 0])[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path length over the expected one."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = t[at, 0].astype(np.int64)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f >= 0, go, at)
            total += t[at, 4]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def _average(n: np.ndarray) -> np.ndarray:
    """Mean length of a path that parts one of n rows from the others by random cuts."""
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2.0 * (np.log(m - 1) + 0.5772156649) - 2.0 * (m - 1) / m)


def _features(b: pa.RecordBatch) -> np.ndarray:
    """The rows of a batch's column x."""
    at = b.schema.get_field_index("x")
    return b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def measured(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, x (the features) and good of every labelled document that passes the base rule."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("__hash", F.xxhash64("doc_id"))
    # texts without a label needn't be measured, and texts aren't shuffled
    texts = texts.join(bit_filter(known.select(F.xxhash64("doc_id").alias("__hash")), "__hash"), same_word("__hash")).where(has_bit("__hash"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            counts, features = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_base_failed(counts)), pa.array(list(features), pa.list_(pa.float64()))], ["doc_id", "poor", "x"])

    # of rows that repeat a doc_id the one with the smallest measures, whatever their order
    rows = texts.select("doc_id", "text").transform(mapped, measure, "doc_id long, poor boolean, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("poor", "x")).alias("least"))
    return rows.join(known, "doc_id").where("not least.poor").select("doc_id", "least.x", "good")


def _counted(good: DataFrame, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows of good in each leaf of the cuts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, total = Cuts(lo, hi), np.zeros((TREES, 2**DEPTH), np.int64)
        for b in _cut(batches):
            total += cuts.count(_features(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["leaf", "n"])

    held = good.transform(mapped, count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TREES * 2**DEPTH, np.int64)
    out[held["leaf"].to_numpy()] = held["n"].to_numpy()
    return out.reshape(TREES, -1)


def threshold(scores: DataFrame) -> float:
    """Of the cuts that keep KEEP_GOOD of the good rows at least, the one that parts good from poor rows best, the highest of
    equals.  Cuts lie halfway between neighbouring scores, and above all.

    scores has score, good and poor: the numbers of rows with that score.  Sums run within ranges of scores, to which the totals
    of those below are added.
    """
    ranged = scores.withColumn("part", F.floor(F.col("score") * _RANGES))
    totals = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("good"), F.sum("poor")).collect())
    below = np.cumsum([(0, 0), *((g, p) for _, g, p in totals)], 0)
    good, poor = map(int, below[-1])
    offsets = scores.sparkSession.createDataFrame([(part, int(g), int(p)) for (part, *_), (g, p) in zip(totals, below)], "part long, good_below long, poor_below long")
    so_far = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = ranged.select("part", "score", F.sum("good").over(so_far).alias("good"), F.sum("poor").over(so_far).alias("poor")).join(F.broadcast(offsets), "part")
    kept = kept.select("score", (F.col("good") + F.col("good_below")).alias("good"), (F.col("poor") + F.col("poor_below")).alias("poor"))
    # the difference of the shares kept, in whole numbers
    gain = (F.col("good").cast("decimal(18,0)") * F.lit(poor) - F.col("poor").cast("decimal(18,0)") * F.lit(good)).cast("decimal(38,0)")
    best = kept.where(F.col("good") / F.lit(good) >= KEEP_GOOD).agg(F.max(F.struct(gain.alias("gain"), "score")).alias("best")).first()["best"]["score"]
    above = scores.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best + 1e-6 if above is None else (best + above) / 2


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and the score above which a document is an anomaly, from all labelled rows.  (None, 2.0) without labelled
    rows of both kinds."""
    rows = durable(measured(documents, labels), "measured")
    features = range(len(_FEATURES))
    ends = rows.agg(F.count_if("good"), F.count_if(~F.col("good")), *(f(F.col("x")[i]) for f in (F.min, F.max) for i in features)).first()
    if not ends[0] or not ends[1]:
        release(rows)
        return None, 2.0
    # trees hold good rows; the space they part is that of all rows
    lo, hi = (np.array(ends[2 + k * len(features) :][: len(features)]) for k in (0, 1))
    forest = Forest(None, lo, hi, _counted(rows.where("good").select("x"), lo, hi))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_features(b))), b.column(1)], ["score", "good"])

    scores = rows.select("x", "good").transform(mapped, score, "score double, good boolean")
    scores = durable(scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor")), "scores")
    limit = threshold(scores)
    release(rows)
    release(scores)
    return forest, limit


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])


def _verdict(column: pa.Array, forest: Forest | None, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, features = statistics(column)
    failed = _base_failed(counts)
    score = forest.score(features) if forest is not None and len(features) else np.zeros(len(counts))
    return counts, failed, score, ~failed & (score <= limit)


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, anomaly score and kept for each row of documents."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            counts, failed, score, kept = _verdict(b.column(1), *model)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "anomaly_score", "kept"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, anomaly_score double, kept boolean"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, run, schema)


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with all their columns."""
    model, at = fit(documents, labels), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            yield b.filter(pa.array(_verdict(b.column(at), *model)[3]))

    return documents.transform(mapped, run, documents.schema)
