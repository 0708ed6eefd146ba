"""N-gram Jaccard join by signature trees.

Documents are sets of distinct five-word shingles; two link when 100 * |A and B| >= 80 * |A or B|.  The join is exact:

1. Equal sets form one class, found by a digest that is aggregated before its shuffle; only one row of a class goes on.
2. Two linked sets share l of the ``n - ceil(0.8 n) + l`` first shingles of each, under any common order.  Ordered by
   hash, with l about n / 20, that drops most classes.  The rest is ordered again by true frequency with l = 1, so that
   passages which many documents share come last and make no candidates.
3. Classes that share a shingle form blocks.  In a block a signature tree is built: its nodes hold the OR of the
   members' bitmaps and the range of their sizes, and pairs of nodes are descended only while the most shingles that two
   members can share reach the threshold.  Node pairs within one component are left out.  Blocks are cut into pieces of
   at most BLOCK shingles, all pairs of pieces being joined, so no task holds an unbounded group.
   A block of p pieces is first joined piece by piece, and dealt anew DEALS times in all: random pieces of a large group of
   near copies hold members of all the components found before, so it becomes one, which needs no pair of pieces any more.
4. The first rounds, with three keys a class, whose trees verify links on the sets, find most components.  The last goes
   over all keys, but expands only blocks whose members are not of one component already, and its trees hold bitmaps
   alone; the few pairs that they allow are then verified on the sets.

Null and empty texts have n_shingles 0 and are alone.  Rows that repeat a doc_id are rows of their own; the component's
id is the smallest non-null doc_id in it (null where all are null).  Texts of any length are read whole.  Other columns are
ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, mapped, mix, named_rows, release, slices, text_buffers, windows, word_bounds, word_hashes

WIDTH, PERCENT = 5, 80
#: Shingles (or words of bitmaps) in one piece of a block; times that the pieces of large blocks are dealt.
BLOCK, DEALS = 200_000, 2
#: Bits of the filter that names the rows of the second pass; it never grows, and a full one only lets more rows through.
FILTER_BITS = 1 << 24
FAN, LEAF = 8, 8


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    raw_all, offsets_all = text_buffers(column)
    for lo, hi in slices(offsets_all):
        raw, offsets = raw_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo]
        starts, ends, first = word_bounds(raw, offsets)
        hashes = word_hashes(raw, starts, ends, True)
        grams = windows(hashes, WIDTH)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= WIDTH:
                yield np.unique(grams[a : b - WIDTH + 1])
            elif b > a:
                yield mix(windows(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32()), pa.array(flat))


def _must_share(n: int) -> int:
    """Shingles that the first keys of a set must share with those of any set it links to: a quarter of the least number."""
    return (n - -(-PERCENT * n // 100) + 1) // 4 + 1 if n > 4 else 1


def _first_keys(n: int) -> int:
    """Linked sets share l of the ``n - ceil(0.8 n) + l`` first shingles of each."""
    return n - -(-PERCENT * n // 100) + _must_share(n)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest = [], []
        for s in shingle_sets(b.column(2)):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["row", "doc_id", "n", "digest"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows_of = b.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, b.num_rows, 500):
            part = [s[: _first_keys(len(s))] for s in shingle_sets(b.column(2).slice(lo, 500))]
            rows = rows_of[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).view(np.int64)), pa.array(np.repeat(rows, [len(x) for x in part]))], ["s", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (s, node) rows sorted by s, how many of a node's s another row has too; holds one row between batches."""
    s0, v0, flag = None, None, False
    for b in batches:
        s, v = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
        if s0 is not None:
            s, v = np.concatenate([[s0], s]), np.concatenate([[v0], v])
        if not len(s):
            continue
        equal = s[1:] == s[:-1]
        keep = np.concatenate([[flag and s0 is not None], equal])
        keep[:-1] |= equal
        s0, v0, flag = s[-1], v[-1], bool(keep[-1])
        out, count = np.unique(v[:-1][keep[:-1]], return_counts=True)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(count.astype(np.int64))], ["node", "c"])
    if s0 is not None and flag:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([v0], np.int64)), pa.array(np.array([1], np.int64))], ["node", "c"])


# ---------------------------------------------------------------- the tree


class _Union:
    def __init__(self, labels: list[int]):
        self.up = {x: x for x in labels}

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def bits_for(n: int) -> int:
    return min(1 << 16, max(256, 1 << (8 * n - 1).bit_length()))


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """Bits of shingles, by the low bits of a hash, so that folding halves gives the bitmap of half the bits."""
    out = np.zeros(bits // 64, np.uint64)
    at = (mix(items.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class SignatureTree:
    """Records (id, size, component, sorted shingles) under nodes of OR-combined bitmaps, size ranges and hash collisions.

    size counts all shingles of a record, its array only those that others may share.  Without arrays (None) the
    bitmaps and the numbers of shingles in them are given, and pairs can't be verified: they are candidates.
    """

    def __init__(self, records: list[tuple[int, int, int, np.ndarray | None]], maps: np.ndarray | None = None, counts: np.ndarray | None = None):
        order = sorted(range(len(records)), key=lambda i: (records[i][1], records[i][0]))
        self.records = records = [records[i] for i in order]
        if maps is None:
            bits = bits_for(max(len(r[3]) for r in records))
            maps, counts = np.stack([bitmap(r[3], bits) for r in records]), np.array([len(r[3]) for r in records])
        else:
            maps, counts = maps[order], counts[order]
        self.maps = maps
        self.size = np.array([r[1] for r in records])
        self.excess = counts - np.bitwise_count(maps).sum(1).astype(np.int64)
        # nodes: (first record, end, children); leaves have no children
        self.lo, self.hi, self.kids = [], [], []
        level = []
        for a in range(0, len(records), LEAF):
            level.append(self._node(a, min(a + LEAF, len(records)), ()))
        while len(level) > 1:
            level = [self._node(self.lo[c[0]], self.hi[c[-1]], tuple(c)) for c in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]
        self.any = [np.bitwise_or.reduce(maps[a:b]) for a, b in zip(self.lo, self.hi, strict=True)]
        self.small = [int(self.size[a:b].min()) for a, b in zip(self.lo, self.hi, strict=True)]
        self.large = [int(self.size[a:b].max()) for a, b in zip(self.lo, self.hi, strict=True)]
        self.over = [int(self.excess[a:b].max()) for a, b in zip(self.lo, self.hi, strict=True)]
        self.one = [False] * len(self.lo)

    def _node(self, lo: int, hi: int, kids: tuple) -> int:
        self.lo.append(lo), self.hi.append(hi), self.kids.append(kids)
        return len(self.lo) - 1

    def _uniform(self, k: int, union: _Union) -> bool:
        if not self.one[k]:
            if self.kids[k]:
                self.one[k] = all(self._uniform(c, union) for c in self.kids[k]) and len({union.find(self.records[self.lo[c]][2]) for c in self.kids[k]}) == 1
            else:
                self.one[k] = len({union.find(self.records[i][2]) for i in range(self.lo[k], self.hi[k])}) == 1
        return self.one[k]

    def links(self) -> list[tuple[int, int]]:
        """Verified links that connect all components which any link connects."""
        union, out = _Union([r[2] for r in self.records]), []
        self._inside(self.root, union, out)
        return out

    def _inside(self, k: int, union: _Union, out: list) -> None:
        if self._uniform(k, union):
            return
        kids = self.kids[k]
        if not kids:
            self._leaves(k, k, union, out)
            return
        for c in kids:
            self._inside(c, union, out)
        for i, c in enumerate(kids):
            for d in kids[i + 1 :]:
                self._across(c, d, union, out)

    def _across(self, i: int, j: int, union: _Union, out: list) -> None:
        stack = [(i, j)]
        while stack:
            i, j = stack.pop()
            if 100 * min(self.large[i], self.large[j]) < PERCENT * max(self.small[i], self.small[j]):
                continue
            need = -(-PERCENT * (self.small[i] + self.small[j]) // (100 + PERCENT))
            most = int(np.bitwise_count(self.any[i] & self.any[j]).sum()) + min(self.over[i], self.over[j])
            if most < need:
                continue
            if self._uniform(i, union) and self._uniform(j, union) and union.find(self.records[self.lo[i]][2]) == union.find(self.records[self.lo[j]][2]):
                continue
            if self.kids[i] and (not self.kids[j] or self.hi[i] - self.lo[i] >= self.hi[j] - self.lo[j]):
                stack.extend((c, j) for c in self.kids[i])
            elif self.kids[j]:
                stack.extend((i, c) for c in self.kids[j])
            else:
                self._leaves(i, j, union, out)

    def _leaves(self, i: int, j: int, union: _Union, out: list) -> None:
        a, b = slice(self.lo[i], self.hi[i]), slice(self.lo[j], self.hi[j])
        most = np.bitwise_count(self.maps[a][:, None] & self.maps[b][None]).sum(2).astype(np.int64) + np.minimum(self.excess[a][:, None], self.excess[b][None])
        near = (100 + PERCENT) * most >= PERCENT * (self.size[a][:, None] + self.size[b][None])
        for x, y in np.argwhere(near):
            p, q = self.records[a.start + x], self.records[b.start + y]
            if p[0] == q[0] or (i == j and x >= y):
                continue
            u, v = union.find(p[2]), union.find(q[2])
            if u == v:
                continue
            if p[3] is None:
                out.append((p[0], q[0]))
                continue
            both = len(np.intersect1d(p[3], q[3], assume_unique=True))
            if 100 * both >= PERCENT * (p[1] + q[1] - both):
                union.up[max(u, v)] = min(u, v)
                out.append((p[0], q[0]))


def _verified(held: list[tuple]) -> list[tuple[int, int]]:
    return SignatureTree([(*r[:3], r[3].view(np.int64)) for r in held]).links()


def _possible(held: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of different components that their bitmaps allow to link.  Records of one width of bitmap are joined, and
    with those of twice the width (sizes of linked sets differ by less), folded."""
    out = []
    widths = np.array([len(r[3]) for r in held])
    for w in np.unique(widths):
        mine = [r for r, x in zip(held, widths, strict=True) if x in (w, 2 * w)]
        if len(mine) > 1:
            maps = np.stack([r[3].view(np.uint64) if len(r[3]) == w else r[3].view(np.uint64).reshape(2, -1)[0] | r[3].view(np.uint64).reshape(2, -1)[1] for r in mine])
            narrow = {r[0] for r in mine if len(r[3]) == w}
            tree = SignatureTree([(*r[:3], None) for r in mine], maps, np.array([r[4] for r in mine]))
            out += [p for p in tree.links() if p[0] in narrow or p[1] in narrow]
    return out


def _join_blocks(batches: Iterator[pa.RecordBatch], join) -> Iterator[pa.RecordBatch]:
    """Rows (block, piece, node, n, comp, array, count) sorted by block and piece: join for each piece.
    Pairs that a task finds again are given once."""
    key, held, seen = None, [], set()

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            links = {(min(p), max(p)) for p in join(held)} - seen
            if links:
                if len(seen) < 1_000_000:
                    seen.update(links)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    for b in batches:
        block, piece, node, n, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        items, count = b.column(5), b.column(6).to_numpy(zero_copy_only=False)
        at, flat = items.offsets.to_numpy(), items.values.to_numpy(zero_copy_only=False)
        for i in range(len(node)):
            k = (block[i], piece[i])
            if k != key:
                yield from flush()
                key, held = k, []
            held.append((int(node[i]), int(n[i]), int(comp[i]), flat[at[i] : at[i + 1]].copy(), int(count[i])))
    yield from flush()


def _tree_join(rows: DataFrame, join, salt: int | None = None, least: int = 1) -> DataFrame:
    """rows: block, node, n, comp, array, count.  Blocks whose arrays are above BLOCK are cut into pieces, every pair of
    which is joined; with a salt, pieces that it deals anew are joined in themselves alone.  Blocks of one component are
    left out, and those of fewer than least pieces."""
    mass = rows.groupBy("block").agg(F.count("*").alias("members"), F.sum(F.size("array")).alias("mass"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("members > 1 and lo <> hi")
    mass = mass.select("block", F.greatest(F.ceil(F.col("mass") / BLOCK), F.lit(1)).cast("int").alias("pieces")).where(F.col("pieces") >= least)
    cut = rows.join(mass, "block").withColumn("mine", F.pmod(F.xxhash64("node", "block", F.lit(salt or 0)), F.col("pieces")).cast("int"))
    if salt is None:
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        piece = F.least("mine", "other") * F.col("pieces") + F.greatest("mine", "other")
    else:
        piece = F.col("mine")
    spread = cut.select("block", piece.cast("long").alias("piece"), "node", "n", "comp", "array", "count")
    return spread.repartition("block", "piece").sortWithinPartitions("block", "piece").transform(mapped, lambda batches: _join_blocks(batches, join), "a long, b long")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, comp, items) with the items' bitmap in their place."""
    for b in batches:
        items = b.column(3)
        at, flat = items.offsets.to_numpy(), items.values.to_numpy(zero_copy_only=False)
        sets = [flat[at[i] : at[i + 1]] for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists([bitmap(x, bits_for(len(x))) for x in sets]), pa.array([len(x) for x in sets], pa.int64())], ["node", "n", "comp", "array", "count"])


# ---------------------------------------------------------------- the join


def _only(texts: DataFrame, nodes: DataFrame, apply, schema: str) -> DataFrame:
    """apply, of batches (row, doc_id, text), over the rows of texts named by nodes.

    A bit filter picks the rows inside the scan.  It has FILTER_BITS bits whatever the input, and may let other
    rows through: they are copies or unlinkable, so they cost time only.  Beyond the rows it is made for, a join picks them.
    """
    if nodes.count() > FILTER_BITS // 8:
        return texts.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "doc_id", "text").transform(mapped, apply, schema)
    words = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("h")).select(F.shiftright("h", 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow().to_batches():  # FILTER_BITS / 64 rows at most
        filled[r.column(0).to_numpy(zero_copy_only=False)] = r.column(1).to_numpy(zero_copy_only=False)
    shared = texts.sparkSession.sparkContext.broadcast(filled.tobytes())

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            h = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            b = b.filter(pa.array((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if b.num_rows:
                yield b

    return texts.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))).transform(mapped, lambda batches: apply(picked(batches)), schema)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            sets = [*shingle_sets(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["node", "n", "items"])


def _linkable(full: DataFrame) -> DataFrame:
    """(node, n, items, keys): items are the shingles that another node has too, keys those of the first ones by frequency.
    Nodes that can have no link are dropped."""
    posts = full.select("node", "n", F.explode("items").alias("s"))
    often = posts.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    lists = posts.join(often, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    free = F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1 - (n - size(x))").cast("int")
    return lists.withColumn("free", free).where("free > 0").select("node", "n", F.array_sort("x.s").alias("items"), F.slice("x.s", F.lit(1), F.col("free")).alias("keys"))


def numbered(documents: DataFrame) -> tuple[DataFrame, Column]:
    """documents, and a number for each row that doesn't depend on how a scan is split.

    It is a hash of the row's file and place.  With some 10^10 rows two may get the same one: the numbers are then drawn anew.
    """
    documents, file, place = named_rows(documents)
    seed = 0
    while True:
        row = F.xxhash64(file, place, F.lit(seed))
        if documents.select(row.alias("row")).groupBy("row").count().where("count > 1").isEmpty():
            return documents, row
        seed += 1


def classes(documents: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows has row, doc_id, n, digest, node of each document; roots has node, root for nodes with links."""
    texts = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = durable(texts.transform(mapped, _describe, "row long, doc_id long, n long, digest binary"), "shingles")
    names = durable(described.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.first("n").alias("n")), "classes")
    posts = _only(texts, names.select("node"), _heads, "s long, node long").repartition("s").sortWithinPartitions("s")
    counts = posts.transform(mapped, _shared, "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))
    least = F.when(F.col("n") > 4, F.expr(f"(n - (({PERCENT} * n + 99) div 100) + 1) div 4 + 1")).otherwise(1)
    nodes = durable(counts.join(names.select("node", "n"), "node").where(F.col("c") >= least).select("node"), "nodes")
    found = durable(_linkable(_only(texts, nodes, _full, "node long, n long, items array<long>")), "linkable")

    one_more = F.array_min(F.transform("items", lambda x: F.xxhash64(x)))
    three = F.explode_outer(F.array_distinct(F.array(F.array_min("items"), F.array_max("items"), one_more)))
    links = roots = None
    for deal in range(DEALS):
        named = found.withColumn("root", F.lit(None).cast("long")) if roots is None else found.join(roots, "node", "left")
        first = named.select(three.alias("block"), "node", "n", F.coalesce("root", "node").alias("comp"), F.col("items").alias("array"), F.size("items").cast("long").alias("count"))
        new = durable(_tree_join(first, _verified, salt=deal, least=1 if deal == 0 else 2), "links")
        if deal and new.isEmpty():
            break
        links, before = new if links is None else links.unionByName(new), roots
        roots = durable(components(links), "roots")
        release(before)

    labelled = found.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    keyed = labelled.select(F.explode("keys").alias("block"), "node", "comp")
    mixed = keyed.groupBy("block").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    blocks = mixed.groupBy("c", "f").agg(F.min("block").alias("block")).select("block")  # blocks of the same nodes once
    chosen = keyed.join(blocks, "block", "left_semi").select("block", "node")
    maps = labelled.select("node", "n", "comp", "items").transform(mapped, _maps, "node long, n long, comp long, array array<long>, count long")
    pairs = _tree_join(chosen.join(maps, "node").select("block", "node", "n", "comp", "array", "count"), _possible).distinct()
    side = found.select("node", "n", "items")
    pairs = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")), "b")
    both = F.size(F.array_intersect("ia", "ib"))
    more = durable(pairs.select("a", "b", "na", "nb", both.alias("both")).where(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b"), "links")
    roots = durable(components(links.unionByName(more)), "roots")
    # rows without shingles have no node
    return described.select("row", "doc_id", "n", "digest").join(names.select("digest", "node"), "digest", "left"), roots


def link_components(documents: DataFrame, named: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id and whether the row is its component's first, for each document."""
    rows, roots = classes(*(named or numbered(documents)))
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node", "row"))
    rows = durable(rows.select("row", "doc_id", "n", "root"), "rows")
    # the smallest doc_id, then the smallest row; nulls last.  Written, so that the join's hot roots can be split.
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("empty"), "doc_id", "row")).alias("least"))
    least = durable(least, "least")
    return rows.join(least, "root").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (F.col("least.row") == F.col("row")).alias("is_first"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """documents with one row of each component (the smallest doc_id), all columns kept, whatever their names."""
    columns = documents.columns
    documents, row = numbered(documents)
    gone = link_components(documents, (documents, row)).where("not is_first").select("row")
    whole = documents.select(row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    return whole.join(gone, "row", "left_anti").select(*(F.col(f"doc.`{c}`") for c in columns))
