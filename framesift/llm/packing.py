"""Sum-of-squares online packing of documents into windows of WINDOW tokens.

A document's ids are its tokens and END.  It is cut into full windows and a rest; the rest goes to the fill level that
minimises the sum over levels of squared counts of partially filled windows, which a level array holds.  Each scan
partition is packed on its own, without a shuffle: an id of a sequence is the partition's number and a running one, so
a task that runs again gives the same rows.  At a partition's end the open windows are levelled: the emptiest is cut into
pieces that fill the fullest, and the last is cut into powers of two, which need no padding.

A null text is an empty one: the single id END.  Texts of any length are read whole.  Repeated rows are packed as documents
of their own.  Other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

WINDOW, END = 2048, 1
#: Stands between words that are encoded together; one token.
MARK = "\x01"
#: Words whose ids a worker remembers, some 160 MB at most; it keeps them for later tasks.  When there are more, those met again stay.
REMEMBERED = 1_000_000
#: Words of a line that is encoded at once; the tokenizer takes longer a word for longer lines.
LINE = 200
_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of texts from a tokenizers file whose pre-tokens never hold white space; remembers the ids of words."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.model = Tokenizer.from_file(path)
        (self.mark,) = self.model.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        # number 0 is the empty word, number 1 the end of a text
        self.known: dict[str, int] = {"": 0}
        self.at, self.size, self.flat, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 1, 2
        self.flat[0], self.size[1] = END, 1
        self.again = np.zeros(1 << 16, bool)  # words met after they were learned

    def forget(self) -> None:
        """Words that were met once go; those met again stay, if they leave half of the room."""
        kept = [w for w, i in self.known.items() if i > 1 and self.again[i]]
        old = np.fromiter(map(self.known.get, kept), np.int32, len(kept))
        size, at, flat = self.size[old], self.at[old], self.flat
        self.clear()
        if 0 < len(kept) <= REMEMBERED // 2:
            place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self._put(kept, size, flat[place])

    def _learn(self, words: list[str]) -> None:
        """The words stand in lines of LINE words with a mark between, whose id parts the ids."""
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            lines = [part[i : i + LINE] for i in range(0, len(part), LINE)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([f" {MARK} ".join([*x, ""]) for x in lines], add_special_tokens=False)])
            ends = np.flatnonzero(flat == self.mark)
            if len(ends) != len(part):  # a word holds the mark, or gives its id
                ids = [e.ids for e in self.model.encode_batch_fast(part, add_special_tokens=False)]
                size, flat = np.array([len(x) for x in ids]), np.array([y for x in ids for y in x], np.uint32)
            else:
                size, flat = np.diff(ends, prepend=-1) - 1, flat[flat != self.mark]
            self._put(part, size, flat)

    def _put(self, part: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        while self.n + len(part) > len(self.at):
            self.at, self.size, self.again = (np.concatenate([x, x]) for x in (self.at, self.size, self.again))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(part)] = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.size[self.n : self.n + len(part)] = size
        self.known.update(zip(part, range(self.n, self.n + len(part)), strict=True))
        self.n, self.used = self.n + len(part), self.used + len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, with END after each text, and each text's end in it."""
        if not texts:
            return self.flat[:0], np.zeros(0, np.int64)
        texts = [t.replace("\n", " ") for t in texts]
        words, counts = " ".join(texts).split(" "), [t.count(" ") + 1 for t in texts]
        look = lambda words: np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        number = look(words)
        if len(missing := np.flatnonzero(number < 0)):
            met = [words[i] for i in missing.tolist()]
            new = set(met)
            if len(self.known) + len(new) > REMEMBERED:
                self.again[number[number >= 0]] = True
                self.forget()
                number = look(words)
                missing = np.flatnonzero(number < 0)
                met = [words[i] for i in missing.tolist()]
                new = set(met)
            self.again[number[number >= 0]] = True
            self._learn(list(new))
            number[missing] = look(met)
        else:
            self.again[number] = True
        number = np.insert(number, np.cumsum(counts), 1)
        size = self.size[number]
        ends = np.cumsum(size, dtype=np.int32)
        place = np.repeat(self.at[number] - (ends - size), size) + np.arange(ends[-1], dtype=np.int32)
        return self.flat[place], ends[np.cumsum(np.array(counts) + 1) - 1].astype(np.int64)


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Packer:
    """Pieces are [document, start, length, crc, document's tokens, ids or None]; windows are lists of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window, self.count, self.open = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
        self.cost = np.zeros(window + 1, np.int64)

    def place(self, size: int) -> int:
        """The level (0 is a new window) at which a piece of size adds least to the sum of squares."""
        c, top = self.count, self.window - size
        add = 2 * c[size : self.window + 1] + 1  # of the level that it leads to
        add[-1] = 0  # a full window isn't counted
        leave = 1 - 2 * c[: top + 1]  # of the level that it leaves
        leave[0] = 0
        total = np.where(c[: top + 1] > 0, add + leave, np.iinfo(np.int64).max)
        total[0] = add[0]
        return top - int(np.argmin(total[::-1]))  # of equals the fullest

    def add(self, piece: list) -> list | None:
        """The window that the piece fills, if it does."""
        size = piece[2]
        level = self.place(size)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            return held
        self.open[level + size].append(held)
        self.count[level + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """The open windows, levelled by cutting the emptiest, then the last in powers of two."""
        rest = [(level, held) for level in range(1, self.window) for held in self.open[level]]
        self.__init__(self.window)
        lo, hi = 0, len(rest) - 1
        spare: list = rest[0][1] if rest else []
        while lo < hi:
            level, held = rest[hi]
            need = self.window - level
            while need and (spare or lo + 1 < hi):
                if not spare:
                    lo += 1
                    spare = rest[lo][1]
                taken, spare_piece = cut(spare.pop(), need)
                held.append(taken)
                need -= taken[2]
                if spare_piece:
                    spare.append(spare_piece)
            if need:
                spare = held
                break
            yield held
            hi -= 1
            if lo == hi:
                break
            if not spare:
                lo += 1
                spare = rest[lo][1] if lo <= hi else []
        total = sum(p[2] for p in spare)
        while spare:
            need, held = 1 << (total.bit_length() - 1), []
            total -= need
            while need:
                taken, left = cut(spare.pop(), need)
                held.append(taken)
                need -= taken[2]
                if left:
                    spare.append(left)
            yield held


def cut(piece: list, size: int) -> tuple[list, list | None]:
    """The first size ids of a piece, and what is left."""
    if piece[2] <= size:
        return piece, None
    doc, start, length, _, tokens, ids = piece
    return [doc, start, size, zlib.crc32(ids[:size].tobytes()), tokens, ids[:size]], [doc, start + size, length - size, zlib.crc32(ids[size:].tobytes()), tokens, ids[size:]]


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = word_ids(tokenizer_path), Packer(window)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def put(held: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, crc, tokens, ids in held:
                rows.append((doc, start, length, crc, tokens, sequence, offset, *([ids.tolist()] if with_ids else [])))
                offset += length
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.list_(pa.int64()) if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [*COLUMNS, *["ids"] * with_ids])

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, ends = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                at = 0
                for doc, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    tokens = end - at
                    for start in range(0, tokens, window):
                        piece = ids[at + start : min(at + start + window, end)]
                        crc = zlib.crc32(piece.tobytes())
                        if len(piece) == window:
                            put([[doc, start, window, crc, tokens, piece]])
                        elif full := packer.add([doc, start, len(piece), crc, tokens, piece.copy()]):
                            put(full)
                    at = end
                if len(rows) > 4096:
                    yield out()
        for held in packer.close():
            put(held)
        if rows:
            yield out()

    schema = ", ".join(f"{c} long" for c in COLUMNS) + (", ids array<long>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, run, schema)
