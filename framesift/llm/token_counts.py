"""Token counts of a byte-fallback BPE model by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of word marks and the characters up to the next one), across which no piece of the
vocabulary reaches.  The distinct pre-tokens of a batch that the worker has not met are held as one ragged array of
symbols; in each round every sequence applies its lowest-rank pair at once, until none has one left.  The surviving
symbols are counted, a character outside the vocabulary as its UTF-8 bytes.  Sequences above LONG symbols are merged with
a heap instead: a round merges one place of a sequence, so a word of a million characters would take a million rounds over
all of its symbols.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows give repeated results; other columns are
ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

MARK = "▁"
LIMIT = 4096
#: Symbols above which a sequence is merged with a heap; pre-tokens that a worker remembers.
LONG, REMEMBERED = 64, 600_000
_models: dict[str, RankMerger] = {}


class RankMerger:
    """Counts the tokens of texts with the vocabulary of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        # rank 0 merges first; pieces of one score share a rank and the leftmost of them merges first
        scores = {i: model.get_score(i) for i in plain}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.piece, self.rank = pieces, {i: ranks[s] for i, s in scores.items()}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches across a word mark")
        self.alone = "\n" not in "".join(pieces)  # a line end is in no piece: it can be cut out
        pairs = [(pieces[p[:k]], pieces[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        # characters are symbols of their own; those outside the vocabulary get ids beyond it and pair with nothing
        keys = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array([c for _, _, c in pairs], np.int64)[order]
        self.made_rank = np.array([self.rank[c] for c in self.made], np.int64)
        self.table = {(a, b): (self.rank[c], c) for a, b, c in pairs}
        self.known: dict[str, int] = {}

    # -------------------------------------------------------- merging

    def _symbols(self, word: str) -> list[int]:
        get = self.piece.get
        return [get(c, -len(c.encode("utf-8", "replace"))) for c in word]  # -bytes: outside the vocabulary

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all pre-tokens merged in step."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(self._symbols(w))
        if not short:
            return out
        lists = [self._symbols(words[i]) for i in short]
        length = np.array([len(x) for x in lists], np.int64)
        flat = np.array([s for x in lists for s in x], np.int64)
        seq = np.repeat(np.arange(len(short)), length)
        none = np.int64(1 << 60)
        while len(flat) > 1:
            rank, made = np.full(len(flat) - 1, none), np.zeros(len(flat) - 1, np.int64)
            ok = np.flatnonzero((seq[1:] == seq[:-1]) & (flat[1:] >= 0) & (flat[:-1] >= 0))
            key = (flat[:-1][ok] << 32) | flat[1:][ok]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            ok, at = ok[hit], at[hit]
            if not len(ok):
                break
            rank[ok], made[ok] = self.made_rank[at], self.made[at]
            # the lowest rank of each sequence, leftmost first
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(np.append(rank, none), first)
            live = np.zeros(len(short), np.int64) + none
            live[seq[first]] = best
            cand = ok[rank[ok] == live[seq[ok]]]
            cand = cand[np.concatenate([[True], seq[cand][1:] != seq[cand][:-1]])]
            flat[cand] = made[cand]
            keep = np.ones(len(flat), bool)
            keep[cand + 1] = False
            # sequences without a pair are done: count and drop them
            done = live[seq] == none
            np.add.at(out, np.array(short)[seq[done]], np.where(flat[done] < 0, -flat[done], 1))
            keep &= ~done
            flat, seq = flat[keep], seq[keep]
        np.add.at(out, np.array(short)[seq], np.where(flat < 0, -flat, 1))
        return out

    def _merge_long(self, s: list[int]) -> int:
        n, table = len(s), self.table
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(table[p][0], i, p, table[p][1]) for i in range(n - 1) if (p := (s[i], s[i + 1])) in table]
        heapq.heapify(heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (s[i], s[j]) != pair:
                continue
            s[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s[a], s[b]) in table:
                    heapq.heappush(heap, (table[s[a], s[b]][0], a, (s[a], s[b]), table[s[a], s[b]][1]))
        return sum(1 if x >= 0 else -x for x, a in zip(s, alive, strict=True) if a)

    # -------------------------------------------------------- texts

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace("\n", " \n") if self.alone else text
        if text[0] != " " and "  " not in marked and MARK not in marked:
            return marked.split(" ")
        return ["\0" + x for x in self._pretokens(text)]

    @staticmethod
    def _pretokens(text: str) -> list[str]:
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))

    def _word(self, chunk: str) -> str:
        """The pre-token a chunk stands for: "\\0" marks it as one already, "\\n" as one after a line end."""
        return chunk[1:] if chunk[:1] == "\0" else chunk[1:] if self.alone and chunk[:1] == "\n" else MARK + chunk

    def counts(self, texts: list[str]) -> list[int]:
        lists = []
        for t in texts:
            if "\0" in t or " \n" in t:  # those marks stand for themselves here
                lists.append(["\0" + x for x in self._pretokens(t)] if t else [])
            else:
                lists.append(self._chunks(t))
        known = self.known
        new = list({c for x in lists for c in x if c not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({c for x in lists for c in x})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ends = [1 if self.alone and c[:1] == "\n" else 0 for c in part]
            known.update(zip(part, (self.merge([self._word(c) for c in part]) + np.array(ends)).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, x)) for x in lists]


def merger(path: str) -> RankMerger:
    if path not in _models:
        _models[path] = RankMerger(path)
    return _models[path]


def count_tokens(documents: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(model_path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                n = np.array(model.counts(texts), np.int64)
                size = np.array([len(x.encode()) for x in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        model.known.clear()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
