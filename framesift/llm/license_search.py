"""Fuzzy search for short licence notices.

Base: places where the words of a phrase stand consecutively.  Fuzzy: each notice with an error bound of k edits is cut
into k + 1 pieces, one of which any text within k edits holds exactly; an Aho-Corasick automaton over all pieces finds
those seeds, and around them the regex library's bounded-error matching verifies the edits and gives the spans.

Texts are normalised to their words (A-Z lower-cased) with one space between, so spans are in words.  Null and empty
texts have no words and no labels.  Texts of any length are read whole, in time in proportion to their length and matches.
Repeated rows give repeated results; other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices, in normalised words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this work is licensed under the gnu general public license version": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "spdx license identifier": "spdx",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: Bytes that end a word: ASCII without digits and letters.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def normalise(text: str) -> bytes:
    """Words of a text, lower-cased in A-Z, with one space between and around."""
    return b" " + b" ".join(text.encode("utf-8", "replace").lower().translate(_TO_SPACE).split()) + b" "


class NoticeSearch:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.automaton, self.notices = ahocorasick.Automaton(), []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            k = len(notice) // chars_per_edit
            step = len(notice) / (k + 1)
            cuts = [round(i * step) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((n, a))
            self.notices.append((notice, label, k, regex.compile(f"(?be)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")))
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def base(self, words: bytes) -> tuple[list[int], set[str]]:
        """Starts of all places of phrases, in words, and their labels."""
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = words.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = words.find(phrase, at + 1)
        if places:
            places = np.searchsorted(np.flatnonzero(np.frombuffer(words, np.uint8) == 32), places).tolist()
        return places, labels

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, word after the last, edits, allowed edits) of notices within their bounds."""
        near: dict[int, dict[int, int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                start = end - size + 1 - offset
                k = self.notices[n][2]
                slot = start // (k + 1)
                seen = near.setdefault(n, {})
                seen[slot] = seen.get(slot, 0) | 1 << offset
        found = []
        for n, slots in near.items():
            notice, label, k, pattern = self.notices[n]
            windows: list[list[int]] = []
            for slot in sorted(slots):
                # at most k edits shift the pieces by k at most: the exact ones lie in this slot and those beside it
                lo, hi = slot * (k + 1) - k, (slot + 1) * (k + 1) + len(notice) + k
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                for m in pattern.finditer(text, max(0, lo), min(len(text), hi)):
                    found.append((label, *m.span(), sum(m.fuzzy_counts), k))
        if found:  # from characters to words, with the spaces' places taken once
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            starts, ends = (np.searchsorted(spaces, [s[i] + d for s in found]) for i, d in ((1, 1), (2, -1)))
            found = [(s[0], int(a) - 1, int(b), s[3], s[4]) for s, a, b in zip(found, starts, ends, strict=True)]
        return found


def search(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the fuzzy spans of each row.

    score is 1 with a base label, else the best share of unused edits among the spans found (0 without).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeSearch()
        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            out: list[list] = [[] for _ in range(8)]
            for text in b.column(1).to_pylist():
                words = normalise(text or "")
                places, base = finder.base(words)
                spans = finder.fuzzy(words.decode("utf-8", "replace"))
                row = (
                    words.count(b" ") - 1 if words.strip() else 0, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
                    1.0 if base else max((1.0 - s[3] / (s[4] + 1) for s in spans), default=0.0), ",".join(f"{s[0]}:{s[1]}:{s[2]}:{s[3]}" for s in sorted(spans, key=lambda s: (s[1], s[0]))),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, run, schema)
