"""Text normalisation, tokens and n-grams as Column builders."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from .scalars import let

#: Separates the stored grams of a field that holds them in one string.
GRAM_SEPARATOR = "␟"


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by canonical decomposition; the barred d has none and is added."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Canonical composition, for texts that may hold combining marks; composed texts don't need it."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition (full-width forms, ligatures); plain texts don't need it."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold(x: Column) -> Column:
    """Without diacritics: composed Latin letters to their base, combining marks removed, barred d to d."""
    return F.regexp_replace(F.translate(x, *_fold_table()), r"\p{Mn}", "")


def normalize_text(x: Column) -> Column:
    """Lower case, white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def search_text(x: Column) -> Column:
    """Lower case, everything but letters, digits and _ to one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " "))


def folded_search_text(x: Column) -> Column:
    """Texts of ASCII alone have nothing to fold."""
    return F.when(F.octet_length(x) == F.length(x), search_text(x)).otherwise(fold(search_text(x)))


def punctuation_aware(x: Column) -> Column:
    """Each punctuation mark as a token of its own."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}_\s])", r" $1 "), r"\s+", " "))


def token_string(x: Column) -> Column:
    """Tokens with one space between."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_À-ỹ]+", " "))


def tokens(x: Column) -> Column:
    """Array of tokens; empty for null or blank text.  The text is cut once, at what token_string makes one space."""
    return F.array_remove(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_À-ỹ]+"), "")


def _grams(text: Column, low: int, high: int) -> Column:
    return let(text, lambda s: _grams_of(s, low, high))


def _grams_of(s: Column, low: int, high: int) -> Column:
    """By an array of characters, as a substring is counted from the start of its string."""
    none = F.array().cast("array<string>")
    of = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(none)
    return let(F.filter(F.split(s, ""), lambda x: x != ""), lambda c: F.array_distinct(F.concat(*(of(c, n) for n in range(low, high + 1)))))


def _first_grams(s: Column, low: int, high: int, cap: int | None) -> Column:
    """The grams that aren't blank, all or the first cap; longer ones are made only where the shortest are too few."""
    some = lambda a, b: F.filter(_grams(s, a, b), lambda g: F.trim(g) != "")
    if cap is None:
        return some(low, high)
    return let(some(low, low), lambda short: F.when(F.size(short) >= cap, F.slice(short, 1, cap)).otherwise(F.slice(some(low, high), 1, cap)))


def stored_grams(x: Column, low: int = 2, high: int = 4, cap: int = 64) -> Column:
    """Distinct character n-grams of the folded text with _ for spaces, without padding, the first cap."""
    return _first_grams(F.replace(folded_search_text(x), F.lit(" "), F.lit("_")), low, high, cap)


def gram_text(x: Column) -> Column:
    """The folded, space-padded text whose n-grams padded_grams gives."""
    return F.concat(F.lit(" "), folded_search_text(x), F.lit(" "))


def padded_grams(x: Column, low: int = 2, high: int = 4, cap: int | None = None) -> Column:
    """Distinct character n-grams of the folded, space-padded text, blank ones left out; all of them without a cap."""
    return _first_grams(gram_text(x), low, high, cap)


def _distinct_grams(s: str, low: int, high: int) -> int:
    codes, letters = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_inverse=True)
    blank = codes[letters] == 32
    n, keys, spaces = 0, letters.astype(np.int64), blank
    for size in range(1, min(high, len(s)) + 1):
        if size > 1:
            if len(codes) ** size >= 1 << 62:  # keys by their place, so that they can't overflow
                keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            keys, spaces = keys[:-1] * len(codes) + letters[size - 1 :], spaces[:-1] & blank[size - 1 :]
        if size >= low:
            ordered = np.sort(keys)
            n += 1 + int(np.count_nonzero(ordered[1:] != ordered[:-1])) - bool(spaces.any())
    return n


def count_grams(s: Column, low: int = 2, high: int = 4) -> Column:
    """How many distinct n-grams that aren't blank a text has, without making them; 0 for null."""
    return _count_grams(low, high)(s)


@lru_cache
def _count_grams(low: int, high: int):
    @F.pandas_udf(LongType())
    def count(x: pd.Series) -> pd.Series:
        return x.map(lambda t: _distinct_grams(t, low, high) if t else 0).astype("int64")

    return count


def field_tokens(field: Column, value: Column) -> Column:
    """Tokens of a field's value: stored grams for n-gram fields, words otherwise."""
    grams = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(value, GRAM_SEPARATOR))
    return F.when(field.endswith("char_ngrams"), grams).otherwise(tokens(value))


def quoted_phrases(x: Column) -> Column:
    """Phrases between straight or curly double quotes."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit('["“”]([^"“”]+)["“”]'), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")


def has_phrase(text_tokens: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens stand consecutively in the token string."""
    return (phrase != "") & F.concat(F.lit(" "), text_tokens, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance up to most; most + 1 beyond it."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def normalize_answer(x: Column) -> Column:
    """Numbers with a decimal point, yes and no in lower case, the rest trimmed."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[+-]?\d+,\d+$"), F.replace(t, F.lit(","), F.lit("."))).when(F.lower(t).isin("yes", "no", "có", "không"), F.lower(t)).otherwise(t)


def feedback_text(original: Column, refinements: Column, most: int = 64) -> Column:
    """The query and its refinements as labelled lines; null above most white-space tokens."""
    lines = F.concat_ws("\n", F.concat(F.lit("Original query: "), original), F.array_join(F.transform(refinements, lambda r, i: F.concat(F.lit("Refinement "), (i + 1).cast("string"), F.lit(": "), r)), "\n"))
    text = F.rtrim(lines, F.lit("\n"))
    return F.when(F.size(F.split(text, r"\s+")) <= most, text)


def index_name(x: Column) -> Column:
    """A name a search service takes: lower case, other characters to -, at most 200."""
    return F.substring(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9._-]+", "-"), F.lit("-")), 1, 200)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two strings; no built-in function has it."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def word_errors(a: Column, b: Column) -> Column:
    """Edit distance between the words of two texts, by the usual table as a fold over rows."""
    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda t: _word_errors(t["x"], t["y"]))


def _word_errors(x: Column, y: Column) -> Column:
    row0 = F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j)
    step = lambda row, w: F.aggregate(
        F.sequence(F.lit(1), F.size(y)),
        F.array(F.get(row, F.lit(0)) + 1),
        lambda acc, j: F.concat(acc, F.array(F.least(F.get(row, j) + 1, F.get(acc, j - 1) + 1, F.get(row, j - 1) + F.when(F.get(y, j - 1) == w, 0).otherwise(1)))),
    )
    return F.when(F.size(y) == 0, F.size(x)).when(F.size(x) == 0, F.size(y)).otherwise(F.element_at(F.aggregate(x, row0, step), -1))
