"""Scalar functions on times, boxes, labels, ids, vectors and paths as Column builders."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body uses it inside a function of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- numbers and times


def fraction(x: Column) -> Column:
    """"a/b" or "a" as a double; null where b is 0 or it doesn't parse."""
    parts = F.split(F.trim(x), "/")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))


def pts_to_ms(pts: Column, time_base: Column, truncate: bool = False) -> Column:
    """pts * time base in ms: half-even rounding, or truncation for refinement."""
    parts = F.split(time_base, "/")
    exact = pts.cast("decimal(20,0)") * F.get(parts, F.lit(0)).cast("decimal(9,0)") * 1000 / F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).cast("decimal(9,0)")
    return (F.floor(exact) if truncate else F.bround(exact)).cast("long")


def optional_long(x: Column) -> Column:
    return F.trim(x).try_cast("long")


def optional_double(x: Column) -> Column:
    d = F.trim(x).try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def probability(x: Column) -> Column:
    """A number clamped to [0, 1]; null where it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), optional_double(x)))


def adaptive_radius(confidence: Column, low: int = 2000, high: int = 8000, budget: int | None = None) -> Column:
    """Search radius that shrinks with confidence (null counts as one half), within half of the budget."""
    r = F.floor(F.lit(low) + F.lit(high - low) * (1 - F.coalesce(confidence, F.lit(0.5)))).cast("long")
    return F.least(r, F.lit(budget // 2)) if budget else r


def json_safe(x: Column) -> Column:
    """A double without NaN or infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


# ---------------------------------------------------------------- boxes

REGIONS_Y, REGIONS_X = ("top", "middle", "bottom"), ("left", "center", "right")


def box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """A box in unit coordinates: pixels scaled, corners put in order, clamped to [0, 1]."""
    w, h = width if width is not None else F.lit(1.0), height if height is not None else F.lit(1.0)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    a, b, c, d = unit(x1 / w), unit(y1 / h), unit(x2 / w), unit(y2 / h)
    return F.struct(F.least(a, c).alias("x1"), F.least(b, d).alias("y1"), F.greatest(a, c).alias("x2"), F.greatest(b, d).alias("y2"))


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def region(x: Column, y: Column) -> Column:
    """The cell of a 3 x 3 grid, as top_left to bottom_right."""
    third = lambda v, names: F.when(v < 1 / 3, names[0]).when(v < 2 / 3, names[1]).otherwise(names[2])
    return F.concat_ws("_", third(y, REGIONS_Y), third(x, REGIONS_X))


# ---------------------------------------------------------------- ids, labels and paths


def youtube_id(x: Column) -> Column:
    """A bare id of 6 to 20 characters, or the one in a watch, short, embed or youtu.be address."""
    t = F.trim(x)
    url = F.coalesce(F.nullif(F.regexp_extract(t, r"[?&]v=([A-Za-z0-9_-]{6,20})", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?:youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{6,20})", 1), F.lit("")))
    return F.when(t.rlike(r"^[A-Za-z0-9_-]{6,20}$"), t).otherwise(url)


def tags(x: Column) -> Column:
    """Tags from a JSON list or from a string cut at , ; or |."""
    parts = F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>")).otherwise(F.split(x, r"[,;|]"))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def alias_variants(x: Column) -> Column:
    """Ways a video may be named: as given, lower case, base name, stem, video id; in that order, distinct."""
    t = F.trim(x)
    base = F.regexp_extract(t, r"([^/\\]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.array_distinct(F.filter(F.array(t, F.lower(t), base, F.lower(base), stem, F.lower(stem), youtube_id(t)), lambda v: v.isNotNull() & (v != "")))


def label(x: Column) -> Column:
    """Lower case, _ to space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("_"), F.lit(" ")), r"\s+", " "))


def canonical_label(x: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a label by a small alias table; the label itself where there is none."""
    if not aliases:
        return label(x)
    table = F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv))
    return F.coalesce(table[label(x)], label(x))


def safe_path(x: Column) -> Column:
    """Whether a path is relative, without drive or parent parts."""
    return F.coalesce((x != "") & ~x.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def evidence_id(kind: str, video: Column, frame: Column, position: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), video, frame.cast("string"), position.cast("string"))


def first_of(df_columns: list[str], names: list[str]) -> Column:
    """The first non-empty of several columns, by name without regard to case."""
    by = {c.lower(): c for c in df_columns}
    found = [F.nullif(F.trim(F.col(f"`{by[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in by]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# ---------------------------------------------------------------- vectors and hashes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    return let(F.struct(a.alias("v"), norm(a).alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """Normalised alpha * a + (1 - alpha) * b."""
    return unit(F.zip_with(a, b, lambda x, y: F.lit(alpha) * x.cast("double") + F.lit(1 - alpha) * y.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def _bits(flags: Column) -> Column:
    """Flags as the bits of a number, the first the highest; at most 64."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda n, b: F.shiftleft(n, 1).bitwiseOR(b.cast("long")))


def dhash(gray: Column, width: int) -> Column:
    """Difference hash of grey values, row by row with width values a row: whether each value exceeds the one to its left."""
    here = F.transform(F.sequence(F.lit(0), F.size(gray) - 1), lambda i: F.struct(i.alias("i"), F.get(gray, i).alias("v"), F.get(gray, i - 1).alias("left")))
    return _bits(F.transform(F.filter(here, lambda x: x["i"] % width > 0), lambda x: x["v"] > x["left"]))


def phash(gray: Column, dimension: int = 32, size: int = 8) -> Column:
    """Perceptual hash of dimension x dimension grey values: which of the size x size lowest cosine coefficients exceed the median of
    those below the first row."""
    scale = lambda k: (1 / dimension if k == 0 else 2 / dimension) ** 0.5
    waves = [[scale(k) * math.cos(math.pi * (2 * i + 1) * k / (2 * dimension)) for i in range(dimension)] for k in range(size)]
    table = F.array(*(F.array(*(F.lit(x) for x in w)) for w in waves))
    rows = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda r: F.slice(gray, r * dimension + 1, F.lit(dimension)))
    across = F.transform(rows, lambda r: F.transform(table, lambda w: dot(r, w)))  # dimension x size
    down = lambda a: F.flatten(F.transform(table, lambda w: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: dot(F.transform(a, lambda r: F.get(r, c)), w))))
    low = let(across, down)
    middle = lambda x: let(F.array_sort(F.slice(x, F.lit(size + 1), F.lit(size * (size - 1)))), lambda s: (F.get(s, F.lit(size * (size - 1) // 2 - 1)) + F.get(s, F.lit(size * (size - 1) // 2))) / 2)
    return let(F.struct(low.alias("x"), middle(low).alias("m")), lambda s: _bits(F.transform(s["x"], lambda v: v > s["m"])))


def fingerprint(settings: dict[str, object], *parts: str) -> str:
    """SHA-256 of settings by their names, and of other fingerprints; a missing part is an error."""
    if any(not p for p in parts):
        raise ValueError("a fingerprint is missing")
    text = json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return hashlib.sha256("\n".join([text, *parts]).encode()).hexdigest()


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    c = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(c, F.sqrt(total(a) * total(b))), F.lit(0.0))))


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's canonical JSON (the columns in the order of their names)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def ordered_digest(digest: Column, order: Column) -> Column:
    """Aggregate: SHA-256 of digests joined by line ends, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), digest.alias("d")))), lambda x: x["d"]), "\n"), 256)
