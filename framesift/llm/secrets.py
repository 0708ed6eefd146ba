"""Secret scans: fixed patterns, and a battery of randomness tests on unbroken strings.  DataFrame functions only.

Base spans are the matches of three patterns.  The battery takes each unbroken run of base64 characters of RUN or more
that mixes character classes, infers its encoding, and measures how random it is in that alphabet: chi-squared uniformity, runs of the alphabet's upper
and lower halves, and serial correlation, combined by Fisher's method.

A run is judged against ordinary text.  The null hypothesis is that it is text; its distribution comes from the corpus
itself: for each encoding and band of length that runs have, every whole document, outside of such runs, is cut end to end into
windows of its characters, which go through the same battery, as far as it takes to place them.  A run's p value is the share of windows that look as random as it
does.  By the Benjamini-Hochberg rule, in each encoding and band on its own (short strings have less power and are not
judged beside long ones), at most FALSE_DISCOVERY of the reported runs are text.  They are reported as kind random,
if no base span overlaps them.

Null texts count as empty and have no spans.  Texts of any length are read whole, in time in proportion to their length and
matches.  Repeated rows give repeated results and count as often in the rates.  Other columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

# Kinds in their order, and the patterns with the length that a match must have.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGN_LENGTH, RUN = 6, 20
_ANY_OF = "[A-Za-z0-9+/_=-]"
CANDIDATE = _ANY_OF + "{20,}"
FALSE_DISCOVERY, STEPS = 0.05, 10
#: Bands of length are from each of these to the next; the last has no end, and its windows are as long as twice its start at most.
BANDS = (20, 28, 40, 64, 128)
#: p values below 10 to the minus BINS / STEPS share a bin.
BINS = 400
#: One text in so many shows where a histogram may end; all are then counted.
_SHOWN = 64

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Alphabets of the encodings, in the order of their values.
ALPHABETS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    "lower": (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    "alnum": (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    "base64": (r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    "urlsafe": (r"^[A-Za-z0-9_=-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}


_SPAN = "array<struct<start:int,rank:int,end:int,body:string>>"


#: Matches of a text that are placed one after another; their blocks are then put in place.
_BLOCK = 64


def _let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Array of (start, rank, end, body) of a pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_SPAN)

    def local(block: Column) -> Column:
        """(length of the block, spans counted from its start); an array that grows is copied at each step, so blocks are short."""

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + x["gap"] + F.length(x["body"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["body"].alias("body")))).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        moved = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda x, at: F.transform(x["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["end"] + at).alias("end"), s["body"].alias("body"))))
        return F.flatten(moved)

    def place(m: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("gap"), x.alias("body")))
        cut = _let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda i: local(F.slice(p, i * _BLOCK + 1, F.lit(_BLOCK)))))
        return _let(cut, joined)

    spans = F.when(F.size(found) > 0, place(found)).otherwise(empty)
    return F.filter(spans, keep) if keep else spans


def _clipped(z: Column) -> Column:
    return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation) at a clipped z."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


#: Any character of a run, whatever its encoding; those outside of an alphabet have the value 0, those in it their place from 1.
_ANY = _UPPER + _LOWER + _DIGITS + "+/_=-"


def _by_encoding(encoding: Column, f) -> Column:
    """f(alphabet) of the encoding's alphabet."""
    return F.coalesce(*(F.when(encoding == n, f(a)) for n, (_, a) in ALPHABETS.items()))


def _size_of(encoding: Column) -> Column:
    return _by_encoding(encoding, lambda a: F.lit(float(len(a))))


def _halves_of(core: Column, encoding: Column) -> Column:
    """1 for each character in the alphabet's upper half, 0 for others."""
    upper = _by_encoding(encoding, lambda a: F.lit("".join("1" if a.find(c) + 1 > len(a) // 2 else "0" for c in _ANY)))
    return F.call_function("translate", core, F.lit(_ANY), upper)


def _squares(core: Column) -> Column:
    """The sum of the characters' squared counts."""
    size = F.octet_length(core)
    counts = F.transform(F.array_distinct(F.split(core, "")), lambda c: (size - F.octet_length(F.replace(core, c, F.lit("")))).cast("long"))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n * n).cast("double")


def _codes(core: Column, encoding: Column) -> Column:
    """The values of core's characters."""
    values = _by_encoding(encoding, lambda a: F.array(*(F.lit(a.find(chr(i)) + 1 if i else 0).cast("long") for i in range(128))))
    return _let(values, lambda v: F.transform(F.split(core, ""), lambda c: F.get(v, F.ascii(c))))


def _sums(codes: Column) -> dict[str, Column]:
    """Sums of products of neighbours, of values and of their squares; folds over single numbers, which cost much less than those over structs."""
    zero, low = F.lit(0).cast("long"), F.lit(127).cast("long")
    near = F.aggregate(codes, zero, lambda m, v: F.shiftleft(F.shiftright(m, 7) + m.bitwiseAND(low) * v, 7) + v)  # the last value in the low bits
    s1, s2 = F.aggregate(codes, zero, lambda m, v: m + v), F.aggregate(codes, zero, lambda m, v: m + v * v)
    return {"__near": F.shiftright(near, 7).cast("double"), "__s1": s1.cast("double"), "__s2": s2.cast("double")}


def _uniform(k: Column, n: Column, squares: Column) -> Column:
    """z of chi-squared, by its exact mean and variance; squares is the sum of the characters' squared counts."""
    return _clipped((k / n * squares - n - k + 1) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))


#: Characters that are counted first, the commonest of Latin text.  Others would prove the same of fewer windows.
_COMMON = "eainrtsoludc"


def battery(runs: DataFrame, enough: Column | None = None) -> DataFrame:
    """runs (with a column body) with encoding (inferred if they have none), p_uniform, p_runs, p_serial and p_random.

    Each test adds to Fisher's sum.  Where the first ones reach enough, the others are left out and p_random is null, as are p
    values that weren't computed: p_uniform falls as the sum of squared counts grows, which is at least that of some
    characters' counts and of one for each character besides; a p value is 1 at most.
    """
    encoding = F.lit(None).cast("string")
    for name, (form, _) in reversed(ALPHABETS.items()):
        encoding = F.when(F.col("body").rlike(form), F.lit(name)).otherwise(encoding)
    df = runs if "encoding" in runs.columns else runs.withColumn("encoding", F.coalesce(encoding, F.lit("urlsafe")))
    core = F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.rtrim("body", F.lit("=")))
    given, core, k, n, bits = df.columns, core.alias("__core"), F.col("__k"), F.greatest("__n", F.lit(2.0)), F.col("__bits")
    # each step is a column of its own: what is named more than once would else be computed as often
    df = df.select("*", core, _size_of(F.col("encoding")).alias("__k"), (F.lit(math.inf) if enough is None else enough).alias("__enough"))
    df, core = df.withColumn("__n", F.length("__core").cast("double")), F.col("__core")
    z, mean, ones, near, s1, s2 = (F.col(c) for c in ("__z", "__mean", "__ones", "__near", "__s1", "__s2"))
    still = lambda reached: F.when(reached < F.col("__enough"), core)
    without = lambda text, part: (F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))).cast("double")
    if enough is not None:
        cased = lambda c: F.when(F.col("encoding") == "base32", F.lit(c.upper())).otherwise(F.lit(c))
        df = df.select("*", *(without(core, cased(c)).alias(f"__{i}") for i, c in enumerate(_COMMON)))
        squares = sum((F.col(f"__{i}") * (F.col(f"__{i}") - 1) for i in range(len(_COMMON))), F.col("__n"))
        df = df.withColumn("__z", _uniform(k, n, squares)).withColumn("__least", -2 * F.log(_tail(z))).withColumn("__core", still(F.col("__least")))
    # runs of the two halves of the alphabet
    df = df.withColumn("__bits", _halves_of(core, F.col("encoding")))
    df = df.withColumns({"__ones": without(bits, F.lit("1")), "__runs": 1 + (without(bits, F.lit("01")) + without(bits, F.lit("10"))) / 2})
    df = df.withColumn("__mean", 2 * ones * (n - ones) / n + 1)
    df = df.withColumn("__z", _clipped(F.abs(F.col("__runs") - mean) / F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))))
    df = df.withColumn("p_runs", F.when(core.isNotNull(), F.least(F.lit(1.0), 2 * _tail(z))))
    if enough is not None:
        df = df.withColumn("__core", still(F.col("__least") - 2 * F.log("p_runs")))
    # chi-squared
    df = df.withColumn("__squares", _squares(core)).withColumn("__z", _uniform(k, n, F.col("__squares")))
    df = df.withColumn("p_uniform", F.when(core.isNotNull(), _tail(z)))
    if enough is not None:
        df = df.withColumn("__core", still(-2 * (F.log("p_uniform") + F.log("p_runs"))))
    # lag-one correlation of the characters' values
    df = df.withColumn("__codes", _codes(core, F.col("encoding"))).withColumns({**_sums(F.col("__codes")), "__ends": F.get("__codes", F.lit(0)) + F.element_at("__codes", -1)})
    df, mu = df.withColumn("__mean", s1 / n), mean
    df = df.withColumns({"__near": near - mu * (2 * s1 - F.col("__ends")) + (n - 1) * mu * mu, "__spread": F.greatest(F.lit(0.0), s2 - n * mu * mu)})
    df = df.withColumn("__r", F.coalesce(F.try_divide("__near", "__spread"), F.lit(1.0))).withColumn("__z", _clipped(F.abs(F.col("__r") + 1 / n) * F.sqrt(n)))
    df = df.withColumn("p_serial", F.when(core.isNotNull(), F.least(F.lit(1.0), 2 * _tail(z))))
    # Fisher's method for three tests
    df, x = df.withColumn("__x", -2 * (F.log("p_uniform") + F.log("p_runs") + F.log("p_serial"))), F.col("__x")
    return df.select(*given, "p_uniform", "p_runs", "p_serial", (F.exp(-x / 2) * (1 + x / 2 + x * x / 8)).alias("p_random"))


def _band() -> Column:
    band = F.lit(0)
    for k, least in enumerate(BANDS[1:]):
        band = F.when(F.length("body") >= least, k + 1).otherwise(band)
    return band


def binned(runs: DataFrame) -> DataFrame:
    """tested runs with band (of the length of body) and bin: the less random a run looks, the higher; BINS where p_random is null."""
    return runs.withColumn("band", _band()).withColumn("bin", F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.coalesce("p_random", F.lit(0.0)), F.lit(1e-300))) * STEPS)).cast("int"))


def _least_sum(last: int) -> float:
    """From this on, Fisher's sum of -2 log p gives a bin above last, whatever the rounding."""
    lo, hi = 0.0, 2000.0
    for _ in range(100):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if (x / 2 - math.log(1 + x / 2 + x * x / 8)) / math.log(10) * STEPS < last + 1 else (lo, x)
    return hi + 1e-6


def binned_within(windows: DataFrame, last: dict[tuple[str, int], int]) -> DataFrame:
    """windows (encoding, body) with band and bin: that of binned(battery(windows)) where it is last[encoding, band] at most, else
    that or BINS."""
    enough = F.coalesce(*(F.when((F.col("encoding") == e) & (_band() == b), F.lit(_least_sum(x))) for (e, b), x in last.items()))
    return binned(battery(windows, enough))


#: Every encoding and band.
CELLS = [(name, band) for name in ALPHABETS for band in range(len(BANDS))]


def text_windows(texts: DataFrame, cells: list[tuple[str, int]] = CELLS) -> DataFrame:
    """texts (doc_id, text): encoding and body of windows of each text's own characters, for each (encoding, band) of cells.

    A whole text's characters of the alphabet are cut end to end; the last window ends with the text and reaches back into the
    one before, so that each character lies in one.  The length, within the band, follows from a hash of the row; a text
    with fewer characters is one window, and one with too few for the band has none.
    Words are joined as in names, with a capital each where the alphabet has both cases, and two digits in the middle: the
    runs to be judged mix classes too.
    """
    row = F.xxhash64("doc_id", F.octet_length("text"))
    plain = texts.select(row.alias("row"), F.regexp_replace("text", f"(?<!{_ANY_OF}){CANDIDATE}", "").alias("text"))
    folded = {"hex": F.lower("text"), "base32": F.upper("text"), "lower": F.lower("text")}
    held = []
    for name, (_, alphabet) in ALPHABETS.items():
        if bands := [b for e, b in cells if e == name]:
            core = F.regexp_replace(folded.get(name, F.initcap("text")), f"[^{''.join('\\-' if c == '-' else c for c in alphabet)}]+", "")
            held.append(F.struct(F.lit(name).alias("encoding"), core.alias("core"), F.array(*map(F.lit, bands)).alias("bands")))
    each = plain.select("row", F.inline(F.array(*held))).select("row", "encoding", "core", F.explode("bands").alias("band"))
    least, room = (F.array(*(F.lit(x) for x in v)) for v in (BANDS, [b - a for a, b in zip(BANDS, [*BANDS[1:], 2 * BANDS[-1]], strict=True)]))
    draw = lambda n, *salt: F.pmod(F.xxhash64("row", "encoding", "band", *salt), n).cast("int")
    # without the two digits
    each = each.withColumn("whole", F.length("core")).where(F.col("whole") >= F.get(least, "band") - 2)
    each = each.withColumn("size", F.least(F.get(least, "band") + draw(F.get(room, "band")) - 2, F.col("whole")))
    cut = F.regexp_extract_all("core", F.concat(F.lit(".{"), F.col("size").cast("string"), F.lit("}")), F.lit(0))
    last = F.when(F.col("whole") % F.col("size") > 0, F.array(F.substring("core", F.col("whole") - F.col("size") + 1, F.col("size")))).otherwise(F.array().cast("array<string>"))
    windows = each.select("row", "encoding", "band", "size", F.posexplode(F.concat(cut, last)).alias("at", "window"))
    half, digits = F.floor((F.col("size") + 2) / 2).cast("int"), F.lpad((F.lit(2) + draw(F.lit(6), F.col("at"))).cast("string"), 2, "7")
    return windows.select("encoding", F.concat(F.substring("window", F.lit(1), half), digits, F.substring("window", half + 1, F.col("size"))).alias("body"))


def _histogram(rows: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
    """Rows by bin for each (encoding, band): 30 cells and BINS + 1 bins at most leave the executors."""
    out: dict = {}
    for r in rows.groupBy("encoding", "band", "bin").count().collect():
        out.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
    return out


def accepted_bins(runs: dict, text: dict, rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], int]:
    """For each (encoding, band), the last bin of its runs that the Benjamini-Hochberg rule accepts as not text (-1: none), of
    histograms of the runs and the windows."""
    out = {}
    for cell, counts in runs.items():
        own = text.get(cell, {})
        total, windows = sum(counts.values()), sum(own.values())
        out[cell] = -1
        for b in counts:
            found, passed = (sum(n for x, n in h.items() if x <= b) for h in (counts, own))
            if (passed + 1) / (windows + 1) <= rate * found / total:
                out[cell] = max(out[cell], b)
    return out


def text_bins(texts: DataFrame, runs: dict, rate: float = FALSE_DISCOVERY) -> dict[tuple[str, int], dict[int, int]]:
    """The histogram of all windows of texts for each cell of runs, exact up to the last bin that accepted_bins can accept.

    No run has a bin above its cell's largest, and none is accepted where more than rate of the windows have passed.  Where that
    is follows from the windows themselves: some of the texts only show where to look, and a cell in which too few windows
    passed up to there is done again in full.
    """
    shown = _histogram(binned(battery(text_windows(texts.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(_SHOWN)) == 0), list(runs)))))
    last = {}
    for cell, counts in runs.items():
        own, passed, last[cell] = shown.get(cell, {}), 0, max(counts)
        for b in sorted(own):
            passed += own[b]
            if passed >= 1.5 * rate * sum(own.values()):
                last[cell] = min(last[cell], b)
                break
    text = _histogram(binned_within(text_windows(texts, list(runs)), last))
    passed = lambda cell: sum(n for b, n in text.get(cell, {}).items() if b <= last[cell])
    again = [c for c, counts in runs.items() if last[c] < max(counts) and passed(c) + 1 <= rate * (sum(text.get(c, {}).values()) + 1)]
    return {**text, **_histogram(binned(battery(text_windows(texts, again))))} if again else text


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans of each row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast(_SPAN)
    # every match of access and hex lies in a candidate run, so texts without one need no more patterns
    found = texts.withColumn("assign", _spans(F.col("text"), ASSIGN, 0, lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= ASSIGN_LENGTH)).withColumn("runs", _spans(F.col("text"), CANDIDATE, 3))
    some = F.size("runs") > 0
    found = found.withColumn("access", F.when(some, _spans(F.col("text"), ACCESS, 1)).otherwise(none)).withColumn("hex", F.when(some, _spans(F.col("text"), HEX, 2)).otherwise(none))
    # numbered once, in the stored table: nothing below depends on how a scan is split
    found = durable(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "runs", *(F.transform(k, lambda s: s.dropFields("body")).alias(k) for k in KINDS[:3])), "spans")

    mixed = F.col("body").rlike("[0-9]") & F.col("body").rlike("[A-Za-z]") & (F.col("body").rlike("^(?:[0-9a-f]+|[0-9A-F]+|[A-Z2-7]+=*|[a-z0-9]+)$") | (F.col("body").rlike("[a-z]") & F.col("body").rlike("[A-Z]")))
    tested = battery(found.select("row", F.explode("runs").alias("s")).select("row", "s.start", "s.end", "s.body"))
    tested = durable(binned(tested.where(mixed)).select("row", "start", "end", "encoding", "band", "bin"), "tested")
    # other windows have no run to judge
    judged = _histogram(tested)
    limits = accepted_bins(judged, text_bins(texts, judged)) if judged else {}
    limit = F.create_map(*(F.lit(x) for (e, b), last in limits.items() for x in (f"{e} {b}", last)))[F.concat_ws(" ", "encoding", "band")] if limits else F.lit(-1)
    random = tested.where((F.col("bin") <= limit)).select("row", "start", "end")
    random = _apart(random, found).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias("random"))
    # rows without a run are left out of the join
    both = found.drop("runs").join(random, "row", "left").withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    both = both.withColumn("random", F.coalesce("random", F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(F.encode(text("base"), "UTF-8"), 256).alias("base_sha256"), F.size("random").cast("long").alias("n_random"), text(F.array_sort(F.concat("base", "random"))).alias("spans"))


def _apart(random: DataFrame, found: DataFrame) -> DataFrame:
    """random (row, start, end) without those that a base span overlaps: of the spans that begin before one's end, none reaches
    behind its start.  One ordered pass over a row's spans."""
    base = found.join(random.select("row").distinct(), "row", "left_semi").select("row", F.explode(F.concat("assign", "access", "hex")).alias("s"))
    both = base.select("row", (2 * F.col("s.start")).alias("at"), "s.start", "s.end", F.lit(False).alias("asked")).unionByName(random.select("row", (2 * F.col("end") - 1).alias("at"), "start", "end", F.lit(True).alias("asked")))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~F.col("asked"), F.col("end"))).over(before)
    return both.withColumn("reach", F.coalesce(reach, F.lit(0))).where("asked and reach <= start").select("row", "start", "end")
