"""Line dedup by a log-template tree.  DataFrame functions only.

A text is parsed into lines: its line-end-terminated lines, cut further after sentence ends; empty lines belong to the
line before them.  A line's tokens are its parts between white space, and a token with a digit is a variable field.
A line walks down a tree of fixed depth, by its number of tokens and its DEPTH leading tokens, to a leaf.  In a leaf,
lines of ALONE tokens or more are one template when, of the PARTS equal stretches of their other tokens, all but one at
most agree: the stretch that differs is generalised.  So any one token, and any run of them inside a stretch, may vary.

A template that recurs across documents stays in the document with the smallest doc_id and is dropped from the others.
Lines of fewer than ALONE tokens are templates as they stand.  One of LONG characters goes like any other.  A
shorter one recurs by chance too, so it needs evidence: MANY documents that hold it (COMMON, below LEAST tokens), or a
neighbouring line with which it recurs as a pair.

Leaves that only one document reaches, which are most, are put aside by one aggregation; the rest of the work is on
lines whose leaf several documents reach.  What is broadcast is a filter of FILTER_BITS bits, whatever the input; a
full one only lets more rows through to the joins behind it.

Null texts stay null, an empty text stays empty.  Rows that repeat a doc_id are one document here; rows without a doc_id come
last, as one document.  Texts of any length are read whole, in time in proportion to their length; the rest of a text
keeps its bytes.  Other columns pass through, whatever their names.  Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, durable, has_bit, named_rows, release, same_word

LEAST, ALONE, DEPTH, PARTS = 4, 8, 2, 4  # PARTS is in the code of parsed too
#: Characters from which a line is no chance repeat, however few tokens it has; documents that show the same of a shorter line.
LONG, MANY, COMMON = 40, 10, 100
LINE_ENDS = r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)"
FIELD = r"\S*[0-9]\S*"
#: Kinds of lines: without a token, below LEAST tokens, below ALONE, as short but of LONG characters, of ALONE tokens or more.
BLANK, TINY, SHORT, WIDE, FULL = -1, 0, 1, 2, 3
_CUT = "\x01"
_LAST = (1 << 63) - 1
_LOW = (1 << 32) - 1
ROW = ["__file", "__place"]
HASHES = ("leaf", "check", "a", "b", "pair")


def lines_of(text: Column, newline: str = "\n") -> Column:
    """Lines and sentences, each with what ends it.  A mark that the text doesn't hold is put after each end, which is much
    cheaper than a pattern; texts with the mark go by the pattern, and keep their newlines.  In others newline stands for each."""
    marked = text
    for end in (". ", "! ", "? "):  # a replacement costs some six times the test; an empty string is not looked for
        marked = F.replace(marked, F.when(text.contains(end), F.lit(end)).otherwise(F.lit("")), F.lit(end + _CUT))
    ended = F.replace(F.replace(marked, F.lit("\n"), F.lit("\n" + _CUT)), F.lit(_CUT + "\n"), F.lit("\n"))
    ended = ended if newline == "\n" else F.replace(ended, F.lit("\n"), F.lit(newline))
    blank = text.contains("\n\n") | text.contains(" \n")  # in other texts no end stands before a newline
    marked = F.when(blank, ended).otherwise(F.replace(marked, F.lit("\n"), F.lit(newline + _CUT)))
    return F.when(text.contains(_CUT), F.split(text, LINE_ENDS, -1)).otherwise(F.split(marked, _CUT, -1))


def squeezed(line: Column, odd: Column) -> Column:
    """Without the white space around it, and with one space for any inside it; odd lines may hold more than single spaces."""
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(F.trim(line))


def _upto(line: Column, n: Column | int) -> Column:
    """The first n tokens; the last -n for a negative n."""
    return F.call_function("substring_index", line, F.lit(" "), F.lit(n) if isinstance(n, int) else n)


def _pair(a: Column, b: Column) -> Column:
    """Two 32-bit hashes as one number."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(_LOW)))


def parsed(rows: DataFrame) -> DataFrame:
    """Row, __key, pos, kind, leaf, and the hashes (a, b) of the stretches of lines of ALONE tokens, for each line.

    check is a second hash of a short line, so that nothing is dropped on 64 bits alone; longer ones have their stretches."""
    text = F.col("__text")
    # what holds for a whole text is asked once for all of its lines, before these are made
    odd = text.contains(_CUT) | text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\n ") | text.contains(" \n")
    rows = rows.select(*ROW, "__key", odd.alias("odd"), text.rlike("[0-9]").alias("digits"), lines_of(text, " ").alias("lines"))
    lines = rows.select(*ROW, "__key", "odd", "digits", F.posexplode_outer("lines").alias("pos", "line"))  # not outer, Spark would cut texts again to filter them
    lines = lines.withColumn("line", squeezed(F.col("line"), F.col("odd")))
    lines = lines.withColumn("line", F.when(F.col("digits") & F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, "<*>")).otherwise(F.col("line")))
    n, line = F.col("n"), F.col("line")
    lines = lines.withColumn("n", F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    ends = [F.expr(f"cast({DEPTH} + (n - {DEPTH}) * {k} div {PARTS} as int)") for k in range(PARTS + 1)]
    full = n >= ALONE
    # each half is found once for its two stretches; the leading tokens may stay in the first, as they are the same in a leaf
    lines = lines.withColumn("left", F.when(full, _upto(line, ends[2]))).withColumn("right", F.when(full, _upto(line, ends[2] - n)))
    stretch = [F.hash(_upto(F.col(half), m)) for half, m in (("left", ends[1]), ("left", ends[1] - ends[2]), ("right", ends[3] - ends[2]), ("right", ends[3] - n))]
    kind = F.when(full, FULL).when(F.length(line) >= LONG, WIDE).when(n >= LEAST, SHORT).when(line != "", TINY).otherwise(BLANK).cast("byte")
    leaf = F.when(full, F.xxhash64(n, _upto(line, DEPTH))).otherwise(F.xxhash64(line))
    a, b = (F.when(full, _pair(*stretch[k : k + 2])) for k in (0, 2))
    return lines.select(*ROW, "__key", "pos", kind.alias("kind"), leaf.alias("leaf"), F.when(full, 0).otherwise(F.hash(line)).alias("check"), a.alias("a"), b.alias("b"))


def _recurring(rows: DataFrame, *by: str) -> DataFrame:
    """Groups that several documents share, with the owner; aggregated before its shuffle.  Written before it is joined, so that
    the rows of a hot group can be split."""
    return rows.groupBy(*by).agg(F.min("__key").alias("owner"), F.max("__key").alias("last"), F.count("*").alias("lines")).where("owner < last").drop("last")


def _alike(met: DataFrame) -> DataFrame:
    """Lines of ALONE tokens whose template an earlier document has too: the stretches but for each one in turn are compared."""
    a, b, high = F.col("a"), F.col("b"), F.lit(-1 - _LOW)
    masks = [(a.bitwiseAND(F.lit(_LOW)), b), (a.bitwiseAND(high), b), (a, b.bitwiseAND(F.lit(_LOW))), (a, b.bitwiseAND(high))]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("a"), y.alias("b")) for i, (x, y) in enumerate(masks))))
    rows = met.where(F.col("kind") == FULL).select(*ROW, "__key", "pos", "leaf", each.alias("m"))
    rows = rows.select(*ROW, "__key", "pos", F.xxhash64("leaf", "m.i", "m.a", "m.b").alias("mask"), F.hash("m.b", "m.a", "leaf").alias("check"))
    masks = durable(_recurring(rows, "mask", "check").drop("lines"), "masks")
    return rows.join(masks.hint("shuffle_hash"), ["mask", "check"]).where("__key > owner").select(*ROW, "pos")


def _common(met: DataFrame) -> DataFrame:
    """Short lines that many documents hold, but for the first of these."""
    many = F.when(F.col("kind") == TINY, COMMON).otherwise(MANY)
    often = met.where((F.col("kind") <= SHORT) & (F.col("lines") >= many))
    # documents are counted, not lines: one row a document, aggregated before its shuffle
    held = often.groupBy("leaf", "check", "__key").agg(F.first("kind").alias("kind")).groupBy("leaf", "check").agg(F.count("*").alias("held"), F.min("__key").alias("first"), F.first("kind").alias("kind"))
    held = durable(held.where(F.col("held") >= many).select("leaf", "check", "first"), "common")
    # few lines are that common, so most of the others are not shuffled
    often = often.join(bit_filter(held, "leaf"), same_word("leaf") & has_bit("leaf")).drop("__word", "__bits")
    return often.join(held.hint("shuffle_hash"), ["leaf", "check"]).where("__key > first").select(*ROW, "pos")


def _pairs(met: DataFrame) -> DataFrame:
    """Row, __key, pos, kind, kind2, pair and check of neighbouring lines, one of them short."""
    after = Window.partitionBy(*reversed(ROW)).orderBy("pos")
    two = met.select(*ROW, "__key", "pos", "kind", "leaf", *(F.lead(c).over(after).alias(f"{c}2") for c in ("pos", "kind", "leaf")))
    two = two.where((F.col("pos2") == F.col("pos") + 1) & (F.least("kind", "kind2") <= SHORT))
    return two.select(*ROW, "__key", "pos", "kind", "kind2", F.xxhash64("leaf", "leaf2").alias("pair"), F.hash("leaf2", "leaf").alias("check"))


def _paired(pairs: DataFrame) -> DataFrame:
    """Short lines that recur together with the line before or after them."""
    twice = durable(_recurring(pairs, "pair", "check").drop("lines"), "twice")
    hits = pairs.join(twice.hint("shuffle_hash"), ["pair", "check"]).where("__key > owner")
    members = F.filter(F.array(F.when(F.col("kind") <= SHORT, F.col("pos")), F.when(F.col("kind2") <= SHORT, F.col("pos") + 1)), lambda p: p.isNotNull())
    return hits.select(*ROW, F.explode(members).alias("pos"))


def _bits(hits: DataFrame) -> DataFrame:
    """Row, __lost, how many of its lines are among hits, and __gone, a bit for each line up to the last of these, 64 in a number."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))
    words = hits.groupBy(*ROW, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = words.groupBy(*ROW).agg(F.sum(F.bit_count("bits")).alias("__lost"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at.word", F.lit(1), F.size("at") - 1))
    gone = F.flatten(F.zip_with(before, "at", lambda p, q: F.concat(F.array_repeat(F.lit(0).cast("long"), q["word"] - p - 1), F.array(q["bits"]))))
    return rows.select(*ROW, "__lost", gone.alias("__gone"))


def dropped_lines(rows: DataFrame) -> DataFrame:
    """Row, __lost, how many lines it loses, and __gone, which ones as bits, for rows that lose any."""
    parse = durable(parsed(rows), "lines", HASHES)
    lines = parse.where(F.col("kind") > BLANK)
    leaves = durable(_recurring(lines, "leaf", "check"), "leaves")
    several = lines.join(bit_filter(leaves, "leaf"), same_word("leaf") & has_bit("leaf")).join(leaves.hint("shuffle_hash"), ["leaf", "check"])
    met = durable(several.select(*ROW, "__key", "pos", "kind", "leaf", "check", "a", "b", "owner", "lines"), "met", HASHES)
    release(parse)
    pairs = durable(_pairs(met), "pairs", HASHES)
    wide = met.where((F.col("kind") == WIDE) & (F.col("__key") > F.col("owner"))).select(*ROW, "pos")
    hits = wide.unionByName(_alike(met)).unionByName(_common(met)).unionByName(_paired(pairs))
    hits = durable(_bits(hits), "hits")
    for used in (leaves, met, pairs):
        release(used)
    return hits


def rebuilt(text: Column, gone: Column) -> Column:
    """The text without the lines whose bits are set in gone, a column as it was read: each line would compute an expression again."""
    stays = lambda k: F.getbit(F.coalesce(F.get(gone, F.shiftright(k, 6)), F.lit(0).cast("long")), k.bitwiseAND(F.lit(63))) == 0
    return F.array_join(F.filter(lines_of(text), lambda line, k: stays(k)), "")


def marked(documents: DataFrame, carried: list[str]) -> DataFrame:
    """The columns carried as struct doc, __lost, how many lines went (null for none), and __kept, the text that stays, of each row."""
    documents, file, place = named_rows(documents)
    others = F.struct(F.lit(0).alias(""), *(F.col(f"`{c}`") for c in carried))
    rows = documents.select(file.alias("__file"), place.alias("__place"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__key"), F.col("text").cast("string").alias("__text"), others.alias("doc"))
    hits = dropped_lines(rows)
    # texts without a hit are not shuffled, but for those that the filter lets through
    own, name = F.col("__text"), F.xxhash64(*ROW)
    tested = rows.drop("__key").withColumn("__name", name).join(bit_filter(hits.select(name.alias("__name")), "__name"), same_word("__name"), "left")
    apart = tested.where(~has_bit("__name")).select("doc", F.lit(None).cast("long").alias("__lost"), own.alias("__kept"))
    met = tested.where(has_bit("__name")).select(*ROW, "doc", "__text").join(hits.hint("shuffle_hash"), ROW, "left")
    return apart.unionByName(met.select("doc", "__lost", F.when(F.col("__lost").isNotNull(), rebuilt(own, F.col("__gone"))).otherwise(own).alias("__kept")))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_dropped and the text that stays, for each row of documents."""
    return marked(documents, ["doc_id"]).select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("__lost", F.lit(0).cast("long")).alias("n_dropped"), F.col("__kept").alias("text"))


def drop_lines(documents: DataFrame) -> DataFrame:
    """documents without their recurring lines; rows whose every word went are left out.  n_chars follows the text."""
    lost = F.col("__lost").isNotNull()
    out = marked(documents, [c for c in documents.columns if c != "text"]).where(~lost | F.col("__kept").rlike(r"\S"))
    n_chars = F.when(lost, F.length("__kept").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in documents.columns else None
    return out.select(*(F.col("__kept").alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in documents.columns))
