"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells source x language x topic are raked until their sums along each of the three match its target
weights; documents are then sampled with the cells' calibrated probabilities.  DataFrame functions only.

A cell is a row, aggregated before its shuffle, so there may be any number of sources and languages.  With up to FEW pairs of
a language and a topic, a round of fitting is one job: sources are raked where they lie, and the driver keeps the pairs'
factors.  With more, each margin is raked by an aggregation and a join, and the driver sees a round's largest error alone.
Both give the same fit.  The fitted ratios of wanted weight to tokens are scaled to probabilities so that all but HELD of the weight stays below 1, where the rest
is held.

A null in source or lang is a value of its own, apart from an empty string.  The topic is the column topic if there is one
(null: the form of the text), else the text's form.  A null or empty text has no tokens, is in no cell's weight and is kept.
Texts of any length are read whole.  Repeated rows are sampled alike; rows without a doc_id go by their text.  Other
columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release

MARGINS = ("source", "lang", "topic")
CELL = [f"__{m}" for m in MARGINS]
#: The power by which a margin's own shares are smoothed to its targets; rounds at most; error at which they end.
SMOOTH, ROUNDS, CLOSE = 0.9, 30, 1e-4
#: Pairs of a language and a topic up to which their factors are kept by the driver.
FEW = 256
#: Share of the wanted weight that may lie in cells whose probability is held at 1.
HELD = 0.05


def topic_of(text: Column) -> Column:
    """A document's topic by its form."""
    lines = F.size(F.split(text, "\n"))
    return F.when(text.contains(" | "), "table").when(F.octet_length(text) < 400, "note").when(lines * 60 > F.octet_length(text), "list").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """White-space tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _named(value: Column) -> Column:
    """A value's name: nulls have one too, which no string has."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def measured(documents: DataFrame) -> DataFrame:
    """documents as struct doc, with __source, __lang, __topic and __tokens."""
    text = F.col("text").cast("string")
    form = topic_of(F.coalesce(text, F.lit("")))
    topic = F.coalesce(F.col("topic").cast("string"), form) if "topic" in documents.columns else form
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    return documents.select(whole.alias("doc"), _named(F.col("source")).alias("__source"), _named(F.col("lang")).alias("__lang"), _named(topic).alias("__topic"), tokens_of(text).alias("__tokens"))


def _goals(cells: DataFrame, margin: str, power: float, given: dict[str | None, float] | None) -> DataFrame:
    """(margin, goal): the wanted share of each of a margin's values, given by name or the own share smoothed by power."""
    sums = cells.groupBy(f"__{margin}").agg(F.sum("tokens").alias("tokens"))
    if given is not None:
        names = F.array(*(F.struct(F.lit("null" if k is None else f"={k}").alias("name"), F.lit(float(v)).alias("goal")) for k, v in given.items()))
        names = cells.sparkSession.range(1).select(F.inline(names))
        goals = sums.join(names, F.col(f"__{margin}") == F.col("name"), "left").select(f"__{margin}", F.coalesce("goal", F.lit(0.0)).alias("goal"))
    else:
        goals = sums.select(f"__{margin}", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(0.0).alias("goal"))
    whole = goals.agg(F.sum("goal").alias("whole"))
    return durable(goals.join(F.broadcast(whole)).select(f"__{margin}", F.coalesce(F.try_divide("goal", "whole"), F.lit(0.0)).alias("goal")), "goals")


def fit(cells: DataFrame, power: float = SMOOTH, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """The probability of each cell.  cells: __source, __lang, __topic, tokens.

    targets may give weights for source, lang and topic by name (None names null); what is not given is the margin's own
    share, smoothed by power.
    """
    cells = cells.where("tokens > 0")
    goals = {m: _goals(cells, m, power, (targets or {}).get(m)) for m in MARGINS}
    pairs = cells.select("__lang", "__topic").distinct().limit(FEW + 1).collect()
    fitted = _few(cells, goals, [tuple(p) for p in pairs]) if len(pairs) <= FEW else _many(cells, goals)
    # as many tokens as can be kept with the ratios: all but HELD of the wanted weight stay below probability 1
    spread = fitted.select((F.col("tokens") * F.col("ratio")).alias("m"), "ratio").where("m > 0")
    bins = sorted((r["b"], r["m"]) for r in spread.groupBy(F.floor(F.log2("ratio") * 16).alias("b")).agg(F.sum("m").alias("m")).collect())  # a bin for each sixteenth of a power of two
    total, over, scale = sum(m for _, m in bins), 0.0, 1.0
    for b, m in reversed(bins):
        over += m
        if over > HELD * total:
            scale = 2.0 ** (-(b + 1) / 16)
            break
    out = durable(fitted.select(*CELL, F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)).alias("__probability")), "probabilities")
    for used in (fitted, *goals.values()):
        release(used)
    return out


def _few(cells: DataFrame, goals: dict[str, DataFrame], pairs: list[tuple[str, str]]) -> DataFrame:
    """CELL, tokens and ratio (of wanted weight to tokens), with a factor for each pair of a language and a topic."""
    names = F.array(*(F.struct(F.lit(x).alias("__lang"), F.lit(t).alias("__topic"), F.lit(i).alias("i")) for i, (x, t) in enumerate(pairs)))
    index = cells.sparkSession.range(1).select(F.inline(names)) if pairs else cells.select("__lang", "__topic", F.lit(0).alias("i"))
    held = cells.join(F.broadcast(index), ["__lang", "__topic"]).groupBy("__source").agg(F.collect_list(F.struct("i", F.col("tokens").cast("double").alias("w"))).alias("x"))
    held = durable(held.join(goals["source"], "__source"), "held")
    want = [{r[0]: r[1] for r in goals[m].collect()} for m in MARGINS[1:]]  # FEW rows at most
    factors = [1.0] * len(pairs)

    def raked() -> DataFrame:
        f = F.array(*(F.lit(v) for v in factors)) if factors else F.array().cast("array<double>")
        sums = F.aggregate("x", F.lit(0.0), lambda a, c: a + c["w"] * F.get(f, c["i"]))
        each = held.withColumn("own", F.coalesce(F.try_divide(F.col("goal"), sums), F.lit(0.0))).select("__source", "own", F.explode("x").alias("c"))
        return each.select("__source", F.col("c.i").alias("i"), F.col("c.w").cast("long").alias("tokens"), (F.col("own") * F.get(f, F.col("c.i"))).alias("ratio"))

    for _ in range(ROUNDS if pairs else 0):
        got, off = [0.0] * len(pairs), 0.0
        for r in raked().groupBy("i").agg(F.sum(F.col("tokens") * F.col("ratio")).alias("m")).collect():
            got[r["i"]] = r["m"]
        for k, goal in enumerate(want):
            total, sums = sum(got), dict.fromkeys((p[k] for p in pairs), 0.0)
            for p, x in zip(pairs, got, strict=True):
                sums[p[k]] += x
            if not total:
                break
            off = max(off, *(abs(v / total - goal[name]) for name, v in sums.items()))
            by = {name: goal[name] * total / v if v > 0 else 0.0 for name, v in sums.items()}
            got, factors = ([v * by[p[k]] for p, v in zip(pairs, values, strict=True)] for values in (got, factors))
        if off < CLOSE:
            break
    return durable(raked().join(F.broadcast(index.select("i", "__lang", "__topic")), "i").select(*CELL, "tokens", "ratio"), "fitted")


def _many(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """CELL, tokens and ratio, for any number of sources, languages and topics."""
    now = durable(cells.select(*CELL, "tokens", F.col("tokens").cast("double").alias("m")), "fitted")
    for _ in range(ROUNDS):
        before, raked = now, now
        for m in MARGINS:
            held = raked.groupBy(f"__{m}").agg(F.sum("m").alias("held")).join(goals[m], f"__{m}").select(f"__{m}", F.coalesce(F.try_divide("goal", "held"), F.lit(0.0)).alias("f"))
            raked = raked.join(held, f"__{m}").select(*CELL, "tokens", (F.col("m") * F.col("f")).alias("m"))
        now = durable(raked, "fitted")
        release(before)
        # after the last margin its shares are the goals; the others' are as far off as the fit still is
        total = now.agg(F.sum("m").alias("total"))
        off = [now.groupBy(f"__{m}").agg(F.sum("m").alias("held")).join(F.broadcast(total)).join(goals[m], f"__{m}").select(F.abs(F.try_divide("held", "total") - F.col("goal")).alias("off")) for m in MARGINS[:2]]
        if (off[0].unionByName(off[1]).agg(F.max("off")).first()[0] or 0.0) < CLOSE:
            break
    out = durable(now.select(*CELL, "tokens", (F.col("m") / F.col("tokens")).alias("ratio")), "fitted")
    release(now)
    return out


def calibrated(documents: DataFrame, power: float = SMOOTH, targets: dict | None = None) -> DataFrame:
    """measured documents with __probability and __kept."""
    rows = measured(documents)
    cells = durable(rows.groupBy(*CELL).agg(F.sum("__tokens").alias("tokens")), "cells")
    # Spark broadcasts the cells' rows where their size is below its threshold, and shuffles them beyond it
    rows = rows.join(fit(cells, power, targets), CELL, "left")
    p = F.when(F.col("__tokens") == 0, 1.0).otherwise(F.coalesce("__probability", F.lit(1.0)))
    number = F.col("doc.doc_id").cast("long")
    chance = F.pmod(F.when(number.isNull(), F.xxhash64("doc.text", F.lit("mixture"))).otherwise(F.xxhash64(number, F.lit("mixture"))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.withColumn("__probability", p).withColumn("__kept", chance < F.col("__probability"))


def mix_report(documents: DataFrame, power: float = SMOOTH, targets: dict | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of each row."""
    return calibrated(documents, power, targets).select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.lang").alias("lang"), F.expr("substring(__topic, 2)").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__probability").alias("probability"), F.col("__kept").alias("kept"))


def mix(documents: DataFrame) -> DataFrame:
    """The sampled rows of documents, with all their columns."""
    return calibrated(documents).where("__kept").select("doc.*")
