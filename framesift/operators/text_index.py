"""Fielded BM25 over documents, with exact phrases, folded words, fuzzy expansion and a character n-gram gate.

An index is four tables: values (doc, field, value), postings (doc, field, term, tf), lengths (doc, field, length) and
statistics by field.  A query becomes a small table of (field, term, mode, boost), broadcast by its size; what it meets in
the postings is all that goes on to the final aggregation by document.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.scalars import let

# The ranking's constants.
K1, B = 1.5, 0.75
LEAN_K1 = 1.2
PHRASE_BOOST, FOLDED_BOOST, FUZZY_BOOST, GRAM_BOOST = 4.0, 1.0, 0.35, 0.18
FUZZY_DISTANCE, FUZZY_LEAST, FUZZY_CANDIDATES, GRAM_CANDIDATES, TOP_CONTRIBUTIONS = 1, 4, 128, 16, 50


@dataclass
class Index:
    """doc_id, source, pos (insertion order) and the tables made from their fields."""

    documents: DataFrame
    values: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    #: The vocabulary, where it is there already.
    known: DataFrame | None
    weights: dict[str, float] = field(default_factory=dict)
    tokens: DataFrame | None = None
    #: Parts of stored postings, which carry their field's length.
    buckets: int | None = None
    #: (doc_id, field, text, length) of n-gram fields whose n-grams are looked for in their texts.
    grams: DataFrame | None = None

    @property
    def vocabulary(self) -> DataFrame:
        """(field, term, df)."""
        if self.known is None:
            self.known = word_frequency(self)
        return self.known

    def settled(self) -> Index:
        """With the statistics of its few fields computed once."""
        spark = self.stats.sparkSession
        return replace(self, stats=spark.createDataFrame(self.stats.collect(), self.stats.schema))

    def persisted(self) -> Index:
        """The tables kept for several passes of a search; lost parts are made anew.  A stored index is read as it is."""
        if self.buckets:
            return self
        for t in (self.postings, self.lengths):
            t.persist()
        self.tokens = None
        self.stats, self.known = field_statistics(self.lengths).persist(), document_frequency(self.postings).persist()
        return self


def field_values(documents: DataFrame, fields: dict[str, object]) -> DataFrame:
    """(doc_id, field, value) in long form; a missing value is an empty one, so that it counts in its field."""
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), F.coalesce(column, F.lit("")).alias("value")) for name, column in fields.items()))
    return documents.select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.field", "f.value")


def build(documents: DataFrame, fields: dict[str, object], weights: dict[str, float] | None = None, gram_texts: dict[str, object] | None = None) -> Index:
    """An index of documents (doc_id, source, pos, ...) over fields given as Columns.

    An n-gram field is given by its stored n-grams among fields, or in gram_texts by the text (T.gram_text) that has them: these are
    counted and looked for, and never made.
    """
    values = field_values(documents, fields)
    tokens = values.select("doc_id", "field", T.field_tokens(F.col("field"), F.col("value")).alias("tokens"))
    lengths = tokens.select("doc_id", "field", F.size("tokens").cast("long").alias("length"))
    postings = postings_of(tokens)
    grams = None
    if gram_texts:
        grams = field_values(documents, gram_texts).withColumnRenamed("value", "text").withColumn("length", T.count_grams(F.col("text")))
    return Index(documents, values, postings, lengths, field_statistics(lengths if grams is None else lengths.unionByName(grams.drop("text"))), None, weights or {}, tokens, grams=grams)


def _each(tokens: DataFrame, array, *columns: str) -> DataFrame:
    """columns and each term of an array.  By an outer explode, as a plain one makes the planner ask for the array's size first and cut
    the text twice for that."""
    return tokens.select(*columns, F.explode_outer(array).alias("term")).where("term is not null")


def _occurrences(index: Index, terms: list[str], bare: bool = True) -> DataFrame:
    """(doc_id, field, length, term) of the rows' tokens that are among a query's terms; with bare, each row once with no term too."""
    none = F.array(F.lit(None).cast("string")) if bare else F.array().cast("array<string>")
    length = F.col("length") if "length" in index.tokens.columns else F.size("tokens").cast("long")
    out = index.tokens.select("doc_id", "field", length.alias("length"), F.explode_outer(F.concat(none, F.col("tokens")) if bare else F.col("tokens")).alias("term"))
    out = out.where(F.col("term").isin(terms) | F.col("term").isNull() if bare else F.col("term").isin(terms))
    if index.grams is not None:
        out = out.unionByName(index.grams.select("doc_id", "field", "length", F.explode(F.concat(none, _found(terms))).alias("term")))
    return out


def _found(grams: list[str]):
    """Those of a query's n-grams that a text has; blank ones are none."""
    return F.array_compact(F.array(*(F.when(F.col("text").contains(g), F.lit(g)) for g in grams if g.strip(" ")), F.lit(None).cast("string")))


def gram_frequency(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, term, df) of a query's n-grams (field, term) over texts (doc_id, field, text); a document given twice counts once."""
    asked = terms.select("field", "term").distinct().collect()
    met = texts.select("doc_id", "field", F.explode(_found(sorted({r["term"] for r in asked}))).alias("term")).distinct()
    own = F.broadcast(texts.sparkSession.createDataFrame(asked, terms.select("field", "term").schema))
    return met.join(own, ["field", "term"]).groupBy("field", "term").agg(F.count("*").alias("df"))


def met_frequency(index: Index, terms: DataFrame) -> DataFrame:
    """(field, term, df) of a query's own terms (field, term)."""
    if index.known is not None or index.tokens is None:
        return index.vocabulary.join(F.broadcast(terms.select("field", "term").distinct()), ["field", "term"])
    asked = terms.select("field", "term").distinct().collect()
    here = _occurrences(_of_fields(index, {r["field"] for r in asked}), sorted({r["term"] for r in asked}), bare=False)
    here = here.join(F.broadcast(index.values.sparkSession.createDataFrame(asked, terms.select("field", "term").schema)), ["field", "term"])
    return here.select("doc_id", "field", "term").distinct().groupBy("field", "term").agg(F.count("*").alias("df"))


def _of_fields(index: Index, names) -> Index:
    """The tokens and texts of some fields only."""
    own = F.col("field").isin(sorted(names))
    grams = index.grams.where(own) if index.grams is not None and any(n.endswith("char_ngrams") for n in names) else None
    return replace(index, tokens=index.tokens.where(own), grams=grams)


def met_postings(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of terms (field, term, ...), with the terms' other columns and the field's length.  A document given twice has its
    tokens together and both lengths."""
    if index.buckets:  # the terms' own parts are all that is read
        part = F.pmod(F.xxhash64("field", "term"), F.lit(index.buckets)).cast("int")
        return index.postings.join(F.broadcast(terms.withColumn("bucket", part)), ["bucket", "field", "term"]).drop("bucket")
    if index.tokens is None:
        return index.postings.join(terms, ["field", "term"]).join(index.lengths, ["doc_id", "field"])
    return _met(_seen(index, terms), terms)


def _seen(index: Index, terms: DataFrame) -> DataFrame:
    """(doc_id, field, term, length, n) of an index that isn't stored: the occurrences of a query's terms, and with a null term the rows
    of each length.  Kept, so that frequencies, statistics and scores come from one scan of the texts."""
    asked = terms.select("field", "term").collect()
    rows = _occurrences(_of_fields(index, {r["field"] for r in asked}), sorted({r["term"] for r in asked}))
    return rows.groupBy("doc_id", "field", "term", "length").agg(F.count("*").alias("n")).persist()


def _met(seen: DataFrame, terms: DataFrame) -> DataFrame:
    lengths = seen.where("term is null").select("doc_id", "field", "length", F.col("n").alias("copies"))
    met = seen.where("term is not null").groupBy("doc_id", "field", "term").agg(F.sum("n").alias("tf")).join(F.broadcast(terms), ["field", "term"])
    return met.join(lengths, ["doc_id", "field"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def word_frequency(index: Index, lengths: list[int] | None = None) -> DataFrame:
    """(field, term, df) of all terms, or of words of some lengths.  Where no document is given twice, a row's own terms are counted and
    none are shuffled by document."""
    own = lambda df: df if lengths is None else df.where(~F.col("field").endswith("char_ngrams") & F.length("term").isin(lengths))
    if index.known is not None or index.tokens is None:
        return own(index.vocabulary)
    if not index.documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        return document_frequency(own(index.postings))
    return document_frequency(own(_each(index.tokens, F.array_distinct("tokens"), "field")))


def postings_of(tokens: DataFrame) -> DataFrame:
    """(doc_id, field, term, tf)."""
    return _each(tokens, "tokens", "doc_id", "field").groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), F.sum("length").alias("total_length"))


def bm25(tf, df, n, length, average, k1: float = K1, b: float = B):
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1.0))))


def _query_terms(spark, query: str, index_fields: list[str], grams: bool) -> DataFrame:
    """(field, term, mode, boost): raw words, folded words for folded fields, n-grams for n-gram fields."""
    one = spark.range(1)
    raw, folded, gram = T.tokens(F.lit(query)), T.tokens(T.fold(F.lit(query))), T.padded_grams(F.lit(query))
    parts = []
    for name in index_fields:
        if name.endswith("char_ngrams"):
            if grams:
                parts.append(one.select(F.lit(name).alias("field"), F.explode(F.array_distinct(gram)).alias("term"), F.lit("character_ngram").alias("mode"), F.lit(GRAM_BOOST).alias("boost")))
        elif name.endswith("no_diacritics"):
            parts.append(one.select(F.lit(name).alias("field"), F.explode(F.array_distinct(folded)).alias("term"), F.lit("no_diacritics").alias("mode"), F.lit(FOLDED_BOOST).alias("boost")))
        else:
            parts.append(one.select(F.lit(name).alias("field"), F.explode(F.array_distinct(raw)).alias("term"), F.lit("bm25").alias("mode"), F.lit(1.0).alias("boost")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weight(index: Index):
    if not index.weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for kv in index.weights.items() for x in kv))
    return F.coalesce(table[F.col("field")], F.lit(1.0))


def contributions(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, field, term, mode, value) of the postings that terms meet."""
    terms = terms.sparkSession.createDataFrame(terms.collect(), terms.schema)  # a query's own terms
    if index.tokens is not None and not index.buckets:
        seen = _seen(index, terms)
        met, stats = _met(seen, terms), _statistics(seen)
    else:
        met, stats = met_postings(index, F.broadcast(terms)), index.stats
    df = met.groupBy("field", "term").agg(F.countDistinct("doc_id").alias("df"))
    met = met.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    value = bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("length"), F.col("avg_length"), k1, b) * F.col("boost") * weight(index)
    return met.select("doc_id", "field", "term", "mode", value.alias("value"))


def _statistics(seen: DataFrame) -> DataFrame:
    n, total = F.sum("n"), F.sum(F.col("length") * F.col("n"))
    return seen.where("term is null").groupBy("field").agg(n.alias("n_docs"), (total / n).alias("avg_length"))


def phrase_hits(index: Index, query: str) -> DataFrame:
    """Contributions of exact phrases: quoted ones, or the whole query of two tokens and more."""
    spark = index.values.sparkSession
    quoted = T.quoted_phrases(F.lit(query))
    phrases = spark.range(1).select(F.explode(F.when(F.size(quoted) > 0, F.transform(quoted, T.token_string)).otherwise(F.when(F.size(T.tokens(F.lit(query))) >= 2, F.array(T.token_string(F.lit(query)))).otherwise(F.array().cast("array<string>")))).alias("phrase")).distinct()
    # the first token is met in the postings before the phrase is looked for
    first = phrases.select(F.split("phrase", " ")[0].alias("term"), "phrase")
    near = F.broadcast(first.distinct())
    words = index.values.where(~F.col("field").endswith("char_ngrams"))
    stored = "words" in index.values.columns
    if index.tokens is None and not stored:
        met = index.postings.where(~F.col("field").endswith("char_ngrams")).join(near, "term").select("doc_id", "field", "phrase").distinct().join(words, ["doc_id", "field"])
    else:
        met = words.join(near.select("phrase"), F.lit(True))  # a query's own phrases, met in the scan
    met = met.where(T.has_phrase(F.col("words") if stored else T.token_string(F.col("value")), F.col("phrase")))
    return met.select("doc_id", "field", F.col("phrase").alias("term"), F.lit("exact_phrase").alias("mode"), (F.lit(PHRASE_BOOST) * weight(index)).alias("value"))


def grams_needed(index: Index, query: str) -> bool:
    """Whether some word of four characters and more is, raw and folded, in no word vocabulary."""
    return grams_needed_each(index, [query])[0]


def grams_needed_each(index: Index, queries: list[str]) -> list[bool]:
    """grams_needed of several queries, by one pass over the vocabulary or, of an index that isn't stored, over the tokens."""
    spark = index.values.sparkSession
    pairs = lambda q: F.arrays_zip(T.tokens(F.lit(q)).alias("raw"), T.tokens(T.fold(F.lit(q))).alias("folded"))
    each = [[w for w in r if max(len(x) for x in (w["raw"] or "", w["folded"] or "")) >= FUZZY_LEAST] for r in spark.range(1).select(*(pairs(q).alias(str(i)) for i, q in enumerate(queries))).first()]
    asked = sorted({x for words in each for w in words for x in (w["raw"], w["folded"]) if x})
    if not asked:
        return [False] * len(queries)
    if index.known is None and index.tokens is not None:
        words = _each(index.tokens.where(~F.col("field").endswith("char_ngrams")), "tokens")
    else:
        words = index.vocabulary.where(~F.col("field").endswith("char_ngrams"))
    known = {r["term"] for r in words.select("term").where(F.col("term").isin(asked)).distinct().collect()}
    return [any(w["raw"] not in known and w["folded"] not in known for w in words) for words in each]


def rare_grams(index: Index, query: str) -> DataFrame:
    """Of the query's n-grams, for each field the GRAM_CANDIDATES that fewest documents have."""
    fields = [r["field"] for r in index.stats.where(F.col("field").endswith("char_ngrams")).select("field").collect()]
    if not fields:
        return _query_terms(index.values.sparkSession, query, ["none"], False).where("false")
    terms = _query_terms(index.values.sparkSession, query, fields, True)
    w = Window.partitionBy("field").orderBy("df", F.desc(F.length("term")), "term")
    return terms.join(met_frequency(index, terms), ["field", "term"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= GRAM_CANDIDATES).select("field", "term", "mode", "boost")


def fuzzy_terms(index: Index, query: str, distance: int = FUZZY_DISTANCE) -> DataFrame:
    """(field, term, mode, boost): vocabulary within an edit distance of query words that the field lacks."""
    spark = index.values.sparkSession
    words = spark.range(1).select(F.explode(F.array_distinct(F.concat(T.tokens(F.lit(query)), T.tokens(T.fold(F.lit(query)))))).alias("word")).where(F.length("word") >= FUZZY_LEAST)
    sizes = {len(r["word"]) for r in words.collect()}
    vocabulary = word_frequency(index, sorted({n + d for n in sizes for d in range(-distance, distance + 1)}))
    if not index.buckets:
        vocabulary = vocabulary.persist()  # of some lengths only, met twice
    lacking = F.broadcast(index.stats.where(~F.col("field").endswith("char_ngrams")).select("field").join(words, F.lit(True))).join(vocabulary.select("field", F.col("term").alias("word")), ["field", "word"], "left_anti")
    near = vocabulary.join(F.broadcast(lacking), "field").where(F.length("term").between(F.length("word") - distance, F.length("word") + distance))
    w = Window.partitionBy("field", "word").orderBy(F.abs(F.length("term") - F.length("word")), F.desc("df"), "term")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= FUZZY_CANDIDATES)
    near = near.withColumn("d", T.edit_distance(F.col("term"), F.col("word"), distance)).where(F.col("d") <= distance)
    likeness = 1 - F.col("d") / F.greatest(F.length("term"), F.length("word"))
    return near.groupBy("field", "term").agg(F.max(likeness).alias("likeness")).select("field", "term", F.lit("fuzzy").alias("mode"), (F.lit(FUZZY_BOOST) * F.col("likeness")).alias("boost"))


def search(index: Index, query: str, limit: int = 20, sources: list[str] | None = None, fuzzy: bool = True, grams: bool = True) -> DataFrame:
    """Ranked documents: doc_id, score, matched fields and modes, top contributions; ties in insertion order."""
    spark, index = index.values.sparkSession, index.settled()
    words = [r["field"] for r in index.stats.where(~F.col("field").endswith("char_ngrams")).select("field").collect()]
    found = contributions(index, _query_terms(spark, query, sorted(words), False)).unionByName(phrase_hits(index, query))
    if grams and grams_needed(index, query):
        found = found.unionByName(contributions(index, rare_grams(index, query)))
    if fuzzy:
        found = found.unionByName(contributions(index, fuzzy_terms(index, query)))
    by_term = found.groupBy("doc_id", "field", "term", "mode").agg(F.sum("value").alias("value"))
    entries = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("minus"), F.concat_ws(":", "field", "term").alias("name")))), 1, TOP_CONTRIBUTIONS)
    ranked = by_term.groupBy("doc_id").agg(F.sum("value").alias("score"), F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_set("mode")).alias("modes"), F.transform(entries, lambda e: F.struct(e["name"].alias("name"), (-e["minus"]).alias("value"))).alias("top"))
    ranked = ranked.join(index.documents.select("doc_id", "source", "pos"), "doc_id")
    if sources:
        ranked = ranked.where(F.col("source").isin(sources))
    # rounded, so that equal texts tie whatever the order of their sums
    return ranked.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "pos").limit(limit)


def ranks(hits: DataFrame) -> DataFrame:
    """hits with rank; for the few rows of a limit."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pos")))


def plain_bm25(documents: DataFrame, query_tokens: list[str], k1: float = K1, b: float = B, distinct: bool = False) -> DataFrame:
    """Whole-corpus BM25 of documents (doc_id, tokens): repeated query words count again unless distinct.  Scores above 0."""
    asked = sorted(set(query_tokens)) if distinct else query_tokens
    times = {w: asked.count(w) for w in asked}
    one = documents.select("doc_id", F.lit("text").alias("field"), "tokens")
    terms = documents.sparkSession.createDataFrame([("text", w, "bm25", float(n)) for w, n in times.items()], "field string, term string, mode string, boost double")
    index = Index(documents, one, one, one, one, None, tokens=one)
    return contributions(index, terms, k1, b).groupBy("doc_id").agg(F.sum("value").alias("score")).where("score > 0")


def lean_search(documents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """4 for an exact occurrence + BM25 + sequence likeness + trigram Jaccard, over folded texts; zero scores stay."""
    folded = T.fold(F.lower(F.trim(F.col("text"))))
    asked = T.fold(F.lower(F.trim(F.lit(query))))
    rows = documents.select("doc_id", folded.alias("t"), T.tokens(folded).alias("tokens"))
    query_tokens = documents.sparkSession.range(1).select(T.tokens(asked).alias("q")).first()["q"]
    ranked = plain_bm25(rows, query_tokens, LEAN_K1, distinct=True)
    score = F.when(F.col("t").contains(asked), 4.0).otherwise(0.0) + F.coalesce("score", F.lit(0.0)) + T.sequence_ratio(asked, F.col("t")) + trigram_jaccard(F.col("t"), asked)
    return rows.join(ranked, "doc_id", "left").select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def trigram_jaccard(a, b):
    grams = lambda c: let(c, lambda s: F.array_distinct(F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))).otherwise(F.array(s))))
    return let(F.struct(grams(a).alias("x"), grams(b).alias("y")), lambda g: _jaccard(g["x"], g["y"]))


def _jaccard(x, y):
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def with_fallback(primary, local):
    """primary(), or local() with degraded set when it fails."""
    try:
        return primary().withColumn("degraded", F.lit(False))
    except Exception:  # whatever the remote side raises
        return local().withColumn("degraded", F.lit(True))
