"""Text indexes that are written once and read by many queries.

A stored index lies in a folder named by its state: a hash of the documents' indexed fields and of what the layout depends
on.  Postings are parted by a hash of (field, term) and sorted inside a part, so a query reads the parts of its own terms
alone, and of these the row groups that hold them.  The state's table is written last: a folder without it is no index.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import text_index
from .text_index import Index

#: Parts of the postings; a part of 100 TB of text is some tens of GB then, in files of its own size.
BUCKETS = 64
VERSION = 1


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int")


def state(documents: DataFrame, fields: dict[str, Column], buckets: int = BUCKETS) -> str:
    """A hash that changes with the documents' indexed fields, their number, order and names, and with the layout."""
    values = documents.select("doc_id", F.col("source").cast("string"), "pos", *(c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())))
    whole = values.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(salt), *values.columns).cast("decimal(38,0)")).cast("string").alias(f"h{salt}") for salt in (1, 2))).first()
    return hashlib.sha256(json.dumps([VERSION, buckets, list(fields), *whole]).encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(index: Index, path: str, buckets: int = BUCKETS) -> None:
    """Writes the tables of an index."""
    values = index.values.withColumn("words", F.when(~F.col("field").endswith("char_ngrams"), T.token_string(F.col("value"))))
    values.write.mode("overwrite").parquet(f"{path}/values")
    index.documents.select("doc_id", "source", "pos").write.mode("overwrite").parquet(f"{path}/documents")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = index.lengths.sparkSession.read.parquet(f"{path}/lengths")
    postings = index.postings.join(lengths, ["doc_id", "field"]).withColumn("bucket", bucket_of(buckets))
    # a hot term's postings are split over tasks by document; files of a part are sorted each
    postings = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "field", "term", "doc_id")
    postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = postings.sparkSession
    text_index.document_frequency(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    text_index.field_statistics(lengths).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(VERSION, buckets)], "version int, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/state")


def cut(documents: DataFrame, fields: dict[str, Column], path: str, weights: dict[str, float] | None = None, gram_texts: dict[str, Column] | None = None) -> Index:
    """The index that build makes, with each text cut once: its tokens in one string, its length and the texts of n-gram fields are
    written as one row under path, for the passes of one search.  No postings are made."""
    spark, gram_texts = documents.sparkSession, gram_texts or {}
    between = lambda name: T.GRAM_SEPARATOR if name.endswith("char_ngrams") else " "
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = documents.select("doc_id", *(text(c).alias(f"v{i}") for i, c in enumerate(fields.values())), *(text(c).alias(f"g{i}") for i, c in enumerate(gram_texts.values())))
    rows = rows.select("doc_id", *(T.field_tokens(F.lit(n), F.col(f"v{i}")).alias(f"t{i}") for i, n in enumerate(fields)), *(f"g{i}" for i in range(len(gram_texts))))
    rows = rows.select(
        "doc_id",
        *(F.array_join(f"t{i}", between(n)).alias(f"w{i}") for i, n in enumerate(fields)), *(F.size(f"t{i}").cast("long").alias(f"n{i}") for i in range(len(fields))),
        *(f"g{i}" for i in range(len(gram_texts))), *(T.count_grams(F.col(f"g{i}")).alias(f"c{i}") for i in range(len(gram_texts))),
    )
    rows.write.mode("overwrite").parquet(f"{path}/texts")
    rows = spark.read.parquet(f"{path}/texts")
    stack = lambda parts: reduce(DataFrame.unionByName, parts)
    split = lambda i, n: F.when(F.col(f"w{i}") == "", F.array().cast("array<string>")).otherwise(F.split(f"w{i}", between(n)))
    tokens = stack(rows.select("doc_id", F.lit(n).alias("field"), F.col(f"n{i}").alias("length"), split(i, n).alias("tokens")) for i, n in enumerate(fields))
    values = stack(rows.select("doc_id", F.lit(n).alias("field"), F.col(f"w{i}").alias("value"), F.col(f"w{i}").alias("words")) for i, n in enumerate(fields))
    grams = stack(rows.select("doc_id", F.lit(n).alias("field"), F.col(f"g{i}").alias("text"), F.col(f"c{i}").alias("length")) for i, n in enumerate(gram_texts)) if gram_texts else None
    lengths = tokens.drop("tokens") if grams is None else tokens.drop("tokens").unionByName(grams.drop("text"))
    return Index(documents, values, text_index.postings_of(tokens), lengths, text_index.field_statistics(lengths), None, weights or {}, tokens, grams=grams)


def load(spark: SparkSession, path: str, weights: dict[str, float] | None = None) -> Index:
    """A stored index; an error where there is none."""
    about = spark.read.schema("version int, buckets int").json(f"{path}/state").first()
    if about is None or about["version"] != VERSION:
        raise ValueError(f"{path} holds no index of version {VERSION}")
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(table("documents"), table("values"), table("postings"), table("lengths"), table("stats"), table("vocabulary"), weights or {}, buckets=about["buckets"])


def stored(documents: DataFrame, fields: dict[str, Column], path: str, weights: dict[str, float] | None = None, buckets: int = BUCKETS) -> Index:
    """The index of documents under path: read if there is one of their state, else built and written first."""
    spark = documents.sparkSession
    folder = f"{path.rstrip('/')}/{state(documents, fields, buckets)}"
    if not _exists(spark, f"{folder}/state/_SUCCESS"):
        save(text_index.build(documents, fields), folder, buckets)
    return load(spark, folder, weights)
