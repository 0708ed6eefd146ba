"""The queries of this subpackage, for __spark_entry__.py: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import report

    return report(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_tree import link_components

    return link_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_search import search

    return search(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_embedding import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_bundles import archive

    return archive(_table(spark, sf_dir, "pages"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_forest import assess

    return assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_line_dedup, op4_ngram_jaccard, op5_token_counts, op6_license_scan, op7_fingerprints, op8_warc, op9_mixture, op10_quality_forest)}

#: The other operators' own columns can't be given by SQL; tests hold these against brute force, a round trip or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, cast(len(s) as bigint) as n from s),
e as (select doc_id, unnest(s) as g from s),
c as (select g from e group by g having count(*) > 1),
j as (select e.doc_id, e.g from e join c using (g)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from j a join j b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
select n.doc_id, n.n as n_shingles, m.c as component_id from n join (select a, min(b) as c from r group by a) m on m.a = n.doc_id""",
    "op8_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, p.payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
from p left join f on f.payload_digest = p.payload_digest and payload_bytes >= 100""",
}
