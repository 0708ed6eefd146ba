"""The pipeline against brute force, stage by stage, each on its own input; and on odd tables."""

from __future__ import annotations

from collections import Counter

import pytest

from test_documents import brute_components, brute_counts, brute_dedup, labelled

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def staged(spark, folder, docs):
    """The rows that each stage leaves, every stage's output written and read again."""
    out = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}.parquet")
        docs = spark.read.parquet(f"{folder}/{k}.parquet")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, documents, rows, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    documents.write.parquet(f"{folder}/documents.parquet")
    labelled(spark, rows).write.parquet(f"{folder}/labels.parquet")
    columns = documents.columns
    quality, deduped, single, mixed, packed = staged(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
    assert all(df.columns == columns for df in (quality, deduped, single, mixed))
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    # quality rules: nothing that the base rule rejects, nearly all that is clean
    kept = pairs(quality)
    assert not any((c := brute_counts(t))[0] < 20 or 100 * c[4] > 30 * c[0] for _, t in kept)
    assert sum(i in range(40) for i, _ in kept) >= 39 and 433 not in {i for i, _ in kept}
    # line dedup
    want = Counter()
    for (i, t, n), c in brute_dedup(kept).items():
        want[(i, t)] += c if not n or t.strip() else 0
    lines = pairs(deduped)
    assert Counter(lines) == +want
    # one row, the smallest doc_id, of each component
    least, groups = brute_components(lines)
    ids = Counter(i for i, _ in pairs(single))
    assert sum(ids.values()) == groups and set(ids) == {c for (_, _, c) in least}
    assert set(pairs(single)) <= set(lines)
    # the mixture keeps rows as they are, and those without tokens
    assert not Counter(pairs(mixed)) - Counter(pairs(single))
    # packing: every id of every document that is left, once
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokens = Counter()
    for i, t in pairs(mixed):
        tokens[i] += len(model.encode(t or "", add_special_tokens=False).ids) + 1
    got: Counter = Counter()
    spans: dict = {}
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
        spans.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert got == tokens
    once = Counter(i for i, _ in pairs(mixed))
    for (i, n), s in spans.items():
        if once[i] == 1:
            s.sort()
            assert [a for a, _ in s] == [sum(x for _, x in s[:k]) for k in range(len(s))] and sum(x for _, x in s) == n
    # run() is the stages
    rerun = pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rerun.collect()).total() > 0
    assert sum(r["length"] for r in rerun.collect()) == sum(got.values())


def test_odd_tables(spark, empty, documents, tmp_path):
    """Empty tables, rows of nulls, and columns named like those that the stages make."""
    schema = empty.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    nulls = spark.createDataFrame([tuple(None for _ in empty.columns)] * 3, schema)
    extra = documents.select("*", *(documents["text"].alias(c) for c in ("__row", "__text", "__hits", "__kept", "doc", "line", "node", "digest", "__probability"))) if "doc" not in documents.columns else documents.select("*", *(documents["text"].alias(c) for c in ("__row", "__text", "__hits", "__kept", "line", "node", "digest", "__probability")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", empty), ("nulls", nulls), ("extra", extra)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = staged(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
        assert all(df.columns == docs.columns for df in out[:-1])
        assert out[0].count() == 0 if name != "extra" else out[-1].count() > 0
