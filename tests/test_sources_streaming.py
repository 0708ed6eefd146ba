from __future__ import annotations

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.operators import quality
from framesift.sources import readers, schemas, writers
from framesift.streaming import flows


def test_json_lines(spark, tmp_path):
    s = T.StructType.fromDDL("a long, b string")
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), s).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    assert readers.table(spark, str(tmp_path / "x.jsonl"), s).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": nope}\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), s).collect()
    assert readers.json_faults(spark, str(tmp_path / "bad.jsonl"), s).count() == 1
    with pytest.raises(ValueError):
        readers.table(spark, "x.csv")


def test_delimited_and_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("﻿File Name\tDownload Link\na.zip\thttp://a\n\t\n", encoding="utf-8")
    rows = readers.manifest_entries(readers.delimited(spark, str(tmp_path / "m.tsv"))).collect()
    assert [tuple(r) for r in rows] == [("a.zip", "http://a")]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}]', '{"videos": [{"a": 1}, {"a": 2}]}'])
def test_json_payload(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    assert sorted(r["a"] for r in readers.json_payload(spark, str(tmp_path / "p.json"), T.StructType.fromDDL("a long")).collect()) == [1, 2]


def test_excel(spark, tmp_path):
    sheet = '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>link</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row r="3"></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>name</t></si><si><t>a.zip</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = readers.excel(spark, str(tmp_path / "w.xlsx")).collect()
    assert [(r["sheet"], r["row"], r["values"]) for r in rows] == [("sheet1", 2, {"name": "a.zip", "link": "7"})]


def test_ingest_and_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n, c in (("a/1.mp4", b"x"), ("a/2.mp4", b"x"), ("b.mkv", b"y"), ("c.txt", b"z")):
        (tmp_path / n).write_bytes(c)
    found = readers.discover(spark, str(tmp_path)).select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("video_id"), "path", F.sha2("content", 256).alias("sha256"), "length")
    got = {r["video_id"]: r["ingest_status"] for r in readers.ingest(found).collect()}
    assert got == {"1": "accepted", "2": "duplicate", "b": "accepted"}


def test_corpus_guards(spark):
    f = spark.createDataFrame([("r", "v", 1), ("r", "v", 2)], "preprocess_run_id string, video_id string, frame_id long")
    assert readers.corpus(f).count() == 2
    with pytest.raises(ValueError):
        readers.corpus(f.unionByName(f))
    with pytest.raises(ValueError):
        readers.corpus(f.where("false"))


def test_probe(spark):
    p = {"streams": [{"r_frame_rate": "30/1", "avg_frame_rate": "2997/100", "width": 10, "height": 5, "codec_name": "h264", "time_base": "1/90000"}], "format": {"duration": "1.5"}}
    r = readers.probe(spark.createDataFrame([("v", json.dumps(p))], "video_id string, probe string")).first()
    assert r["duration_ms"] == 1500 and r["is_variable_frame_rate"] and r["width_px"] == 10


def test_shards_and_promotion(spark, tmp_path):
    df = spark.createDataFrame([("v1", 1, {"a": "x"}), ("v2", 2, {})], "video_id string, n long, fields map<string,string>")
    writers.shards(df, str(tmp_path), "ocr")
    writers.shards(df.where("n = 1").withColumn("n", F.lit(9).cast("long")), str(tmp_path), "ocr")
    assert sorted(r["n"] for r in readers.all_shards(spark, str(tmp_path), "ocr").collect()) == [2, 9]
    with pytest.raises(ValueError):
        writers.promote(df, [quality.duplicates(df.unionByName(df), ["video_id"])], str(tmp_path / "p"))
    writers.promote(df, [quality.duplicates(df, ["video_id"])], str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_schemas(spark):
    for name in schemas.SCHEMAS:
        empty = spark.createDataFrame([], schemas.schema(name))
        for good in schemas.constraints(name).values():
            assert empty.where(good).count() == 0
    bad = spark.createDataFrame([("v", -1)], "video_id string, x long").select(F.col("x").alias("frame_id"))
    assert quality.violations(bad, F.col("frame_id") >= 0, F.col("frame_id")).count() == 1


def test_pages(spark):
    rows = spark.range(10)
    got, after = readers.page(rows, "id", 3, 4)
    assert [r[0] for r in got.collect()] == [4, 5, 6, 7] and after == 7
    assert readers.page(rows, "id", 7, 4)[1] is None
    with pytest.raises(ValueError):
        readers.cursor("-1")


def _stream(spark, tmp_path, rows, schema):
    (tmp_path / "in").mkdir()
    for i, part in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_streaming_buckets_and_gaps(spark, tmp_path):
    rows = [[{"k": "a", "ts": f"2024-01-01T00:00:0{i}", "value": 1.0} for i in range(3)], [{"k": "a", "ts": "2024-01-01T02:00:00", "value": 5.0}]]
    s = _stream(spark, tmp_path, rows, "k string, ts timestamp, value double")
    q = flows.bucket_counts(s, "ts", ["k"], "1 minute").writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["total"]) for r in spark.table("buckets").collect()) == [(1, 5.0), (3, 3.0)]
    q = flows.gap_merge(s, "ts", ["k"]).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert all(r["n"] == 3 for r in spark.table("gaps").collect())


def test_upsert_after_a_skipped_batch(spark, tmp_path):
    from framesift.streaming import flows

    write = flows.upsert_into(str(tmp_path / "t"), ["k"], ["n"])
    table = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    write(table(("a", 1), ("b", 1)), 0)
    write(table(("b", 2)), 4)
    write(table(("b", 2)), 4)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v=4")).collect()) == [("a", 1), ("b", 2)]


def test_streaming_upsert_and_sessions(spark, tmp_path):
    rows = [[{"session_id": "s", "seq": 0, "kind": "start", "payload": None}, {"session_id": "s", "seq": 1, "kind": "refine", "payload": "x"}], [{"session_id": "s", "seq": 2, "kind": "refine", "payload": "y"}, {"session_id": "s", "seq": 3, "kind": "undo", "payload": None}]]
    s = _stream(spark, tmp_path, rows, "session_id string, seq long, kind string, payload string")
    q = s.writeStream.foreachBatch(flows.upsert_into(str(tmp_path / "t"), ["session_id"], ["seq"])).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    last = sorted(p.name for p in (tmp_path / "t").iterdir())[-1]
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "t" / last)).collect()] == [3]
    q = flows.sessions(s, "seq").writeStream.format("memory").queryName("sessions").outputMode("update").start()
    for _ in range(240):  # its timeouts make empty batches without end, so there is no waiting for the last one
        if spark.table("sessions").count() >= 2 or not q.isActive:
            break
        time.sleep(0.25)
    q.stop()
    assert max((r["revision"], tuple(r["active"])) for r in spark.table("sessions").collect()) == (3, ("x",))
