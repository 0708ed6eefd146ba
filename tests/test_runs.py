"""Shards, hashes, archives, workbooks, decoded frames and keyframe extraction on small tables."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import scalars as S
from framesift.operators import keyframes, mapping, validation
from framesift.plans import retrieval
from framesift.sources import readers, writers


def signed(bits):
    n = int("".join("1" if b else "0" for b in bits), 2)
    return n - (1 << 64) if n >= 1 << 63 else n


def test_hashes_against_numpy(spark):
    rng = random.Random(3)
    pictures = [[float(rng.randint(0, 255)) for _ in range(32 * 32)] for _ in range(4)]
    n = 32
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(8)])
    want = []
    for p in pictures:
        low = basis @ np.array(p).reshape(n, n) @ basis.T
        want.append(signed((low > np.median(low[1:])).flatten()))
    df = spark.createDataFrame([(i, p, p[:72]) for i, p in enumerate(pictures)], "i int, p array<double>, d array<double>")
    got = df.select("i", S.phash(F.col("p")).alias("h"), S.dhash(F.col("d"), 9).alias("d")).orderBy("i").collect()
    assert [r["h"] for r in got] == want
    for p, r in zip(pictures, got, strict=True):
        g = np.array(p[:72]).reshape(8, 9)
        assert r["d"] == signed((g[:, 1:] > g[:, :-1]).flatten())


def test_embedding_shards(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = str(tmp_path / "v")
    made = {r["shard"]: (r["record_start"], r["record_end"], r["n"]) for r in writers.embedding_shards(df, path, 100).collect()}
    assert made == {0: (0, 99, 100), 1: (100, 199, 100), 2: (200, 249, 50)}
    assert readers.embedding_shards(spark, path).count() == 250
    assert sorted(r["vec_id"] for r in readers.embedding_shards(spark, path, [5, 249, 999]).collect()) == [5, 249]
    assert readers.inspect_shards(spark, path).count() == 0
    df.where("vec_id < 7").withColumn("shard", F.lit(1)).drop("shard").write.mode("append").parquet(f"{path}/shards/shard=1")
    assert [tuple(r) for r in readers.inspect_shards(spark, path).collect()] == [(1, "number of rows")]


def test_archives(tmp_path):
    good, bad = tmp_path / "a.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x/a.txt", "a")
    assert readers.unzip(str(good), str(tmp_path / "out")) == ["x/a.txt"] and (tmp_path / "out/x/a.txt").read_text() == "a"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../b.txt", "b")
    with pytest.raises(ValueError, match="out of the folder"):
        readers.unzip(str(bad), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="too large"):
        readers.safe_members([("a", 10_000, 1, False)], (10, 1 << 20, 1 << 20, 200))
    with pytest.raises(ValueError, match="too large"):
        readers.safe_members([("a", 1, 1, False)] * 11, (10, 1 << 20, 1 << 20, 200))


def test_first_sheet_by_the_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda v: f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="str"><v>name</v></c></row><row r="2"><c r="A2" t="str"><v>{v}</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet("second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet("first"))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="B" sheetId="2" r:id="r2"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
    (tmp_path / "b.xlsx").write_bytes(data.getvalue())
    assert [r["values"] for r in readers.excel(spark, str(tmp_path / "b.xlsx"), first=True).collect()] == [{"name": "first"}]
    assert readers.excel(spark, str(tmp_path / "b.xlsx")).count() == 2


def test_mapped_frames(spark):
    index = spark.createDataFrame([("V", 90, "1/90", 1, 1000)], "video_id string, pts long, time_base string, frame_id long, timestamp_ms long")
    good = spark.createDataFrame([("V", 90, "1/90", 1000)], "video_id string, pts long, time_base string, timestamp_ms long")
    assert [r["frame_id"] for r in mapping.resolved(good, index).collect()] == [1]
    with pytest.raises(Exception, match="times differ"):
        mapping.resolved(good.withColumn("timestamp_ms", F.lit(7)), index).collect()
    with pytest.raises(Exception, match="not in the index"):
        mapping.resolved(good.withColumn("pts", F.lit(7)), index).collect()


def test_keyframes(spark):
    cuts = spark.createDataFrame([("V", "s0", 0, 9000), ("V", "s1", 9001, 12000)], "video_id string, shot_id string, start_ms long, end_ms long")
    frames = spark.createDataFrame([("V", i, i * 500, 1.0 + (i % 3), 1 << (i % 60) | 1 << (i * 7 % 60)) for i in range(25)], "video_id string, frame_id long, timestamp_ms long, quality double, hash long")
    out = keyframes.extract(cuts, frames, 4000, 600, 0, 1000).orderBy("keyframe_seq").collect()
    assert [r["keyframe_seq"] for r in out] == list(range(len(out))) and len({r["frame_id"] for r in out}) == len(out)
    for shot, a, b in (("s0", 0, 9000), ("s1", 9001, 12000)):
        times = [a, *sorted(r["timestamp_ms"] for r in out if r["shot_id"] == shot), b]
        assert len(times) > 2 and all(y - x <= 4000 for x, y in zip(times, times[1:], strict=False))
    assert {"representative"} <= {r["reason"] for r in out} <= set(keyframes.PRIORITY)


def test_histogram_shots(spark):
    h = [[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 4
    frames = spark.createDataFrame([("V", i, i * 1000, x) for i, x in enumerate(h)] + [("W", 0, 0, [1.0, 1.0])], "video_id string, frame_id long, timestamp_ms long, histogram array<double>")
    cuts = keyframes.shots(keyframes.histogram_boundaries(frames), frames)
    assert sorted(tuple(r) for r in cuts.select("video_id", "start_frame_id", "end_frame_id", "start_ms", "end_ms").collect()) == [("V", 0, 3, 0, 3000), ("V", 4, 7, 4000, 7000), ("W", 0, 0, 0, 0)]


def test_artifacts_orders_and_batches(spark, tmp_path):
    registry = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, sha256 string")
    assert sorted((r["rule"], r["key"]) for r in validation.artifacts(registry, files).collect()) == [("artifact has changed", "b"), ("missing artifact", "c")]
    rows = spark.createDataFrame([("V", 5, "b"), ("U", 9, "a"), ("V", 1, "c")], "video_id string, start_ms long, segment_id string")
    assert [r["segment_id"] for r in writers.canonical(rows, "asr").collect()] == ["a", "c", "b"]
    queries = spark.createDataFrame([("q1", " kis"), ("q2", "TRAKE"), ("q3", None)], "query_id string, task string")
    done = retrieval.batch(queries, {"KIS": lambda q: q})
    assert [r["query_id"] for r in done["KIS"].collect()] == ["q1"] and sorted(r["query_id"] for r in retrieval.skipped(queries, ["KIS"]).collect()) == ["q2", "q3"]
    writers.commit(rows, str(tmp_path / "d"), spark.createDataFrame([("V", "completed")], "video_id string, status string"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3 and spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert S.fingerprint({"b": 1, "a": 2}, "x") == S.fingerprint({"a": 2, "b": 1}, "x") != S.fingerprint({"a": 2, "b": 1}, "y")
    with pytest.raises(ValueError):
        S.fingerprint({}, "")
