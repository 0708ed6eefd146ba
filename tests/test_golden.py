"""Small worked examples with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framesift.functions import scalars as S
from framesift.functions import text as T
from framesift.operators import alignment, evidence, fusion, metrics, objects, policies, quality, routing, sequences, state, temporal, text_index, vectors

FRAMES = [("V", 0, 0), ("V", 3, 100), ("V", 10, 430), ("V", 45, 1500), ("V", 120, 4100)]
SHOTS = [("V", "s0", 0, 999), ("V", "s1", 1000, 5000)]
SEGMENTS = [("a0", "V", 350, 1700), ("a1", "V", 3900, 4500)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(FRAMES, "video_id string, frame_id long, timestamp_ms long")


@pytest.fixture(scope="module")
def shots(spark):
    return spark.createDataFrame(SHOTS, "video_id string, shot_id string, start_timestamp_ms long, end_timestamp_ms long")


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(SEGMENTS, "segment_id string, video_id string, start_ms long, end_ms long")


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame([("V", 5000)], "video_id string, duration_ms long")


def one(df, *columns):
    r = df.select(*columns).collect()
    assert len(r) == 1
    return tuple(r[0])


# ---------------------------------------------------------------- time


@pytest.mark.parametrize(("t", "nearest", "before", "after"), [(420, 10, 3, 10), (430, 10, 10, 10), (0, 0, 0, 0), (50, 0, 0, 3), (9000, 120, 120, 120)])
def test_as_of(spark, frames, t, nearest, before, after):
    p = spark.createDataFrame([("p", "V", t)], "probe_id string, video_id string, t long")
    assert one(temporal.as_of(p, frames), "nearest.frame_id", "before.frame_id", "after.frame_id") == (nearest, before, after)


def test_as_of_clamps_before_the_first(spark):
    f = spark.createDataFrame([("V", 1, 100)], "video_id string, frame_id long, timestamp_ms long")
    p = spark.createDataFrame([("p", "V", 5)], "probe_id string, video_id string, t long")
    assert one(temporal.as_of(p, f), "before.frame_id") == (1,)
    assert one(temporal.as_of(p, f, clamp=False), "before.frame_id") == (None,)


@pytest.mark.parametrize(("a", "b", "want"), [(90, 500, [3, 10]), (600, 900, [10, 45])])
def test_interval_keyframes(spark, frames, a, b, want):
    r = spark.createDataFrame([("r", "V", a, b)], "segment_id string, video_id string, start_ms long, end_ms long")
    assert one(temporal.interval_keyframes(r, frames), "frames") == (want,)


def test_window_by_radius(spark, frames, shots, segments, media):
    r = spark.createDataFrame([("r", "V", 100, 500)], "segment_id string, video_id string, t long, radius long")
    assert one(temporal.window_by_radius(r, frames, shots, segments, media), "start_ms", "end_ms", "clamped", "representative_frame_id", "asr", "shots") == (0, 600, True, 3, ["a0"], ["s0"])


@pytest.mark.parametrize(("t", "shot"), [(500, "s0"), (1500, "s1"), (6000, None)])
def test_shot_lookup(spark, shots, t, shot):
    p = spark.createDataFrame([("p", "V", t, None)], "probe_id string, video_id string, timestamp_ms long, shot_id string")
    assert one(temporal.point_in_interval(p, shots), "shot_id") == (shot,)


def test_neighbours(frames):
    got = {r["frame_id"]: (r["prev_frame_id"], r["next_frame_id"]) for r in temporal.neighbours(frames).collect()}
    assert got[0] == (None, 3) and got[120] == (45, None)


def test_canonical(spark, frames, media):
    c = spark.createDataFrame([("c", "V", 1400, 1200, 1800, ["asr"])], "candidate_id string, video_id string, timestamp_ms long, window_start_ms long, window_end_ms long, sources array<string>")
    assert one(temporal.canonical(c, frames, media), "frame_id", "window_start_ms", "window_end_ms", "sources") == (45, 1200, 1800, ["asr", "temporal_registry"])


def test_segment_links(segments, frames, shots, media):
    got = {r["segment_id"]: r for r in temporal.segment_links(segments, frames, shots, media).collect()}
    assert got["a0"]["frames"] == [10, 45] and got["a0"]["shots"] == ["s0", "s1"] and got["a0"]["representative_frame_id"] == 45
    assert (got["a0"]["before_frame_id"], got["a0"]["after_frame_id"]) == (3, 120)


def test_interval_join_keeps_a_pair_once(spark):
    a = spark.createDataFrame([("x", 0, 500_000)], "video_id string, a long, b long")
    b = spark.createDataFrame([("x", 10, 400_000)], "video_id string, c long, d long")
    assert temporal.interval_join(a, b, ("a", "b"), ("c", "d")).count() == 1


# ---------------------------------------------------------------- sequences


def test_speech_merge_and_split(spark):
    s = spark.createDataFrame([("V", -50, 1800), ("V", 1950, 5600), ("V", 9000, 12000)], "video_id string, start_ms long, end_ms long")
    m = spark.createDataFrame([("V", 10000)], "video_id string, duration_ms long")
    got = sequences.speech_segments(s, m, 3000, 500, 200).orderBy("start_ms").select("start_ms", "end_ms").collect()
    assert [tuple(r) for r in got] == [(0, 3000), (2500, 5500), (5000, 5600), (9000, 10000)]


def test_segment_dedup(spark):
    s = spark.createDataFrame([("V1", 1000, 2000, "same", -0.8, 2), ("V1", 1200, 2100, "same", -0.2, 2), ("V1", 2300, 2800, "c", -0.5, 1)], "video_id string, start_ms long, end_ms long, text string, avg_logprob double, n_words long")
    got = sequences.dedup_segments(s).orderBy("start_ms").select("segment_id", "start_ms").collect()
    assert [tuple(r) for r in got] == [("asr:V1:000000", 1200), ("asr:V1:000001", 2300)]


def test_segment_dedup_takes_the_oldest_twin(spark):
    s = spark.createDataFrame([("V", 0, 4000, "x", -1.0, 1), ("V", 2600, 8000, "x", -0.9, 1), ("V", 2700, 3700, "x", -0.1, 1)], "video_id string, start_ms long, end_ms long, text string, avg_logprob double, n_words long")
    assert sorted(tuple(r) for r in sequences.dedup_segments(s).select("start_ms", "end_ms").collect()) == [(2600, 8000), (2700, 3700)]


def test_gap_that_no_frame_can_fill(spark):
    frames = spark.createDataFrame([("V", "s", 0, 0), ("V", "s", 1, 9000)], "video_id string, shot_id string, frame_id long, timestamp_ms long")
    shot = spark.createDataFrame([("V", "s", 0, 10_000)], "video_id string, shot_id string, start_ms long, end_ms long")
    assert sequences.fill_gaps(frames.where("frame_id = 0"), frames, shot, 4000).count() == 2
    with pytest.raises(Exception, match="no unused frame"):
        sequences.fill_gaps(frames.where("frame_id = 0"), frames, shot, 4000, strict=True).collect()


def test_object_regions_and_counts():
    aliases = {"dog": "dog", "car": "car"}
    regions = {"dog at the left": "left", "dog ở giữa": "center", "dog bên phải": "right", "top dog": "top", "a dog": None}
    assert {q: objects.parse_query(q, aliases).region for q in regions} == regions
    assert objects.parse_query("dog, there are 3", aliases).counts == {"dog": 3}


def test_boundaries_and_runs(spark):
    b = spark.createDataFrame([("V", 0, 0.5), ("V", 300, 0.9), ("V", 700, 0.4), ("V", 2000, 0.1)], "video_id string, timestamp_ms long, confidence double")
    assert [r[0] for r in sequences.suppress_boundaries(b, 500).orderBy("timestamp_ms").select("timestamp_ms").collect()] == [300, 2000]
    s = spark.createDataFrame([("V", i, v) for i, v in enumerate([0.1, 0.9, 0.9, 0.2, 0.8])], "video_id string, frame_id long, score double")
    assert sorted(r[0] for r in sequences.score_runs(s, 0.5).select("frame_id").collect()) == [1, 4]


def test_perceptual_dedup_and_gaps(spark):
    f = spark.createDataFrame([("V", "s", 1, 0, 0, 0.1, 0), ("V", "s", 2, 100, 0, 0.5, 1), ("V", "s", 3, 200, 0, 0.2, -1)], "video_id string, shot_id string, frame_id long, timestamp_ms long, priority int, quality double, hash long")
    assert sorted(r[0] for r in sequences.perceptual_dedup(f, 2, 1000).select("frame_id").collect()) == [2, 3]
    all_frames = spark.createDataFrame([("V", "s", i, i * 1000) for i in range(11)], "video_id string, shot_id string, frame_id long, timestamp_ms long")
    shot = spark.createDataFrame([("V", "s", 0, 10_000)], "video_id string, shot_id string, start_ms long, end_ms long")
    out = sequences.fill_gaps(all_frames.where("frame_id = 0"), all_frames, shot, 4000).orderBy("timestamp_ms")
    times = [r["timestamp_ms"] for r in out.collect()]
    assert max(b - a for a, b in zip(times, [*times[1:], 10_000], strict=True)) <= 4000


def test_timeline(spark):
    d = spark.createDataFrame([("V", 0, 40), ("V", 1, 80), ("V", 2, 160)], "video_id string, decode_index long, raw_timestamp_ms long")
    assert [tuple(r) for r in sequences.normalise_timeline(d).orderBy("frame_id").select("frame_id", "timestamp_ms").collect()] == [(0, 0), (1, 40), (2, 120)]
    assert one(sequences.variable_rate(sequences.normalise_timeline(d)), "is_variable_frame_rate") == (True,)
    assert sequences.order_faults(sequences.normalise_timeline(d)).count() == 0


def test_policies(spark):
    f = spark.createDataFrame([("g", 1, 0, 0, 0.0, 0.0), ("g", 2, 100, 100, 0.4, 0.4), ("g", 3, 1000, 1000, 1.0, 1.0)], "group_id string, frame_id long, pts long, timestamp_ms long, score double, visual_score double")
    assert policies.rank_frames(f, "transition").orderBy("rank").first()["frame_id"] == 2
    tie = spark.createDataFrame([("g", 40, 1, 10, 0.5, 0.1), ("g", 41, 2, 10, 0.5, 0.9), ("g", 42, 3, 10, 0.5, 0.9)], "group_id string, frame_id long, pts long, timestamp_ms long, score double, visual_score double")
    assert [r["frame_id"] for r in policies.rank_frames(tie, "representative", "KIS").orderBy("rank").collect()] == [41, 42, 40]
    with pytest.raises(ValueError):
        policies.check_policy("KIS", "transition")


def test_evidence_counts_once(spark):
    f = spark.createDataFrame([("g", 1, 0.5, 0.1), ("g", 2, 0.5, 0.1)], "group_id string, frame_id long, v double, q double")
    e = spark.createDataFrame([("g", 1, 0.25), ("g", None, 1.0)], "group_id string, frame_id long, score double")
    got = {r["frame_id"]: r["s"] for r in policies.attach_evidence(f, e).withColumn("s", policies.standard_score(F.col("v"), F.col("q"), F.col("evidence"))).collect()}
    assert got == {1: pytest.approx(1.85), 2: pytest.approx(1.6)}


# ---------------------------------------------------------------- ranking


def test_rrf(spark):
    h = spark.createDataFrame([("a", "V", 1, 1, 0.9), ("b", "V", 1, 3, 0.5)], "model string, video_id string, frame_id long, rank long, similarity double")
    r = fusion.by_identity(h).first()
    assert r["rrf_score"] == pytest.approx(1 / 61 + 1 / 63) and r["model_scores"] == {"a": 0.9, "b": 0.5} and r["model_ranks"] == {"a": 1, "b": 3}


def test_diversity(spark):
    r = spark.createDataFrame([("q", "A", 1, 1000, 1), ("q", "A", 2, 1500, 2), ("q", "B", 3, 5000, 3)], "query_id string, video_id string, frame_id long, timestamp_ms long, rank long")
    assert [x["frame_id"] for x in fusion.diversify(r, 2, 1000).orderBy("new_rank").collect()] == [1, 3]


def test_buckets_and_caps(spark):
    h = spark.createDataFrame([("visual", 0, 0, "V", 1, 5000, 1), ("object", 1, 0, "V", 2, 5050, 1)], "branch string, branch_pos int, pos int, video_id string, frame_id long, timestamp_ms long, rank long")
    out = fusion.by_bucket(h).collect()
    assert len(out) == 1 and out[0]["frame_id"] == 1 and out[0]["score"] == pytest.approx(1.5 / 61)
    c = spark.createDataFrame([("V", i, 1.0 - i / 100, i) for i in range(10)], "video_id string, frame_id long, score double, pos long")
    assert fusion.cap_per_video(c).count() == 5


def test_late_fusion_needs_complete_rankings(spark):
    r = spark.createDataFrame([("a", "V", 1, 1), ("b", "V", 1, 1), ("a", "V", 2, 2)], "model string, video_id string, frame_id long, rank long")
    with pytest.raises(Exception, match="lacks or repeats"):
        fusion.complete_late(r, 2).collect()


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.6, 0.8]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest(v.where("vec_id < 3"), [3.0, 4.0], 2).collect()] == [1, 2]
    assert [tuple(r) for r in vectors.faults(v, 2).collect()] == [(3, "not of unit length")]
    with pytest.raises(Exception, match="unit length"):
        vectors.checked(v, 2).collect()


def test_alignment(spark):
    def path(events, compat=False, method="dp"):
        rows = [("q", e, k, "V", f, t, s) for e, cs in enumerate(events) for k, (f, t, s) in enumerate(cs)]
        pools = spark.createDataFrame(rows, "query_id string, event_index long, pos long, video_id string, frame_id long, timestamp_ms long, score double")
        return [r["frame_id"] for r in alignment.align(pools, compat, method).orderBy("event_index").collect()]

    back = [[(1, 900, 1.0)], [(2, 100, 1.0)]]
    assert path(back) == [] and path(back, method="greedy") == [1, 2] and path(back, method="auto") == [1, 2]
    events = [[(1, 0, 0.5), (2, 500, 0.9)], [(3, 100, 0.9), (4, 600, 0.1)]]
    assert path(events) == [1, 3]
    # a restart that nothing reaches wins the end in the compatible mode
    odd = [[(1, 500, 0.1)], [(2, 100, 5.0), (3, 600, 0.1)]]
    assert path(odd, compat=True) == [] and path(odd) == [1, 3]
    # the first of equals, and the greedy repair by the first candidate that isn't before the event ahead
    assert path([[(1, 0, 0.5), (2, 0, 0.5)], [(3, 9, 0.1), (4, 9, 0.1)]]) == [1, 3]
    assert path([[(1, 500, 0.9)], [(2, 100, 0.9), (3, 700, 0.5), (4, 600, 0.4)]], method="greedy") == [1, 3]


def test_best_path_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for q in range(40):
        events = [sorted(((round(rng.random(), 3), rng.randint(0, 20)) for _ in range(rng.randint(1, 5))), key=lambda c: -c[0]) for _ in range(rng.randint(1, 4))]
        rows += [(q, e, k, "V", 100 * e + k, t, s) for e, cs in enumerate(events) for k, (s, t) in enumerate(cs)]
        sums = [sum(c[0] for c in p) for p in itertools.product(*events) if all(a[1] <= b[1] for a, b in zip(p, p[1:], strict=False))]
        if sums:
            want[q] = round(max(sums), 6)
    pools = spark.createDataFrame(rows, "query_id long, event_index long, pos long, video_id string, frame_id long, timestamp_ms long, score double")
    got = {r["query_id"]: round(r["s"], 6) for r in alignment.align(pools, method="dp").groupBy("query_id").agg(F.sum("score").alias("s")).collect()}
    assert got == want and len(want) > 20


def test_stored_index(spark, tmp_path):
    """A stored index gives what one built in memory gives, is read again while its state is the same, and made anew when it isn't."""
    import os

    from framesift.operators import index_store

    docs = spark.createDataFrame([("ocr:exact", "ocr", "chương trình kinh tế", 0), ("asr:program", "asr", "chuong trinh thời sự", 1), ("meta:title", "metadata", "kinhte thành phố", 2), ("empty", "ocr", None, 3)], "doc_id string, source string, text string, pos long")
    fields = {"text": F.col("text"), "text_no_diacritics": T.folded_search_text(F.col("text")), "text_char_ngrams": F.array_join(T.padded_grams(F.col("text")), T.GRAM_SEPARATOR)}
    path = f"file:{tmp_path}/index"
    kept, fresh = index_store.stored(docs, fields, path, {"text": 2.0}), text_index.build(docs, fields, {"text": 2.0})
    plain = lambda df: sorted(map(str, df.collect()))
    for query in ('"chương trình"', "chuong trinh", "chuoong trinh", "kinhte thanhphoo"):
        assert plain(text_index.search(kept, query, 5)) == plain(text_index.search(fresh, query, 5))
    assert plain(kept.vocabulary.select("field", "term", "df")) == plain(fresh.vocabulary.select("field", "term", "df"))
    assert "bucket" in text_index.met_postings(kept, text_index._query_terms(spark, "trinh", ["text"], False))._jdf.queryExecution().toString()
    index_store.stored(docs, fields, path)
    assert len(os.listdir(tmp_path / "index")) == 1
    index_store.stored(docs.where("pos < 2"), fields, path)
    assert len(os.listdir(tmp_path / "index")) == 2
    with pytest.raises(Exception):
        index_store.load(spark, f"{path}/none")


def test_text_search(spark):
    docs = spark.createDataFrame([("ocr:exact", "ocr", "chương trình kinh tế", 0), ("asr:program", "asr", "chuong trinh thời sự", 1), ("meta:title", "metadata", "kinhte thành phố", 2)], "doc_id string, source string, text string, pos long")
    fields = {"text": F.col("text"), "text_no_diacritics": T.folded_search_text(F.col("text")), "text_char_ngrams": F.array_join(T.padded_grams(F.col("text")), T.GRAM_SEPARATOR)}
    index = text_index.build(docs, fields)
    top = text_index.search(index, '"chương trình"', 3).first()
    assert top["doc_id"] == "ocr:exact" and "exact_phrase" in top["modes"]
    folded = {r["doc_id"] for r in text_index.search(index, "chuong trinh", 5).collect()}
    assert {"ocr:exact", "asr:program"} <= folded
    fuzzy = text_index.search(index, "chuoong trinh", 5).collect()
    assert any("fuzzy" in r["modes"] for r in fuzzy)
    grams = text_index.search(index, "kinhte thanhphoo", 5).collect()
    assert any("character_ngram" in r["modes"] for r in grams)
    assert text_index.phrase_hits(index, '"kinh"').where("doc_id = 'meta:title'").count() == 0
    assert text_index.search(index, "trinh", 5, sources=["asr"]).count() == 1


def test_folding(spark):
    x = spark.createDataFrame([("Cộng hòa Việt Nam",), ("Đường phố",)], "t string")
    assert [r[0] for r in x.select(T.folded_search_text(F.col("t"))).collect()] == ["cong hoa viet nam", "duong pho"]


def test_objects(spark):
    d = spark.createDataFrame([("V", 1, "person", 0.9, 0.2, 0.5), ("V", 1, "person", 0.8, 0.8, 0.5), ("V", 1, "car", 0.7, 0.5, 0.5), ("V", 1, "phone", 0.15, 0.5, 0.5)], "video_id string, frame_id long, canonical_label string, confidence double, x double, y double")
    c = {r["canonical_label"]: (r["count_in_frame"], r["raw_count_in_frame"]) for r in objects.count_in_frame(objects.flag(d)).collect()}
    assert c["person"] == (2, 2) and c["phone"] == (0, 1)
    q = objects.parse_query("two persons left of a car", {"person": "person", "car": "car"})
    assert q.labels == ["person", "car"] and q.counts == {"person": 2} and q.relation == ("person", "left_of", "car")
    assert objects.search(objects.flag(d), q).first()["score"] == pytest.approx(2.0 + 0.45 + 1.5 + 1.5)
    assert objects.search(objects.flag(d), objects.parse_query("phone", {"phone": "phone"})).count() == 0
    t = spark.createDataFrame([("V", 1, 0.1, 0), ("V", 1, 0.2, 1), ("V", 1, 0.95, 2)], "video_id string, frame_id long, confidence double, position long")
    assert {r["confidence"] for r in objects.truncate(t, 2).collect()} == {0.95, 0.2}


def test_metrics(spark):
    v = spark.createDataFrame([(20.0,), (50.0,)], "v double")
    assert one(metrics.latency_summary(v, "v"), "p95") == (50.0,)
    p = spark.createDataFrame([("a b c", "a x c d"), ("", "")], "expected string, actual string")
    assert one(metrics.word_error_rate(p), "wer") == (pytest.approx(2 / 4),)


# ---------------------------------------------------------------- state and evidence


def test_session(spark):
    e = spark.createDataFrame([("s", 0, "start", None), ("s", 1, "refine", "x"), ("s", 2, "undo", None), ("s", 3, "reset", None), ("s", 4, "confirm", "f")], "session_id string, seq long, kind string, payload string")
    r = state.replay(e).first()
    assert (r["revision"], r["active"], r["refused"], r["confirmed"]) == (3, [], 0, "f")
    many = spark.createDataFrame([("s", i, "refine", str(i), 0 if i == 6 else None) for i in range(7)], "session_id string, seq long, kind string, payload string, expected_revision int")
    r = state.replay(many).first()
    assert (r["revision"], len(r["active"]), r["refused"]) == (5, 5, 2)


def test_decisions(spark):
    reg = spark.createDataFrame([("a", "completed", "f", True), ("b", "completed", "f", False), ("c", "failed", "f", False), ("d", "running", "f", False), ("e", "completed", "old", True)], "k string, status string, fingerprint string, valid boolean")
    want = spark.createDataFrame([(k, "f") for k in "abcdeg"], "k string, wanted_fingerprint string")
    got = {r["k"]: r["decision"] for r in state.decide(reg, want, ["k"]).collect()}
    assert got == {"a": "skip:completed", "b": "run:corrupt", "c": "skip:failed", "d": "run:interrupted", "e": "run:changed", "g": "run:new"}


def test_quality_gate(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    r = quality.report([quality.duplicates(a, ["k"])]).first()
    assert r["p0"] == 1 and not r["gate"]


def test_metadata_match(spark):
    rec = spark.createDataFrame([("r1", "videos/V1.MP4"), ("r2", "both"), ("r3", "nothing")], "record_id string, title string")
    look = spark.createDataFrame([("v1", "V1"), ("both", "V1"), ("both", "V2")], "alias string, video_id string")
    got = {r["record_id"]: (r["status"], r["video_id"]) for r in evidence.match_metadata(rec, look, ["title"]).collect()}
    assert got == {"r1": ("matched", "V1"), "r2": ("ambiguous", None), "r3": ("unmatched", None)}


def test_answers(spark):
    p = spark.createDataFrame([("a", [" ", "12,5"], ["x"]), ("b", [], ["YES"]), ("c", None, None)], "candidate_id string, ocr array<string>, asr array<string>")
    got = {r["candidate_id"]: (r["answer"], r["manual"]) for r in evidence.answer(p).collect()}
    assert got == {"a": ("12.5", False), "b": ("yes", False), "c": ("", True)}


def test_scalars(spark):
    x = spark.createDataFrame([("https://youtu.be/abcDEF12345", "30000/1001", "0/0", "../x")], "u string, f string, z string, p string")
    assert one(x, S.youtube_id(F.col("u")), F.round(S.fraction(F.col("f")), 3), S.fraction(F.col("z")), S.safe_path(F.col("p"))) == ("abcDEF12345", 29.97, None, False)
    assert one(x, S.pts_to_ms(F.lit(5), F.lit("1/2000")), S.pts_to_ms(F.lit(5), F.lit("1/2000"), True)) == (2, 2)
    assert one(x, S.tags(F.lit('["a", "b"]')), S.tags(F.lit("a; b|c"))) == (["a", "b"], ["a", "b", "c"])
    assert one(x, routing.split_events(F.lit("Sequence of events: (1) a; b\nc")), routing.branches(F.lit("a sign says"))) == (["a", "b", "c"], ["visual", "ocr", "asr", "metadata"])


def test_word_error_rate_reads_whole_texts(spark):
    """The query against brute force over the whole benchmark texts."""
    from framesift.plans.q_rank import word_error_rate

    d = "/root/testdata/sf0.001"
    edits = length = 0
    for (text,) in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect():
        a, b = text.split(), text[8:].split()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        edits, length = edits + row[-1], length + max(1, len(a))
    assert abs(word_error_rate(spark, d).first()[0] - edits / length) < 2e-6


def test_context_of_every_segment(spark):
    """Targets are a table: each segment of each video has its window, the widened one included."""
    from framesift.operators import temporal

    rows = [(f"{v}:{i}", v, i * 50_000, i * 50_000 + 20_000) for v in range(12) for i in range(6)]
    s = spark.createDataFrame(rows, "segment_id string, video_id long, start_ms long, end_ms long")
    want = {(t[0], x[0]) for t in rows for x in rows if t[1] == x[1] and x[3] >= max(0, t[2] - 60_000) and x[2] <= t[3] + 60_000}
    assert {(r["target_id"], r["segment_id"]) for r in temporal.context(s, s, 60_000).collect()} == want
