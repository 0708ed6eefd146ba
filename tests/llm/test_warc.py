from __future__ import annotations

import hashlib
from collections import Counter


def test_bundles_round_trip(spark, tmp_path, monkeypatch):
    from framesift.llm import common
    from framesift.llm.warc_bundles import BundleReader, archive, parse, read_records, write_bundles

    big = "<p>né " + "x" * 400
    rows = [(5, "http://a b", big), (3, None, big), (9, "http://c", big), (4, "u", "short"), (6, "u", "short"), (None, "n", big), (7, "e", ""), (8, "z", None), (3, None, big), (10, "l", "y" * 900_000), (11, "l", "é" * 50), (2, "l", "é" * 50), (12, "w", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, row int").repartition(3)
    folder = f"file://{tmp_path}/bundles"
    index = write_bundles(pages, folder)
    got = Counter(tuple(r) for r in read_records(index, folder).collect())
    want: Counter = Counter()
    groups: dict = {}
    for p, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    for payload, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for k, p in enumerate(ids):
            back = p != ids[0] and len(payload) >= 100
            want[(p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if back else "response", ids[0] if back else None)] += 1
    assert got == want
    # random access to one record, frame-relative
    r = next(x for x in index.collect() if x["page_id"] == 12)
    headers, payload = parse(BundleReader(folder, r["bundle"]).record(r["frame"], r["frame_offset"], r["length"]))
    assert headers["WARC-Type"] == "response" and payload == rows[-1][2].encode()
    assert archive(pages.limit(0)).count() == 0
    info = next(x for x in index.collect() if x["frame"] == 0 and x["page_id"] is not None)
    head, _ = parse(BundleReader(folder, info["bundle"]).frame(0)[: BundleReader(folder, info["bundle"]).frame(0).index(b"WARC/1.1", 10)])
    assert head["WARC-Type"] == "warcinfo"
    # a full filter takes every row for a revisit: the join writes them
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert Counter(tuple(r) for r in archive(pages).collect()) == want


def test_a_bundle_is_one_zstandard_stream(tmp_path):
    import zstandard

    from framesift.llm.warc_bundles import BundleReader, BundleWriter

    w = BundleWriter(f"file://{tmp_path}", "b.warc.zst")
    places = [w.add(bytes([i]) * 100_000) for i in range(9)]
    w.close()
    plain = zstandard.ZstdDecompressor().stream_reader((tmp_path / "b.warc.zst").read_bytes(), read_across_frames=True).read()
    assert plain == b"".join(bytes([i]) * 100_000 for i in range(9))
    r = BundleReader(f"file://{tmp_path}", "b.warc.zst")
    assert len(r.frames) > 2 and all(r.record(*p) == bytes([i]) * 100_000 for i, p in enumerate(places))
