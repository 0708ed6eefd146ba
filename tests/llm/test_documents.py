"""Each operator against a plain brute-force version on a small fixture with nulls, copies, ties and long texts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

LOWER = {i: i + 32 for i in range(65, 91)}


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- op1

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(documents, rows, empty):
    from framesift.llm.secrets import KINDS, scan

    want = Counter()
    for i, t in rows:
        s = base_spans(t)
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s)
        want[(i, *(sum(k == x for _, x, _ in s) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    out = scan(documents)
    assert found(out, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    spans = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert spans[421] == "access:0:20,assign:25:37" or spans[421].startswith("access:0:20")
    assert "random" in spans[422] or "assign" in spans[422]
    assert all("random" not in (spans[i] or "") for i in range(40))
    assert scan(empty).count() == 0


def test_battery_tells_random_strings_from_words(spark):
    import random

    from pyspark.sql import functions as F

    from framesift.llm.secrets import battery

    rng = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    data = [("r", "".join(rng.choice(alnum) for _ in range(40))) for _ in range(200)] + [("t", "thisIsSomePlainName" * 2 + "Eee00eeee") for _ in range(5)] + [("t", "aaaaaaaaaaaaaaaaaaaaaaaaaB1")]
    got = battery(spark.createDataFrame(data, "kind string, body string")).groupBy("kind").agg(F.expr("percentile(p_random, 0.1)").alias("low"), F.max("p_random").alias("high")).collect()
    got = {r["kind"]: r for r in got}
    assert got["r"]["low"] > 0.01 and got["t"]["high"] < 0.01


ALPHABETS = {"HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def test_reported_runs_are_keys_and_not_text(spark):
    """Of planted keys of each encoding nine in ten are reported, and of what is reported at most the stated share is text."""
    import random

    from framesift.llm.secrets import FALSE_DISCOVERY, scan

    rng = random.Random(12)
    english = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    parts = ["user", "Profile", "Function", "Name", "With", "Args", "Handler", "request", "Builder", "Config", "Manager", "Service", "index", "Value", "Template", "Parser", "Response", "default", "internal", "Callback"]
    prose = lambda: " ".join(rng.choice(english) for _ in range(150)) + ". "
    data, keys, names = [], {}, {}
    for i in range(1500):
        head, tail = prose(), prose()
        if i % 10 == 0:
            kind = list(ALPHABETS)[i // 10 % 5]
            body = "".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.randint(44, 80)))
            keys[i] = (len(head), len(head) + len(body), kind)
        elif i % 10 < 3:
            body = "".join(rng.choice(parts) for _ in range(rng.randint(3, 8))) + str(rng.randint(0, 99)) + rng.choice(parts)
            names[i] = body
        else:
            body = ""
        data.append((i, head + body + " " + tail))
    out = {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    reported = {(i, *map(int, s.split(":")[1:])) for i, spans in out.items() for s in spans.split(",") if s.startswith("random:")}
    right = {(i, a, b) for i, (a, b, _) in keys.items()}
    missed = [keys[i][2] for i, a, b in right - reported]
    assert len(right & reported) >= 0.9 * len(right), missed
    # the rate bounds the mean share; three deviations are allowed for one sample
    expected = FALSE_DISCOVERY * len(reported)
    assert len(reported - right) <= expected + 3 * expected**0.5, [(i, names.get(i)) for i, *_ in reported - right]


def test_windows_cover_whole_texts(spark):
    """For each encoding and band, every character of a text lies in a window."""
    import random

    from framesift.llm.secrets import ALPHABETS as encodings
    from framesift.llm.secrets import BANDS, text_windows

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(4000)) + "."
    texts = [(1, text), (2, "bead feed cafe dead beef"), (3, "bad cafe"), (4, "")]
    kept = {}
    for doc, t in texts:
        words = t.rstrip(".").split()
        name = "".join(w.capitalize() for w in words)
        kept[doc] = {e: "".join(words) if e in ("hex", "lower") else "".join(words).upper() if e == "base32" else name for e in encodings}
    for doc, t in texts:
        at = {(e, b): [] for e in encodings for b in range(len(BANDS))}
        for r in text_windows(spark.createDataFrame([(doc, t)], "doc_id long, text string")).collect():
            half = len(r["body"]) // 2
            assert r["body"][half : half + 2].isdigit()
            band = max(k for k, least in enumerate(BANDS) if len(r["body"]) >= least)
            part = r["body"][:half] + r["body"][half + 2 :]
            start = kept[doc][r["encoding"]].index(part)
            at[r["encoding"], band].append((start, start + len(part)))
        for (e, b), spans in at.items():
            whole = len(kept[doc][e])
            reach = 0
            for start, end in sorted(spans):
                assert start <= reach
                reach = end
            assert reach == (whole if whole + 2 >= BANDS[b] else 0), (doc, e, b)


def test_window_bins_are_whole_up_to_what_can_be_accepted(spark):
    """Tests that can't change what is accepted are left out, yet every window counts, and runs are accepted as by the whole battery."""
    import random

    from pyspark.sql import functions as F

    from framesift.llm.secrets import _SHOWN, BINS, accepted_bins, battery, binned, binned_within, text_bins, text_windows

    rng = random.Random(9)
    words = ["".join(rng.choice("eeeaaadcbfnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    ids = spark.range(4000).select("id", F.pmod(F.xxhash64("id", F.lit(2000)), F.lit(_SHOWN)).alias("part")).collect()
    shown, others = [r["id"] for r in ids if not r["part"]], [r["id"] for r in ids if r["part"]]
    plain = lambda: " ".join(rng.choice(words) for _ in range(600))[:2000].ljust(2000, "e")
    noise = lambda: "".join(rng.choice("0123456789abcdef") + " " * (i % 7 == 6) for i in range(2000))[:2000]
    runs = {("hex", 2): {1: 5, 20: 3, 60: 4, 140: 9}, ("alnum", 0): {0: 7, 4: 5, 30: 6}, ("base32", 4): {2: 1}}

    def histogram(df):
        out = {}
        for r in df.groupBy("encoding", "band", "bin").count().collect():
            out.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
        return out

    # texts like those that show where to look, and texts unlike them, where it turns out that more must be counted
    for first in (plain, noise):
        texts = spark.createDataFrame([(i, first()) for i in shown[:6]] + [(i, plain()) for i in others[:120]], "doc_id long, text string").repartition(2).cache()
        assert texts.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(_SHOWN)) == 0).count() == 6
        windows = text_windows(texts, list(runs))
        whole, got = histogram(binned(battery(windows))), text_bins(texts, runs)
        for cell in runs:
            assert sum(got[cell].values()) == sum(whole[cell].values())
        assert accepted_bins(runs, got) == accepted_bins(runs, whole)
        for last in (0, 10, 60, 85, 130):
            part = histogram(binned_within(windows, {c: last for c in runs}))
            for cell, counts in whole.items():
                assert {b: n for b, n in part[cell].items() if b <= last} == {b: n for b, n in counts.items() if b <= last}
                assert sum(part[cell].values()) == sum(counts.values())
        if first is plain:
            assert got["hex", 2].get(BINS, 0) > 0.5 * sum(whole["hex", 2].values())


def test_spans_of_many_matches(spark):
    """Offsets take time in proportion to a text's matches, and those of later blocks are right too."""
    import time

    from framesift.llm.secrets import scan

    texts = ["é token=abcdef" * n for n in (1, 127, 128, 129, 300, 100_000)]
    began = time.time()
    out = {r["doc_id"]: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        assert out[i]["n_assign"] == len(base_spans(t)) and out[i]["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base_spans(t)).encode()).hexdigest()


# ---------------------------------------------------------------- op2


def test_packing(documents, rows, empty):
    from tokenizers import Tokenizer

    from framesift.llm.packing import pack

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    ids = [[*e.ids, 1] for e in model.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    out = [r.asDict() for r in pack(documents, path, with_ids=True).collect()]
    by_sequence: dict = {}
    pieces: dict = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for s in by_sequence.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        total = sum(r["length"] for r in s)
        assert total == 2048 or (total < 2048 and total & (total - 1) == 0)
    tokens: Counter = Counter()
    for (doc, n), p in pieces.items():
        tokens[doc] += sum(r["length"] for r in p)
        for r in p:
            assert any(r["ids"] == x[r["start"] : r["start"] + r["length"]] for (i, _), x in zip(rows, ids, strict=True) if i == doc and len(x) == n)
    want: Counter = Counter()
    for (i, _), x in zip(rows, ids, strict=True):
        want[i] += len(x)
    assert tokens == want
    assert pack(empty, path).count() == 0


def test_words_are_learned_in_short_lines():
    """Lines of thousands of words cost the tokenizer more a word; ids are those of each word by itself."""
    import public_tokenizers

    from framesift.llm.packing import WordIds

    class Watched:
        def __init__(self, model):
            self.model, self.longest = model, 0

        def encode_batch_fast(self, lines, **options):
            self.longest = max(self.longest, *(line.count(" ") for line in lines))
            return self.model.encode_batch_fast(lines, **options)

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    ids.model = Watched(ids.model)
    words = [f"w{i}{chr(97 + i % 26)}é{'x' * (i % 5)}" for i in range(5000)]
    flat, ends = ids.encode([" ".join(words), *words[:300]])
    assert ids.model.longest <= 1000
    alone = [ids.model.model.encode(w, add_special_tokens=False).ids for w in words]
    assert flat.tolist() == [*(x for w in alone for x in w), 1, *(x for w in alone[:300] for x in [*w, 1])]
    assert ends.tolist()[-1] == len(flat)


def test_words_met_again_are_not_learned_again(monkeypatch):
    import public_tokenizers

    from framesift.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    ids, learned = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    learn = ids._learn
    monkeypatch.setattr(ids, "_learn", lambda words: (learned.extend(words), learn(words)))
    common = [f"common{chr(97 + i % 26)}{i}" for i in range(200)]
    for k in range(12):
        words = [w for i in range(200) for w in (common[i], f"rare{k}x{i}", "")]
        flat, ends = ids.encode([" ".join(words), ""])
        alone = [x for w in words if w for x in ids.model.encode(w, add_special_tokens=False).ids]
        assert flat.tolist() == [*alone, 1, 1] and ends.tolist() == [len(alone) + 1, len(alone) + 2]
    assert len(ids.known) <= 1000
    assert all(learned.count(w) == 1 for w in common)
    # more words than there is room for
    words = [f"many{i}" for i in range(3000)]
    assert ids.encode([" ".join(words)])[0].tolist() == [*(x for w in words for x in ids.model.encode(w, add_special_tokens=False).ids), 1]


def test_sum_of_squares_choice():
    from framesift.llm.packing import Packer

    rng = np.random.default_rng(1)
    p = Packer(32)
    for i in range(500):
        size = int(rng.integers(1, 32))
        level = p.place(size)

        def cost(h, size=size):
            c = p.count.copy()
            if h:
                c[h] -= 1
            if h + size < 32:
                c[h + size] += 1
            return int((c[1:32] ** 2).sum())

        choices = [h for h in range(33 - size) if h == 0 or p.count[h]]
        assert cost(level) == min(cost(h) for h in choices)
        p.add([i, 0, size, 0, size, np.zeros(size, np.uint32)])


# ---------------------------------------------------------------- op3


def brute_dedup(rows):
    """(doc_id, text that stays, lines dropped) of each row, by comparing every line with every other."""
    from framesift.llm.line_templates import ALONE, COMMON, DEPTH, LEAST, LONG, MANY, PARTS

    owner_key = lambda i: (1 << 63) - 1 if i is None else i
    cut = [re.split(r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)", t or "") for _, t in rows]
    words = [[tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^ \t-\r]+", x)) for x in lines] for lines in cut]

    def stretches(w):
        ends = [DEPTH + (len(w) - DEPTH) * k // PARTS for k in range(PARTS + 1)]
        return [w[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    full: dict = {}
    exact: dict = {}
    pairs: dict = {}
    leaf = lambda w: (len(w), w[:DEPTH]) if len(w) >= ALONE else w
    for (i, _), lines in zip(rows, words, strict=True):
        for k, w in enumerate(lines):
            if len(w) >= ALONE:
                for skip in range(PARTS):
                    key = (leaf(w), skip, tuple(s for n, s in enumerate(stretches(w)) if n != skip))
                    full.setdefault(key, set()).add(owner_key(i))
            elif w:
                exact.setdefault(w, set()).add(owner_key(i))
            if k and w and lines[k - 1]:
                pairs.setdefault((leaf(lines[k - 1]), leaf(w)), set()).add(owner_key(i))
    out = []
    for (i, t), lines, parts in zip(rows, words, cut, strict=True):
        me, gone = owner_key(i), set()
        for k, w in enumerate(lines):
            if len(w) >= ALONE:
                gone |= {k} if any(min(full[(leaf(w), skip, tuple(s for n, s in enumerate(stretches(w)) if n != skip))]) < me for skip in range(PARTS)) else set()
                continue
            if not w:
                continue
            docs = exact[w]
            if len(" ".join(w)) >= LONG:
                gone |= {k} if min(docs) < me else set()
                continue
            if len(docs) >= (MANY if len(w) >= LEAST else COMMON) and min(docs) < me:
                gone.add(k)
            for a, b in ((k - 1, k), (k, k + 1)):
                if a >= 0 and b < len(lines) and lines[a] and lines[b] and min(pairs[(leaf(lines[a]), leaf(lines[b]))]) < me:
                    gone.add(k)
        out.append((i, None if t is None else "".join(x for k, x in enumerate(parts) if k not in gone), len(gone)))
    return Counter(out)


def test_line_dedup(documents, rows, empty):
    from framesift.llm.line_templates import drop_lines, report

    want = brute_dedup(rows)
    got = found(report(documents), "doc_id", "text", "n_dropped")
    assert got == want and sum(n > 0 for _, _, n in want) > 20
    # a passage of ten documents stays in the first of them only, down to the sentences joined to other words at its ends
    passage = next(t for i, t in rows if i == 300)
    later = {i: t for i, t, _ in got if i and 301 <= i <= 309}
    shared = set(re.split(r"(?<=\n)|(?<=[.!?] )", passage)) & set(re.split(r"(?<=\n)|(?<=[.!?] )", next(t for i, t in rows if i == 301)))
    assert len(shared) > 3 and not any(s in t for s in shared if len(s.split()) > 1 for t in later.values())
    assert all(n == 0 for i, _, n in got if i in range(5, 40) and i != 7)
    kept = drop_lines(documents)
    assert kept.columns == documents.columns
    stays = Counter({(i, t): c for (i, t, n), c in want.items() if not n or t.strip()})
    assert found(kept, "doc_id", "text") == stays and kept.count() < len(rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())
    assert drop_lines(empty).count() == 0 and report(empty).count() == 0


def test_line_dedup_generalises_a_word(spark, tmp_path):
    """Lines of 8 tokens or more that equal one of an earlier document but for a token after the leading two all go."""
    import random

    from framesift.llm.line_templates import report

    rng = random.Random(4)
    sample = lambda: [rng.choice("red blue tree stone lamp river cloud bird".split()) for _ in range(rng.randint(7, 11))]
    lines = ["Posted by Anna in Sports at noon today", "Posted by Ben in Sports at noon today", "Posted by Anna in Sports at dusk maybe not", "Sent by Anna in Sports at noon today", "Seen by Cy in room 7 at noon today", "Seen by Di in room 9 at noon today"]
    lines += [" ".join(sample()) for _ in range(150)]
    for x in lines[6:40]:
        w = x.split(" ")
        w[rng.randrange(len(w))] = "other"
        lines.append(" ".join(w))
    path = str(tmp_path / "d.parquet")
    data = list(enumerate(lines))
    spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(path)
    got = found(report(spark.read.parquet(path)), "doc_id", "text", "n_dropped")
    assert got == brute_dedup(data)
    template = [re.sub(r"\S*[0-9]\S*", "<*>", x).split(" ") for x in lines]

    def same(a, b):
        off = [k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
        return len(a) == len(b) >= 8 and (not off or len(off) == 1 and off[0] >= 2)

    gone = {i for i, _, n in got if n}
    want = {i for i, a in enumerate(template) if any(same(a, b) for b in template[:i])}
    assert want <= gone and {1, 5} <= want and not {2, 3} & gone and len(want) > 15


def test_line_dedup_does_not_depend_on_the_splits(spark, documents, rows):
    """Rows are named by file and place, so cores lost between two scans change nothing."""
    from framesift.llm import line_templates

    scans = 0
    inner = line_templates.lines_of

    def fewer_cores(*text):
        nonlocal scans
        scans += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if scans % 2 else "128m")
        return inner(*text)

    line_templates.lines_of = fewer_cores
    try:
        assert found(line_templates.report(documents), "doc_id", "text", "n_dropped") == brute_dedup(rows)
    finally:
        line_templates.lines_of = inner
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert scans > 1


def test_line_dedup_with_a_full_filter(documents, rows, monkeypatch):
    from framesift.llm import common, line_templates

    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert found(line_templates.report(documents), "doc_id", "text", "n_dropped") == brute_dedup(rows)


def test_line_dedup_cuts_a_text_once(spark, tmp_path):
    """A text is put together from one cutting of it, whatever ends its lines hold and wherever the lines stand that go."""
    from pyspark.sql import functions as F

    from framesift.llm.line_templates import lines_of, rebuilt, report

    texts = ["", "\n", "a. b! c? d\ne", "a.\n\nb \n\n c. \n! \n\n", "a? b\n\n", ". . \n", "é! \n \n x\x01\n\ny. ", "no end"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [re.split(r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)", t) for t in texts]
    got = frame.select("t", lines_of(F.col("t")).alias("x"), lines_of(F.col("t"), " ").alias("y")).collect()
    assert {r["t"]: r["x"] for r in got} == dict(zip(texts, want, strict=True))
    assert {r["t"]: r["y"] for r in got} == {t: x if "\x01" in t else [y.replace("\n", " ") for y in x] for t, x in zip(texts, want, strict=True)}
    assert str(rebuilt(F.col("t"), F.col("gone"))).count("split(") == 2  # by the pattern or by the mark

    own = lambda d, k: f"{chr(97 + d)}{'qwertzuiop'[k % 10]}{'x' * (k // 10)} {'lines ' * 4}that stay\n"
    at = [0, 1, 62, 63, 64, 65, 127, 128, 191, 192, 639]
    shared = {k: f"{'asdfghjkly'[k % 10] * (k % 7 + 3)}{'v' * (k // 10)} is a passage that several documents hold\n" for k in at}
    docs = ["".join(shared[k] if k in shared and d in (0, 2) else own(d, k) for k in range(640)) for d in range(3)]
    path = str(tmp_path / "d.parquet")
    data = [*enumerate(docs), (3, shared[639]), (4, own(9, 700) * 70 + shared[639])]
    spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(path)
    got = found(report(spark.read.parquet(path)), "doc_id", "text", "n_dropped")
    assert got == brute_dedup(data) and {i: n for i, _, n in got} == {0: 0, 1: 0, 2: len(at), 3: 1, 4: 1}


def test_line_dedup_of_short_lines(spark, tmp_path):
    """Short, tabbed and unspaced lines that recur go by length, by the documents that hold them, or with their neighbours."""
    from framesift.llm.line_templates import report

    notice, rights, script = "Licensed under the Apache License, Version 2.0.\n", "All rights are reserved\n", "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 3 + "\n"
    own = lambda i, k: "".join(chr(97 + (i * 31 + k * 7 + j * j) % 26) for j in range(9)) + f" {'x' * (i + 1)}\n"
    texts = [own(i, 0) + (notice + own(i, 1) if i < 3 else "") + (rights if i < 12 else "") + own(i, 2) + "yes\n" * (i < 5) + own(i, 3) for i in range(14)]
    texts += [own(i, 0) + script + own(i, 1) + "see\tbelow for the next page of this\tlist\n" + own(i, 2) + "one two three\nten men\n" * (i < 16) for i in range(14, 18)]
    texts += [own(50, 0) + "top of the page\n" + own(50, 1), own(51, 0) + "top of the page\n" + own(51, 1)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(path)
    got = {r["doc_id"]: r["text"] for r in report(spark.read.parquet(path)).collect()}
    want = [t.replace(notice, "").replace(rights, "") if i else t for i, t in enumerate(texts)]
    for i in range(15, 18):
        want[i] = texts[i].replace(script, "").replace("see\tbelow for the next page of this\tlist\n", "").replace("one two three\nten men\n", "")
    assert [got[i] for i in range(len(texts))] == want
    assert want[5] != texts[5] and "yes" in want[4] and "top of" in want[19]


# ---------------------------------------------------------------- op4


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    up[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), len(groups)


def test_ngram_jaccard(documents, rows, empty, monkeypatch):
    from framesift.llm import jaccard_tree

    want, groups = brute_components(rows)
    assert found(jaccard_tree.link_components(documents), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_tree.drop_near_copies(documents)
    assert kept.columns == documents.columns and kept.count() == groups
    # blocks cut into pieces give the same components
    monkeypatch.setattr(jaccard_tree, "BLOCK", 500)
    assert found(jaccard_tree.link_components(documents), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_tree.link_components(empty).count() == 0
    # beyond the rows that the bit filter is made for, a join picks them
    monkeypatch.setattr(jaccard_tree, "FILTER_BITS", 64)
    assert found(jaccard_tree.link_components(documents), "doc_id", "n_shingles", "component_id") == want


def test_ngram_jaccard_does_not_depend_on_the_splits(spark, documents, rows):
    """Rows are named by file and place, so cores lost between two scans change nothing."""
    from framesift.llm import jaccard_tree

    scans = 0
    inner = jaccard_tree._only

    def fewer_cores(*about):
        nonlocal scans
        scans += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if scans % 2 else "128m")
        return inner(*about)

    jaccard_tree._only = fewer_cores
    try:
        assert found(jaccard_tree.link_components(documents), "doc_id", "n_shingles", "component_id") == brute_components(rows)[0]
    finally:
        jaccard_tree._only = inner
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert scans > 1


def test_signature_tree_finds_every_component():
    from framesift.llm.jaccard_tree import SignatureTree

    rng = np.random.default_rng(2)
    seeds = [rng.integers(0, 1 << 62, 60) for _ in range(12)]
    records = []
    for i in range(300):
        s = seeds[i % 12].copy()
        k = int(rng.integers(0, 9))
        s[rng.choice(60, k, replace=False)] = rng.integers(0, 1 << 62, k)
        records.append((i, 60, i, np.unique(s)))
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in records:
        for b in records[: a[0]]:
            n = len(np.intersect1d(a[3], b[3]))
            if 100 * n >= 80 * (120 - n):
                up[find(a[0])] = find(b[0])
    want = [find(i) for i in range(300)]
    links = SignatureTree(list(records)).links()
    up = list(range(300))
    for a, b in links:
        up[find(a)] = find(b)
    got = [find(i) for i in range(300)]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components(spark):
    from framesift.llm.common import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (200, 200), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 103, 105), 100)}


# ---------------------------------------------------------------- op5


def test_token_counts(documents, rows, empty):
    import sentencepiece

    from framesift.llm.token_counts import count_tokens

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in rows:
        n = len(model.encode(t or "", num_threads=1))
        want[(i, len((t or "").encode()), n, n > 4096)] += 1
    assert found(count_tokens(documents, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(empty, path).count() == 0


def test_rank_merging_of_odd_texts():
    import random

    import sentencepiece

    from framesift.llm.token_counts import RankMerger

    path = P.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), RankMerger(path)
    rng = random.Random(1)
    odd = ["", " ", "  ", "a  b", "   x", " \n", "\n", "a\nb", "a \n b", "▁a▁▁b", "中文🙂 x", "x" * 500, " " * 40 + "a", "a\tb  \t", "the\nthe", "\0a b", "<s> </s> <unk>", "bcbcbcbcbc" * 30]
    odd += ["".join(rng.choice("abc eth▁ \n\tinéß🙂") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    assert own.counts(odd) == [len(x) for x in model.encode(odd, num_threads=1)]


# ---------------------------------------------------------------- op6


def test_license_search(documents, rows, empty):
    from framesift.llm.license_search import PHRASES, search

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = Counter()
    for i, t in rows:
        w = word.findall((t or "").translate(LOWER))
        at, labels = [], set()
        for p, label in PHRASES.items():
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    out = search(documents)
    assert found(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[432]["labels"] == "mit" and 0 < got[432]["score"] < 1 and got[430]["labels"] == "reserved" and got[430]["score"] == 1.0
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in range(40))
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"] for r in got.values())
    assert search(empty).count() == 0


def test_fuzzy_search_against_brute_force():
    """Every notice with 0 to k edits planted in prose is found; the words of every span are within its bound of its notice, but for
    parts of words at its ends."""
    import random

    from framesift.llm.license_search import NOTICES, NoticeSearch, normalise

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng, finder = random.Random(6), NoticeSearch()
    prose = lambda: " ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(rng.randint(2, 8))) for _ in range(30))
    planted = 0
    for notice, label in NOTICES.items():
        for edits in range(len(notice) // 12 + 1):
            body = list(notice)
            for at in sorted(rng.sample(range(1, len(body) - 1), edits), reverse=True):
                kind = rng.randrange(3)
                body[at : at + 1] = [] if kind == 0 else ["q"] if kind == 1 else [body[at], "q"]
            text = normalise(f"{prose()} {''.join(body)} {prose()}").decode()
            spans = finder.fuzzy(text)
            # a letter that was a word takes a space with it when it goes
            if distance(notice, normalise("".join(body)).decode().strip()) <= len(notice) // 12:
                planted += 1
                assert label in {s[0] for s in spans}, (notice, edits)
            words = text.split()
            for found_label, a, b, cost, k in spans:
                assert cost <= k and any(x == found_label and distance(n, " ".join(words[max(0, a) : b])) <= k + 8 for n, x in NOTICES.items()), (notice, edits, a, b)
    assert planted > 40 and finder.fuzzy(normalise(prose() * 20).decode()) == []


def test_license_places_take_linear_time():
    import time

    from framesift.llm.license_search import NoticeSearch, normalise

    began = time.time()
    finder, words = NoticeSearch(), normalise("é cc by x " * 200_000)
    places, _ = finder.base(words)
    assert places == list(range(1, 800_000, 4)) and time.time() - began < 20


# ---------------------------------------------------------------- op7


def test_fingerprints(documents, rows, empty):
    from framesift.llm.edit_embedding import fingerprint_edits, likeness

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, x = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    out = fingerprint_edits(documents)
    assert found(out, "doc_id", "n_chars", "edited_sha256") == want
    got = out.collect()
    marks = {r["doc_id"]: r["fingerprint"] for r in got}
    assert marks[100] == marks[0] and marks[101] == marks[1] and marks[400] == marks[401]
    long = [r for r in got if r["n_chars"] > 300 and r["doc_id"] is not None and r["doc_id"] < 40]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 and np.mean([r["near_next"] for r in long]) < 0.1
    assert np.median([likeness(marks[5], marks[200 + i]) for i in range(25)]) > 0.7
    assert fingerprint_edits(empty).count() == 0


def test_near_links(spark):
    import random

    from framesift.llm.edit_embedding import codes, fingerprints, near_links

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = ["".join(rng.choice(letters) for _ in range(1500)) for _ in range(30)]
    texts += [t[:400] + rng.choice(letters) + t[401:900] + "xyz" + t[900:] for t in texts[:10]] + [texts[0]] * 5
    data = list(enumerate(fingerprints([codes(t) for t in texts])))
    got = {(r["a"], r["b"]) for r in near_links(spark.createDataFrame(data, "doc_id long, fingerprint string")).collect()}
    near, copies = {(i, 30 + i) for i in range(10)}, {(0, 40 + i) for i in range(5)}
    assert copies <= got <= near | copies and len(got & near) >= 7


def test_near_links_over_levels_and_hot_buckets(spark):
    """Near copies across a step in level are linked, and every pair that shares a bucket with unlike texts is reached."""
    import random

    from framesift.llm.edit_embedding import codes, fingerprints, likeness, near_links

    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz "
    one = lambda n: "".join(rng.choice(letters) for _ in range(n))
    link = lambda rows: {(r["a"], r["b"]) for r in near_links(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    sizes = [64 << k for k in range(1, 7)] + [rng.randint(200, 6000) for _ in range(24)]
    texts = [one(n) for n in sizes]
    texts += [t + "x" for t in texts[:6]] + [t[: len(t) // 2] + "q" + t[len(t) // 2 + 1 :] for t in texts[6:]]
    marks = fingerprints([codes(t) for t in texts])
    assert any(marks[i][:2] != marks[30 + i][:2] for i in range(6))
    brute = {(i, j) for j in range(len(marks)) for i in range(j) if likeness(marks[i], marks[j]) >= 0.8}
    got = link(list(enumerate(marks)))
    assert {(i, 30 + i) for i in range(6)} <= brute and got <= brute and len(got) >= 0.9 * len(brute), (len(got), len(brute))
    steps = {(i, j) for i, j in brute if marks[i][:2] != marks[j][:2]}
    assert steps and steps <= got
    # the only band that B and C share at their own level is led by A, which is unlike both
    body = [rng.choice("0123456789abcdef") for _ in range(128)]
    shift = lambda w, at: [format((int(c, 16) + 5) % 16, "x") if k in at else c for k, c in enumerate(w)]
    b, c = body, shift(body, {8 * k for k in range(1, 16)})
    a = b[:8] + [format((int(x, 16) + 3) % 16, "x") for x in b[8:]]
    hot = [(i, "04" + "".join(w)) for i, w in enumerate((a, b, c))]
    assert likeness(hot[1][1], hot[2][1]) >= 0.8 > likeness(hot[0][1], hot[1][1])
    assert (1, 2) in link(hot)


# ---------------------------------------------------------------- op9


def test_mixture(documents, rows, empty, spark):
    from framesift.llm.mixture import calibrated, mix, mix_report

    out = mix_report(documents).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["probability"] <= 1 for r in out) and all(r["kept"] for r in out if not r["n_tokens"])
    by_id: dict = {}
    for r in out:
        by_id.setdefault((r["doc_id"], r["probability"]), set()).add(r["kept"])
    assert all(len(v) == 1 for v in by_id.values())
    kept = mix(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in out)
    assert mix(empty).count() == 0 and calibrated(empty).count() == 0


def test_mixture_margins_match_a_brute_force_rake(spark):
    import random

    from framesift.llm.mixture import mix_report

    rng = random.Random(4)
    data = []
    for i in range(4000):
        s = "big" if rng.random() < 0.4 else f"s{rng.randint(0, 4)}"
        body = "w | " * 60 if rng.random() < 0.3 else "word " * rng.randint(20, 300)
        data.append((i, body, rng.choice(["en", "en", "fr", "de"]), s, 0))
    out = mix_report(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")).toPandas()
    assert out.probability.mean() > 0.4
    w = (out.n_tokens * out.probability).groupby([out.source, out.lang, out.topic]).sum()
    t = out.n_tokens.groupby([out.source, out.lang, out.topic]).sum()
    total = w.sum()
    for level in ("source", "lang", "topic"):
        share = t.groupby(level).sum() ** 0.9
        share /= share.sum()
        got = w.groupby(level).sum() / total
        assert abs(got - share).max() < 0.02, (level, got, share)
    # the sample keeps to the probabilities
    sigma = (out.n_tokens**2 * out.probability * (1 - out.probability)).sum() ** 0.5
    assert abs((out.n_tokens * out.kept).sum() - total) < 4 * sigma


def test_mixture_with_factors_kept_and_not(documents, monkeypatch):
    from framesift.llm import mixture

    few = found(mixture.mix_report(documents), "doc_id", "kept")
    cell = lambda df: {(r["source"], r["lang"], r["topic"]): r["probability"] for r in df.where("n_tokens > 0").collect()}
    p = cell(mixture.mix_report(documents))
    monkeypatch.setattr(mixture, "FEW", 0)
    other = mixture.mix_report(documents)
    assert sum((few - found(other, "doc_id", "kept")).values()) <= 2
    q = cell(other)
    assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 0.01 for k in p)


@pytest.mark.parametrize("few", [256, 0])
def test_mixture_of_many_languages(spark, monkeypatch, few):
    """A target for the smallest of 100 languages is met; nulls, empty strings and tabs are values of their own."""
    from framesift.llm import mixture
    from framesift.llm.mixture import mix_report

    monkeypatch.setattr(mixture, "FEW", few)

    data = [(i, "word " * 40, f"l{i % 100}", "s", 0) for i in range(3000)] + [(5000, "word " * 5, "rare", "s", 0)]
    data = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = mix_report(data, targets={"lang": {"rare": 0.5, "l7": 0.5}}).toPandas().set_index("doc_id")
    assert out.probability[5000] > 0.9 and out.probability[out.lang == "l7"].between(0.001, 0.9).all()
    assert (out.probability[~out.lang.isin(["rare", "l7"])] == 0).all()
    odd = [(i, "word " * 40, [None, "", "a\tb", "a\tc", "=", "null"][i % 6], "s", 0) for i in range(600)] + [(None, f"word {i} " * 40, "z", "s", 0) for i in range(300)]
    out = mix_report(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), targets={"lang": {None: 0.1, "": 0.2, "a\tb": 0.3, "a\tc": 0.2, "=": 0.1, "null": 0.1}}).toPandas()
    p = out[out.doc_id.notna()].assign(lang=lambda d: d.lang.fillna("<none>")).groupby("lang").probability.first()
    assert abs(p["a\tb"] / p[""] - 1.5) < 0.01 and abs(p["<none>"] / p["="] - 1) < 0.01 and abs(p["null"] / p[""] - 0.5) < 0.01
    alone = mix_report(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), targets={"lang": {"z": 0.2, "": 0.8}}).toPandas()
    assert 0 < alone[alone.doc_id.isna()].kept.sum() < 300


# ---------------------------------------------------------------- op10


def brute_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def labelled(spark, rows):
    data = [(i, 0 if i in (412, 413, 433) else 1, 0) for i, _ in rows if i is not None and i != 410]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_quality_forest(spark, documents, rows, empty):
    from framesift.llm.quality_forest import COUNTS, assess, clean

    labels = labelled(spark, rows)
    want = Counter()
    for i, t in rows:
        c = brute_counts(t)
        want[(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    out = assess(documents, labels)
    assert found(out, "doc_id", *COUNTS, "base_failed") == want
    got = out.collect()
    assert not any(r["kept"] for r in got if r["base_failed"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert not verdict[433] and sum(verdict[i] for i in range(40)) >= 39
    kept = clean(documents, labels)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in got)
    assert assess(empty, labels).count() == 0 and clean(documents, labels.limit(0)).count() == sum(not r["base_failed"] for r in got)


def test_forest_on_held_out_rows(spark):
    """Fitted on half of the labelled rows of sf0.01, it must part the other half."""
    from pyspark.sql import functions as F

    from framesift.llm.quality_forest import assess

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = assess(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    held = out.join(labels.where("doc_id % 2 = 1"), "doc_id").where(~F.col("base_failed"))
    r = held.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {x["quality"]: x["kept"] for x in r}
    assert share[1] > 0.97 and share[0] < 0.3, share


def test_forest_is_fitted_on_all_labelled_rows(spark):
    """Every good row is counted in the trees, and every labelled row in the threshold, however many there are."""
    import random

    import pyarrow as pa

    from framesift.llm.quality_forest import KEEP_GOOD, Forest, assess, statistics

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    prose = lambda marks: " ".join(rng.choice(vocabulary) + ("%!" if rng.random() < marks else "") for _ in range(rng.randint(22, 40)))
    # good rows that are rare, and poor rows like some good ones
    good = [i % 8 > 0 for i in range(6000)]
    texts = [prose(0.9 if i % 1500 == 7 else rng.choice([0, 0.05, 0.3]) if g else rng.choice([0.25, 0.5, 0.8])) for i, g in enumerate(good)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")

    counts, x = statistics(pa.array(texts))
    good = np.array(good)
    assert (counts[:, 0] >= 20).all() and not counts[:, 4].any()
    score = Forest(x[good], x.min(0), x.max(0)).score(x)
    best = (-1.0, 0.0)
    for s in np.unique(score):
        kept = score <= s
        if kept[good].mean() >= KEEP_GOOD:
            best = max(best, (round(kept[good].mean() - kept[~good].mean(), 12), s))
    out = {r["doc_id"]: r for r in assess(documents, labels).collect()}
    assert np.allclose([out[i]["anomaly_score"] for i in range(len(texts))], score, atol=1e-12)
    assert [out[i]["kept"] for i in range(len(texts))] == (score <= best[1]).tolist()


def test_forest_reads_every_word():
    """What follows the first 200 words shows in the features and in the score."""
    import random

    import pyarrow as pa

    from framesift.llm.quality_forest import Forest, statistics

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    clean = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    salad = [rng.choice(vocabulary[:12]) for _ in range(1300)]
    texts = [clean(rng.randint(30, 1500)) for _ in range(300)]
    x = statistics(pa.array([" ".join(t) for t in texts]))[1]
    whole, late, last = clean(1500), clean(200) + salad, clean(1499) + salad[:101]
    counts, odd = statistics(pa.array([" ".join(t) for t in (whole, late, last)]))
    assert not counts[:, 4].any()

    def shares(t):
        parts = [t[i : i + 200] for i in range(0, len(t) - 199, 200)]
        parts += [t[-200:]] if len(t) % 200 else []
        got = [len(set(p)) / 200 for p in parts]
        return [sum(got) / len(got), min(got)]

    assert np.allclose(odd[:, 7:], [shares(t) for t in (whole, late, last)])
    score = Forest(x, np.minimum(x.min(0), odd.min(0)), np.maximum(x.max(0), odd.max(0))).score(odd)
    assert score[1] > score[0] and score[2] > score[0], score
