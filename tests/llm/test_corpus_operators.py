"""Corpus operators: defined results for odd input, and brute force where SQL does not reach."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import best_fit_packing, cost_packing, kneser_ney, licenses, minhash, mixing, ogg, pii, preferences, token_ids, voronoi_knn
from cladewise.llm.components import components
from cladewise.llm.scratch import Scratch
from cladewise.llm.wordhash import shingles, word_hashes

LONG = "word " * 30_000 + "x" * 300_000
TEXTS = ["the quick brown fox jumps over the lazy dog", None, "", " \n\t ", "one", LONG, "Ünïcode 😀 tëxt, 12   and \x85 more", "the quick brown fox jumps over the lazy dog", "<|endoftext|> inside 1 2 3"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], 0, "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id here at all", "en", "a", 0, "clash", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, rank string")


def words(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# 1 -----------------------------------------------------------------------------------------------


def knn_brute(rows, every, k):
    vec = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in vec if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_knn_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).astype(float).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 520)]  # ties: one vector many times
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, []), (1005, [0.5, 0.5]), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    for options in ({}, {"pivots": 4, "group_rows": 7, "chunk_rows": 50}):
        got = {tuple(r) for r in voronoi_knn.knn_join(df, F.col("id") % 10 == 0, k=5, **options).collect()}
        assert got == knn_brute(rows, 10, 5)


def test_knn_prunes(spark, monkeypatch):
    """Far cells are not sent to a group: of four clusters, queries of one see that one."""
    rows = [(i, [float(i % 4 == j) * 100 + (i % 7) * 0.01 for j in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    first = type(df).mapInArrow

    def seen(self, f, schema, *a, **b):
        out = first(self, f, schema, *a, **b)
        if "groups" in schema:
            sent.append(out)
        return out

    monkeypatch.setattr(type(df), "mapInArrow", seen)
    got = voronoi_knn.knn_join(df, F.col("id") % 4 == 0, k=3, pivots=8).collect()
    want = {x for x in knn_brute(rows, 1, 3) if x[0] % 4 == 0}
    assert {tuple(r) for r in got} == want
    assert sent and sent[0].filter(F.size("groups") > 0).count() == 100


def test_knn_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi_knn.knn_join(empty, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert voronoi_knn.knn_join(one, F.col("id") == 1).count() == 0
    assert voronoi_knn.knn_join(one, F.col("id") == 0).count() == 0


# 2 -----------------------------------------------------------------------------------------------


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
    return c


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("size", [64, 255 * 16, 4096, 65_088, 300_032])
def test_ogg_round_trip(size):
    data = random.Random(size).randbytes(size)
    made = ogg.encode(data, size - 3)
    m = ogg._read(made)
    assert (m["payload"], m["n_bytes"], m["bad_pages"], m["lost"], m["streams"], m["ended"]) == (data, size - 3, 0, 0, 2, True)
    assert m["micros"] == size * 1_000_000 // ogg.RATE
    # Every packet of samples ends where its last sample does, also those before the last of a page.
    packets = [p for p in ogg._dated(ogg.demultiplex(made)) if p["serial"] == zlib.crc32(data) & 0x7FFFFFFF]
    ends = [0, *(min(i + ogg.SAMPLES, size) for i in range(0, size, ogg.SAMPLES))]
    assert [p["granule"] for p in packets] == ends and [p["micros"] for p in packets] == [e * 1_000_000 // ogg.RATE for e in ends]
    assert m["packets"] == len(ends) + 2


def page_of(flags, granule, serial, number, packets, open_end=False):
    """A page laid out by RFC 3533 with nothing of the module's writer: lacing values, body, checksum by bits."""
    lacing = b"".join(bytes([255] * (len(p) // 255)) + (b"" if open_end and p is packets[-1] else bytes([len(p) % 255])) for p in packets)
    head = b"OggS" + bytes([0, flags]) + granule.to_bytes(8, "little") + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    rest = bytes([len(lacing)]) + lacing + b"".join(packets)
    return head + slow_crc(head + bytes(4) + rest).to_bytes(4, "little") + rest


def test_ogg_dates_of_foreign_media():
    """Two interleaved streams, a packet over three pages, several packets on a page, and one page without an end of a packet."""
    import struct

    head, none = struct.pack("<8sBBI", b"PCMU8   ", 1, 1, 1000), (1 << 64) - 1
    long = bytes(range(255)) * 4 + b"end"
    data = page_of(2, 0, 7, 0, [head]) + page_of(2, 0, 9, 0, [b"other"])
    data += page_of(0, 600, 7, 1, [b"a" * 100, b"b" * 200, b"c" * 300, long[:510]], open_end=True)
    data += page_of(0, 44, 9, 1, [b"x", b"y"]) + page_of(1, none, 7, 2, [long[510:765]], open_end=True)
    data += page_of(1 | 4, 600 + len(long) + 50, 7, 3, [long[765:], b"d" * 50]) + page_of(4, 99, 9, 2, [b"z"])
    m = ogg.demultiplex(data)
    assert m.bad_pages == 0 and m.skipped == 0 and m.streams[7].packets == [head, b"a" * 100, b"b" * 200, b"c" * 300, long, b"d" * 50]
    got = [(p["serial"], p["granule"], p["micros"]) for p in ogg._dated(m)]
    n = 600 + len(long)
    assert got == [(7, x, x * 1000) for x in (0, 100, 300, 600, n, n + 50)] + [(9, 0, 0), (9, None, None), (9, 44, 44_000), (9, 99, 99_000)]


def test_ogg_packets_over_pages_and_damage():
    big = random.Random(1).randbytes(70_000)  # more than a page holds
    made = ogg.pages([(b"head", 0), (big, 7), (b"", 8), (b"x" * 255, 9)], 5)
    data = b"".join(p for _, p in made)
    assert ogg.demultiplex(data).streams[5].packets == [b"head", big, b"", b"x" * 255]
    assert [g for g, _ in made] == [0, ogg.NONE, 9]
    hurt = bytearray(data)
    hurt[len(made[0][1]) + 400] ^= 1
    m = ogg.demultiplex(bytes(hurt))
    assert m.bad_pages == 1 and m.streams[5].packets[0] == b"head" and big not in m.streams[5].packets
    assert ogg.demultiplex(b"junk" + data).skipped == 4
    assert ogg.demultiplex(b"").streams == {}


def test_ogg_columns(spark, docs):
    media = docs.select("doc_id", ogg.ogg_from_text(F.col("text")).alias("media"))
    rows = media.select("doc_id", ogg.read_ogg(F.col("media")).alias("m")).collect()
    for r in rows:
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            assert r.m.n_bytes == len(raw) and bytes(r.m.payload) == raw + bytes(-len(raw) % 64 if raw else 64)
    none = spark.createDataFrame([(None,)], "media binary").select(ogg.read_ogg(F.col("media")).alias("m")).select("m.streams", "m.payload", "m.micros").first()
    assert none == (None, None, None)
    packets = ogg.ogg_packets(media.filter("doc_id = 5"), "media", "doc_id")
    own = sorted((p.packet, p.granule, p.micros) for p in packets.filter("serial < 2147483648").collect())
    size = len(LONG) + -len(LONG) % 64
    assert own == [(i, g, g * 125) for i, g in enumerate([0, *(min(k + ogg.SAMPLES, size) for k in range(0, size, ogg.SAMPLES))])]
    assert ogg.ogg_packets(media.limit(0), "media").count() == 0


# 3 -----------------------------------------------------------------------------------------------


def kn_brute(train, texts, bits):
    """The same model with dictionaries."""
    from collections import Counter
    from math import exp, log

    seqs = lambda t: next(kneser_ney.word_classes([t], bits)).tolist()
    pairs = Counter((a, b) for t in train for s in [seqs(t)] for a, b in zip(s, s[1:]))
    total, kinds, before = Counter(), {}, Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        kinds.setdefault(v, Counter())[min(n, 3)] += 1
        before[w] += 1

    def disc(values):
        n = [max(1.0, float(sum(x == i for x in values))) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1 * i), 0.95 * i) for i in (1, 2, 3)]

    d, e = disc(pairs.values()), disc(before.values())
    every = sum(before.values())
    left = sum(e[min(n, 3)] for n in before.values()) / every
    low = lambda w: max(before[w] - e[min(before[w], 3)], 0) / every + left / 2**bits
    out = []
    for t in texts:
        s, lp = seqs(t), 0.0
        for v, w in zip(s, s[1:]):
            back = 1.0
            if total[v]:
                k = kinds[v]
                back = max((d[1] * k[1] + d[2] * k[2] + d[3] * k[3]) / total[v], 1e-9)
            n = pairs[v, w]
            lp += log((n - d[min(n, 3)]) / total[v] + back * low(w)) if n else log(back * low(w))
        out.append(exp(-lp / (len(s) - 1)) if len(s) > 1 else None)
    return out


def test_kneser_ney_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary[: 20 + i % 40], k=rng.randrange(5, 60))) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scratch = Scratch(spark, "test")
    rows = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels, scratch, vocab_bits=12, shards=3).collect()}
    train = [texts[i] for i in range(40) if rows[i].role == "train"]
    assert 20 < len(train) < 40 and sum(rows[i].role == "held" for i in range(40)) == 40 - len(train)
    for i, want in enumerate(kn_brute(train, texts, 12)):
        assert np.exp(rows[i].log_ppl) == pytest.approx(want, rel=1e-4)


def test_quality_separates_and_survives(spark, docs):
    rng = random.Random(5)
    good = [" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "and", "dog"], k=40)) for _ in range(200)]
    bad = [" ".join(f"{rng.randrange(10**6)}$$" for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(210, 0, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.filter_quality(df, labels, vocab_bits=12).collect()}
    assert len(kept & set(range(200))) > 195 and not kept & set(range(200, 220))
    out = {r.doc_id: r for r in kneser_ney.classify(docs, labels.limit(0), vocab_bits=12).collect()}
    assert out[0].keep and not out[1].keep and not out[2].keep and not out[3].keep and out[None].keep
    odd = {r.doc_id: r for r in kneser_ney.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], labels.schema), vocab_bits=12).collect()}
    assert set(odd) == {*range(len(TEXTS)), None} and odd[1].perplexity is None and not odd[1].keep and odd[5].words == 30_001
    assert kneser_ney.classify(docs.limit(0), labels, vocab_bits=12).count() == 0


def test_kneser_ney_counts_all_trusted_documents(spark):
    """More documents than the bound of former versions: every trusted one trains or sets thresholds, whatever the shards."""
    n = 210_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id") % 5)).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 100 == 1, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    scratch = Scratch(spark, "test")
    out = scratch.save(kneser_ney.perplexities(docs, labels, scratch, vocab_bits=12))
    assert out.count() == n and out.filter("role is not null").count() == n - n // 100 and out.filter("role is null and doc_id % 100 <> 1").count() == 0
    trusted = kneser_ney.trusted_ids(labels, 3).filter("not held")
    # A filter that is full keeps nothing back; the join leaves only trusted ids.
    merged = kneser_ney.merge_counts(kneser_ney.count_pairs(kneser_ney.words_of(docs, trusted, 12, 9), 12, 5)).collect()
    counted = sum(int(kneser_ney._unpack(bytes(r.counts), "<i4").sum()) for r in merged)
    assert counted == 2 * trusted.count() == 2 * out.filter("role = 'train'").count()


def test_kneser_ney_quantile(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([3.25, rng.gauss(5, 2)])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 900))] + [("one", 2.5), ("two", 1.0), ("two", 9.0)]
    df = spark.createDataFrame(rows, "lang string, v double")
    for q in (0.0, 0.37, 0.99, 1.0):
        got = {r.lang: (r.cut, r.n) for r in kneser_ney.quantile_of(df, "lang", "v", q).collect()}
        want = {r.lang: (r.c, r.n) for r in df.groupBy("lang").agg(F.percentile("v", F.lit(q)).alias("c"), F.count("v").alias("n")).collect()}
        assert got == want


# 4 -----------------------------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_brute(x):
    out = []
    for kind, pattern, _ in pii.KINDS:
        for m in re.finditer(pattern, x):
            t, d = m[0], re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, t.split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111-1111-1111-1111 4111 1111 1111 1111 5", "4111-1111-1111-1111", "+1 (2) 3-4.5 67890 +12345678901234567 é +49 30 1234567", "a.a@b..c @x.y z@z-.q", "+" * 50 + "1" * 3000 + "a" * 3000 + "@", "1 " * 4000, None, "", "😀 bob@x.io 10.0.0.1, 😀😀 10.0.0.999", "%" * 10 + "@a.b@c.d", "x" * 2000, "a.b" * 500 + "@c.d" * 50]
PII_LONG = ["x" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" + " " * 300_000, "a." * 150_000, "x@" * 150_000, "1.2." * 70_000 + "x", "key=" + "1" + "," * 300_000 + "x", "x" * 300_000 + " y: 5", "9" + "(" * 300_000 + " z", "a=" * 150_000 + "1"]


def test_pii_brute_force(spark):
    rng = random.Random(2)
    texts = PII + ["".join(rng.choices("ab1290.@-+ ()%_é\n", k=200)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("s", F.lit("clash"))
    for r in pii.find(df).collect():
        got = [f"{k}:{x.s}:{x.e}" for k in ("email", "ip", "card", "phone") for x in r[k]]
        assert got == base_brute(texts[r.doc_id] or ""), texts[r.doc_id][:80]
        for x in r.ctx:
            assert 0 <= x.s < x.e <= len(texts[r.doc_id])


W = r"[^\x20\x09-\x0D]"


def ctx_brute(texts, rounds=3, support=3, confidence=0.75):
    """Spans by document, from the statement of the method: plain words, strings and dictionaries."""
    seen, graph, seeds, known, bad = [], {}, set(), set(), set()
    letters = lambda w: re.sub("[^a-z_]", "", w)
    for doc, text in enumerate(texts):
        words = [(m.start(), m[0]) for m in re.finditer(f"{W}+", text or "")]
        plain = [None if re.search("[0-9@]", w) else w.lower() for _, w in words]
        at = lambda i: plain[i] if 0 <= i < len(plain) else None  # noqa: E731, B023
        for i, (start, word) in enumerate(words):
            if plain[i] is not None:
                continue
            right = word.lstrip(pii.LEADING)
            inner = re.match(r"[A-Za-z_][A-Za-z_-]*[=:](?!/)[\"'(\[]*", right)
            inner = inner[0] if inner else ""
            core = right[len(inner) :].rstrip(pii.TRAILING)
            if not core:
                continue
            last = at(i - 1) or ""
            before, two = (inner.lower(), last) if inner else (last, (at(i - 2) or "") if last else "")
            after, label = at(i + 1) or "", ""
            if re.search(r"[=:][\"'(\[]*$", before):
                label = letters(two if re.fullmatch("[=:]+", before) else before)
                label = letters(two) if label in pii.NUMBER else label
            digits = re.sub("[^0-9]", "", word)
            base = bool(re.search(pii.KINDS[0][1], word)) or word[0] == "+" and word[1:2].isdigit()
            base |= 13 <= len(digits) <= 19 and luhn(digits)
            ip = re.search(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", word)
            base |= bool(ip) and all(int(x) <= 255 for x in ip[0].split("."))
            refused = not base and label not in pii.LABELS and bool(ip or re.fullmatch("[0-9](-?[0-9]){12,18}", core))
            value, patterns = core.lower(), []
            if before and two:
                patterns.append(("L", two, before))
            if before and after:
                patterns.append(("B", before, after))
            if label:
                patterns.append(("N", label))
            if len(core) >= 8:
                mixed = re.fullmatch("[A-Za-z0-9]{12,}", core) and re.search("[0-9]", core) and re.search("[A-Za-z]", core)
                patterns.append(("S", f"x{len(core)}" if mixed or len(core) > 64 else re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", core))))
            s = start + word.index(right) + len(inner) if right else start
            seen.append((doc, s, s + len(core), base or refused, patterns))
            for p in patterns:
                graph.setdefault(p, set()).add(value)
                if base or label in pii.LABELS:
                    seeds.add((p, value))
                if base:
                    known.add((p, value))
                if refused:
                    bad.add((p, value))
    able = {p for p, v in graph.items() if len(v) >= support and any((p, x) not in known for x in v)}
    admitted = {p for p in able if sum((p, x) in seeds for x in graph[p]) >= support}
    score, strength, done = {}, {}, 0
    while True:
        new = {p: sum(score.get(x, float((p, x) in seeds)) for x in graph[p]) / (len(graph[p]) + 1) for p in admitted}
        seed = {x for p in admitted for x in graph[p] if (p, x) in seeds}
        refused = {x for p in admitted for x in graph[p] if (p, x) in bad}
        own = {}
        for p in admitted:
            for x in graph[p]:
                own.setdefault(x, []).append(new[p])
        score = {x: 1.0 if x in seed else 0.0 if x in refused else sum(y) / len(y) for x, y in own.items()}
        moved = max((abs(y - strength.get(p, 0)) for p, y in new.items()), default=0) if done else 1
        strength, done = new, done + 1
        more = {p for p in able - admitted if sum((p, x) in seeds or score.get(x, 0) >= confidence for x in graph[p]) >= support}
        admitted |= more
        if not more and done >= rounds and moved <= 0.02:
            break
    out = {}
    for doc, s, e, base, patterns in seen:
        if not base and any(strength.get(p, 0) >= confidence for p in patterns):
            out.setdefault(doc, set()).add((s, e))
    return out


def test_pii_context_brute_force(spark):
    rng = random.Random(8)
    some = ["ssn: 12-34-{}", "account no: {}{}", 'token = "ab{}cd{}"', "key={}x{}", "card 4111111111111111", "mail u{}@x.org now", "see 10.0.0.{} there", "call +4930{}5678 soon", "year {} was", "(id:{}{}9)", "ref {}aaaaaa{}aaaa##", "see host {} there", "card 4111111111111112", "card 50{}{}1234123412", "see 10.0.0.3{} there", "pin: 41111111111111{}"]
    words_ = ["the", "a", "see", "mail", "Ref", "é"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            parts += rng.choices(words_, k=rng.randrange(3)) + [rng.choice(some).replace("{}", str(rng.randrange(40, 99)), 1).replace("{}", str(rng.randrange(10, 99)))]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, found = ctx_brute(texts), 0
    for r in pii.find(df).collect():
        base = [(x.s, x.e) for k in ("email", "ip", "card", "phone") for x in r[k]]
        free = {(s, e) for s, e in want.get(r.doc_id, ()) if not any(a < e and s < b for a, b in base)}
        assert {(x.s, x.e) for x in r.ctx} == free, texts[r.doc_id]
        found += len(free)
    assert found > 50


def test_pii_discovers_from_what_it_found(spark):
    """Mails stand in one context; codes share it, and stand in a second one where further codes do: two steps from any seed."""
    code = lambda i: "".join(chr(97 + (i * 7 + 3 * j * j + j) % 26) for j in range(5)) + str(i)
    rows = [f"please write u{i}@x.org today" for i in range(30)] + [f"please write {code(i)} today" for i in range(30)]
    rows += [f"ask for {code(i)} there" for i in range(60)] + [f"room {i} was cold" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id for r in pii.find(df).collect() if r.ctx}
    assert got == set(range(30, 120)) and set(ctx_brute(rows)) == got


def test_redact_with_clashing_names(spark):
    names = ["_hash", "_h", "_id", "_spans", "spans", "hash", "row", "text_hash", "email", "ctx", "rid", "value", "cand", "gaps", "found", "parts"]
    df = spark.createDataFrame([(1, "mail a@b.org now", *names), (None, None, *names), (2, "plain", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r[0]: tuple(r)[1:] for r in pii.redact(df).collect()}
    assert got == {1: ("mail [EMAIL] now", *names), None: (None, *names), 2: ("plain", *names)} and pii.redact(df).columns == df.columns


def test_pii_finds_labelled_secrets(spark):
    """Values under a label are found, and others of the same shape without one; numbers of other shapes are left alone."""
    rng = random.Random(9)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=39)) + "7f"[rng.randrange(2)]
    rows = [f'some words token = "{token()}" and {rng.randrange(100)} more' for _ in range(8)] + [f"bare {token()} here", "in 1999 or 2.0 there"]
    got = {r.doc_id: [(x.s, x.e) for x in r.ctx] for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == [(20, 60)] for i in range(8)) and got[8] == [(5, 45)] and got[9] == []


def test_pii_long_texts_in_linear_time(spark):
    df = spark.createDataFrame(list(enumerate(PII_LONG)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert not any(len(got[i][k]) for i in range(6) for k in ("email", "card", "phone", "ip")) and len(got[6].ip) == 35_000


def test_pii_bootstraps_and_redacts(spark):
    rows = [(i, f"please send the case file: user{i}@mail.org today friend {i}") for i in range(6)] + [(200, "please send the case file: KX-4471-Q today ok"), (201, "nothing 55 here"), (201, "nothing 55 here"), (None, "mail me@x.io"), (300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0))
    out = sorted((r.doc_id is None, r.doc_id, r.text) for r in pii.redact(df).collect())
    assert (False, 200, "please send the case file: [CTX] today ok") in out and (False, 3, "please send the case file: [EMAIL] today friend 3") in out
    assert (True, None, "mail [EMAIL]") in out and out.count((False, 201, "nothing 55 here")) == 2 and (False, 300, None) in out and len(out) == len(rows)
    assert pii.redact(df.limit(0)).count() == 0


# 5 -----------------------------------------------------------------------------------------------


def dedup_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        if i is not None and w:
            sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 14)):
            copy = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base]
            rows.append((n, rng.choice([" ", "\n", "  "]).join(copy).title()))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, " \t"), (n + 4, "one"), (n + 5, "ONE"), (n + 6, LONG), (n + 7, LONG + " end"), (7, rows[7][1])]
    rows += [(n + 8, "an id with two texts that have nothing to do with one another"), (n + 8, rows[30][1]), (n + 8, None), (2, rows[50][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("component", F.lit(1))
    want = dedup_brute(rows, 4, 80)
    for block in (512, 3):
        got = minhash.near_duplicates(df, k=4, block=block).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {r.doc_id: r.n_shingles for r in got if r.doc_id != n + 8}
    assert sizes[n + 1] == sizes[n + 3] == 0 and sizes[n + 4] == 1 and sizes[n + 6] == 2
    kept = [r.doc_id for r in minhash.drop_near_duplicates(df, k=4).collect()]
    assert sorted(kept) == sorted({i for i, c in want.items() if i == c})


def test_near_duplicates_among_even_overlaps(spark):
    """All documents share 0.3 of their words evenly, so that the least class of nearly every bucket is none of two near copies."""
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(1000)]
    sets = [rng.sample(pool, 460) for _ in range(600)]
    sets += [[*s[20:], *(f"y{i}_{j}" for j in range(20))] for i, s in enumerate(sets[-30:])]
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)]
    want = dedup_brute(rows, 1, 80)
    assert sum(i != c for i, c in want.items()) == 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=1, bands=160, rows=1, block=100).collect()}
    assert got == want


def test_near_forest():
    rng = np.random.default_rng(8)
    for trial in range(30):
        base = rng.integers(0, 256, (6, 160), dtype=np.uint8)
        signs = np.where(rng.random((40, 160)) < 0.3, rng.integers(0, 256, (40, 160), dtype=np.uint8), base[rng.integers(0, 6, 40)])
        known, side = rng.integers(0, 60, 40), [None, rng.integers(0, 2, 40)][trial % 2]
        agree = np.array([minhash._agreement(signs, x) >= 0.45 for x in signs]) & (True if side is None else side[:, None] != side[None, :])

        def parts(pairs):
            label = known.copy()
            for _ in range(40):
                for a, b in pairs:
                    label[(label == label[a]) | (label == label[b])] = min(label[a], label[b])
            return label.tolist()

        got = minhash.near_forest(signs, known, 0.45, side)
        assert all(agree[a, b] for a, b in got) and parts(got) == parts(np.argwhere(agree).tolist())


def test_near_duplicates_odd(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got[7].component_id == 0 and not got[7].kept and got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_id_stays(spark):
    """Of several rows of one id the same one stays, however the table is dealt out; rows without id all stay, and names do not clash."""
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "y"), (1, "other words are here now too", "z"), (2, "one two three four five six", "x"), (None, None, "n"), (None, "a b", "n"), (3, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"id": F.lit("i"), "nth": F.lit(7), "n": F.lit("m")})
    first = sorted(map(tuple, minhash.drop_near_duplicates(df).collect()), key=str)
    assert [r[0] for r in first].count(1) == 1 and [r[0] for r in first].count(None) == 2 and 2 not in [r[0] for r in first]
    for n in (1, 3, 7):
        assert sorted(map(tuple, minhash.drop_near_duplicates(df.repartition(n)).collect()), key=str) == first
    assert minhash.drop_near_duplicates(df).columns == df.columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 4)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {x: find(x) for x in root if sum(x in e and e[0] != e[1] for e in edges)}


def test_word_hashes():
    texts = TEXTS + ["A b\tC\x0bd", "x" * 600_000 + " y " + "Z" * 600_000]
    got = [list(w) for _, g in word_hashes(texts) for w in g]
    assert [len(x) for x in got] == [len(words(t)) for t in texts]
    seen = {}
    for t, h in zip(texts, got):
        for w, x in zip(words(t), h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(shingles(np.array(got[0]), 4)) == 6 and len(shingles(np.array(got[1], np.uint64), 4)) == 0


# 6 -----------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    known = dict(licenses.SENTENCES)
    mit = " ".join(known[x] for x in ("mit-grant", "mit-notice", "mit-as-is"))
    gpl = " ".join(known[x] for x in ("gpl-program", "gpl-2-later", "gpl-hope"))
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, mit), (3, "Licensed under CC BY-NC 4.0. Released under the MIT license! LICENSED under the Apache License, version 2.0."), (4, None), (5, "the license is here"), (1, "Released under the MIT License."), (6, LONG + "\nLicensed under CC BY 4.0."), (7, gpl)]
    got = sorted((r.doc_id, r.n_known, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0))).collect())
    assert got == [(1, 1, "MIT"), (1, 1, "MIT"), (2, 3, "MIT"), (3, 3, "MIT,Apache-2.0,CC-BY-NC-4.0"), (4, 0, ""), (5, 0, ""), (6, 1, "CC-BY-4.0"), (7, 3, "GPL-2.0-or-later")]
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_in_wrapped_texts(spark):
    import textwrap

    known = dict(licenses.SENTENCES)
    wrap = {name: [known[x] for x in rule] for name, rule in (("MIT", ("mit-grant", "mit-notice", "mit-as-is")), ("BSD", ("bsd-grant",)), ("GPL-3.0-or-later", ("gpl-program", "gpl-3-later", "gpl-hope")), ("Apache-2.0", ("apache-2-long", "apache-2-use", "apache-2-copy", "apache-2-basis")))}
    rows = []
    for name, sentences in wrap.items():
        for mark in ("", "# ", " * ", "// "):
            lines = ["Copyright 2020 Somebody", *textwrap.wrap(" ".join(sentences), 70)]
            rows.append((len(rows), "\n".join(mark + x for x in lines) + "\n", name, len(sentences)))
    url = "Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless"
    rows.append((len(rows), "# " + url, "Apache-2.0", 3))
    rows.append((len(rows), "Released under\n\nthe MIT License.", "", 0))
    rows.append((len(rows), "A title\nReleased under the MIT License.\nmore\nReleased under the MIT\r\nLicense.", "MIT", 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string, n long")
    got = {r.doc_id: (r.licenses, r.n_known) for r in licenses.scan_licenses(df).collect()}
    assert got == {i: (name, n) for i, _, name, n in rows}


MIT = """MIT License

Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2019 The Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
GPL = """/*
 *  This program is free software; you can redistribute it and/or modify
 *  it under the terms of the GNU General Public License as published by
 *  the Free Software Foundation; either version 2 of the License, or
 *  (at your option) any later version.
 *
 *  This program is distributed in the hope that it will be useful,
 *  but WITHOUT ANY WARRANTY; without even the implied warranty of
 *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 *  GNU General Public License for more details.
 */
int main() {}
"""
LGPL = GPL.replace("This program is", "This library is").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
BSD3 = """Copyright (c) 2001, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD2 = BSD3.replace(BSD3[BSD3.index("3. Neither") : BSD3.index("THIS SOFTWARE IS")], "")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
AGPL = """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU Affero General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any
later version.
"""
WHOLE = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-2.0-or-later": GPL, "LGPL-2.1-or-later": LGPL, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "ISC": ISC, "MPL-2.0": MPL, "AGPL-3.0-or-later": AGPL}


def test_licenses_as_shipped_and_sql(spark, tmp_path):
    """Licences as they stand in files are recognised by their ordered rules, and the SQL gives the same."""
    import duckdb

    rows = [*WHOLE.items(), ("MIT,BSD-3-Clause", "x\n" + BSD3 + "\n\n" + MIT), ("", MIT.replace("free of charge", "at a charge").replace("copies or", "pages or").replace("EXPRESS OR", "")), ("", ""), ("", None)]
    rows += [(None, mark + MIT.replace("\n", "\n" + mark)) for mark in ("# ", " * ", "-- ", "")] + [(None, BSD2.replace("\n", "\r\n")), (None, APACHE.replace("\n", " "))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(df).collect()}
    for i, (want, _) in enumerate(rows):
        if want is not None and "," not in want:
            assert got[i][2] == want, want
    assert set(got[len(WHOLE)][2].split(",")) == {"MIT", "BSD-3-Clause"} and got[len(WHOLE) + 4][2] == "MIT"
    assert min(got[i][0] for i in range(len(WHOLE))) > 1
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(licenses.OP6_SQL).fetchall()} == got


# 7 -----------------------------------------------------------------------------------------------


def test_mixing_targets(spark, docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a"] * 6 + ["b", "c", "d", "é", None])) for i in range(900)] + [(5, "w w", "a"), (None, "w", "z"), (2000, None, "y"), (2001, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size, weight = {}, {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    for j, s in enumerate(sorted((s for s in size if s is not None)) + [None]):
        weight[s] = (5, 2, 1)[j % 3]
    target, free, left = {}, set(size), float(sum(size.values()))
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    by = {}
    source = {i: s for i, _, s in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    for s in by:
        assert abs(by[s] - target[s]) <= 1
    again = sorted(mixing.mix(df.repartition(7)).collect(), key=str)
    assert again == sorted(out, key=str)
    taken = sum(len((r.text or "").split()) for r in mixing.mixed_documents(df).collect())
    assert taken == sum(by.values())
    # A column of weights: of one source's documents the heavy ones come first.
    heavy = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b", 1000.0 if i % 2 else None) for i in range(80)], "doc_id long, text string, source string, q double")
    part = {r.doc_id: r.taken for r in mixing.mix(heavy, quality_col="q", source_col="source").collect()}
    extra = [i for i in range(40) if part[i] > min(part[j] for j in range(40))] or [i for i in range(40, 80) if part[i] > min(part[j] for j in range(40, 80))]
    assert extra and sum(i % 2 for i in extra) >= len(extra) * 0.9 - 1
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_with_clashing_names(spark):
    names = ["target", "docs", "epochs", "before", "source_size", "part", "_id", "_words", "_size", "_source", "_key", "row", "rid", "budget", "bins", "last_bin", "taken", "_bin", "_of", "_s", "_nth", "_n", "weight", "level"]
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 3 == 0], *names) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    out = got.collect()
    assert out and all(tuple(r)[3:] == tuple(names) for r in out)
    plain = mixing.mixed_documents(df.select("doc_id", "text", "source")).collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted(tuple(r) for r in plain)
    assert mixing.mix(df).count() == 60


def test_mixing_with_heavy_weights_and_equal_rows(spark):
    """Weights of any size leave no bin with most of a source's documents, and rows of one draw are taken in order until the budget ends."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("a").alias("source"), F.lit(1000.0).alias("q"))
    keyed = mixing.with_keys(df, quality_col="q").withColumn("bin", mixing._bin(F.col("_key"), F.lit(142)))
    assert keyed.groupBy("bin").count().agg(F.max("count")).first()[0] < 120
    rows = [(None, "w w w", "a")] * 900 + [(7, "w w", "a")] * 50 + [(None, "w", "a")] * 40 + [(1, "w " * 3000, "b")]
    same = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(same).collect()
    a = [r for r in out if r.doc_id != 1]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 1 and max(r.taken - 3 * r.size for r in out) <= 0
    partial = [r for r in a if r.taken % r.size]
    assert len(partial) <= 1 and sorted(map(tuple, mixing.mix(same.repartition(3)).collect()), key=str) == sorted(map(tuple, out), key=str)
    texts = mixing.mixed_documents(same.filter("source = 'a'").unionByName(same.filter("source = 'b'"))).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.source: r.n for r in texts.collect()}["a"] == sum(r.taken for r in a)


# 8, 10 -------------------------------------------------------------------------------------------


def all_ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.tokenizer_file("byte_bpe_50k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids


def test_text_tokenizer():
    tok, plain = token_ids.tokenizer(), token_ids.tokenizer(special=False)
    odd = [*TEXTS, "it's we'll 'sx  two   spaces\n\n\nlines \t tab", "a\xa0b\x1fc d", "naïve — “quoted” 日本語 ½² 😀😀 ₿ \u3000x", "ab" * 400, "'s't ' s", "\r\n\r\n x", "\U0001fae8 \u0378 ꟁ a\u200bb", "x" + " " * 5000 + "y"]
    for text in odd:
        assert tok.ids(text).tolist() == all_ids(text) and plain.ids(text).tolist() == plain_ids(text)
    for i in (0, 2, 5, 7):
        assert not token_ids.unsure(TEXTS[i])
    assert token_ids.unsure("\x1f") and token_ids.unsure("\u0378") and token_ids.unsure("😀\U0001fa10\U0001e5d0") and not token_ids.unsure("é中жאあ😀—“”\xa0")


def test_both_libraries_cut_alike():
    """Every character that goes by the ranks, among letters, digits, blanks and marks; and words of random letters, whose merges must agree."""
    from tokenizers import Tokenizer

    tok = token_ids.tokenizer(special=False)
    whole = Tokenizer.from_file(token_ids.tokenizer_file("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(1, token_ids.END) if not 0xD800 <= c < 0xE000]
    chars = [c for c in chars if not token_ids.unsure(c)]
    assert len(chars) > 90_000
    rng = random.Random(11)
    texts = ["".join(f"a{c}b1{c}2 {c} {c}{c}!{c}. " for c in chars[i : i + 50]) for i in range(0, len(chars), 50)]
    texts += [" ".join("".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzETAS", k=rng.randrange(1, 14))) for _ in range(400)) for _ in range(300)]
    texts += ["".join(rng.choices("ab ,.\n\t'12éß—", k=500)) for _ in range(300)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tok.ids(text).tolist() == want.ids, text[:60]


def test_cost_packing(spark, docs):
    for options in ({}, {"capacity": 16, "block_tokens": 200}):
        rows = cost_packing.pack_by_cost(docs, **options).collect()
        cap, by, seq = options.get("capacity", 1024), {}, {}
        for r in rows:
            assert len(r.ids) == 4 * r.length and 0 < r.length <= cap
            by.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, t in enumerate(TEXTS):
            ids = [x for _, part in sorted(by[i]) for x in part]
            want = all_ids(t) + [0]
            assert ids == want * (2 if i == 0 else 1) or sorted(ids) == sorted(want * 2)
        for parts in seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap
    assert cost_packing.pack_by_cost(docs.limit(0)).count() == 0


def test_balance_evens_cost():
    rng = random.Random(0)
    lengths = [rng.randrange(1, 3000) for _ in range(500)]
    pieces, n = cost_packing.balance(lengths, 1024, 1.0, 1 / 1024)
    assert sum(p[2] for p in pieces) == sum(lengths) and n <= -(-sum(lengths) // 1024) + 1
    cover = {}
    for d, s, m, _, _ in pieces:
        cover.setdefault(d, []).append((s, m))
    for d, parts in cover.items():
        at = 0
        for s, m in sorted(parts):
            assert s == at
            at += m
        assert at == lengths[d]


def test_balance_cuts_only_where_nothing_fits():
    rng = random.Random(9)
    for trial in range(40):
        capacity = rng.choice([1, 2, 16, 100, 1024])
        lengths = [rng.randrange(0, 2 * capacity) if trial % 2 else 1 + int(capacity * rng.random() ** 4) for _ in range(300)]
        left = sorted((-(n % capacity), d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity)
        full = sum(n // capacity for n in lengths)
        state = {full + i: [0.0, 0] for i in range(-(-sum(-x[0] for x in left) // capacity))}
        want = []
        while left:
            n, doc, start = left.pop(0)
            n = -n
            room = [(c, k) for k, (c, used) in state.items() if used < capacity and capacity - used >= n]
            _, k = min(room or [(c, k) for k, (c, used) in state.items() if used < capacity])
            if not room:
                part = capacity - state[k][1]
                left = sorted([*left, (part - n, doc, start + part)])
                n = part
            want.append((doc, start, n, k, state[k][1]))
            state[k] = [state[k][0] + 1.0 * n + 0.001 * n * n, state[k][1] + n]
        got, sequences = cost_packing.balance(lengths, capacity, 1.0, 0.001)
        assert got[full:] == want and sequences == full + len(state)


def plain_ids(text):
    """By the tokenizers library itself."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids


def test_best_fit_long_runs(spark):
    """Runs of white space on which the ranks' pattern would overflow."""
    texts = [" " * 2_000_000 + "a", "\n" * 2_000_000, "b" + "\t \n" * 500 + " c\u3000\x85" * 2, "é" * 100_000, "x" + " " * 999 + "y", "x" + " " * 1001 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in best_fit_packing.pack_best_fit(df).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for i, d in enumerate(r.doc_ids):
            got.setdefault(d, []).append((r.starts[i], ids[r.cu_lengths[i] : r.cu_lengths[i + 1]]))
    for i, t in enumerate(texts):
        assert np.concatenate([x for _, x in sorted(got[i], key=lambda p: p[0])]).tolist() == plain_ids(t) + [50256]


def test_best_fit(spark, docs):
    rng = random.Random(0)
    lengths = [rng.randrange(1, 200) for _ in range(300)]
    rows = best_fit_packing.best_fit(lengths, 64)
    bins = []  # plain best fit, for the number of rows
    for n in sorted((x % 64 for x in lengths if x % 64), reverse=True):
        fit = min((b for b in bins if b[0] >= n), default=None, key=lambda b: b[0])
        if fit is None:
            bins.append([64 - n])
        else:
            fit[0] -= n
    assert len(rows) == len(bins) + sum(x // 64 for x in lengths)
    assert sorted(s for r in rows for s in r) == sorted((d, s, min(64, n - s) if s == n - n % 64 else 64) for d, n in enumerate(lengths) for s in range(0, n, 64))
    got = {}
    for r in best_fit_packing.pack_best_fit(docs, capacity=32).collect():
        ids, place = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 32 and r.cu_lengths[0] == 0 and r.cu_lengths[-1] == r.tokens
        for i, d in enumerate(r.doc_ids):
            a, b = r.cu_lengths[i : i + 2]
            assert place[a:b].tolist() == list(range(b - a))
            got.setdefault(d, []).append((r.starts[i], ids[a:b].tolist()))
    for i, t in enumerate(TEXTS):
        if i:
            assert [x for _, p in sorted(got[i]) for x in p] == plain_ids(t) + [50256]
    assert best_fit_packing.pack_best_fit(docs.limit(0)).count() == 0


def test_packed_rows_written(spark, docs, tmp_path):
    packed = best_fit_packing.pack_best_fit(docs, capacity=64)
    best_fit_packing.write_packed(packed, str(tmp_path / "packed"))
    key = lambda r: r.sequence_id
    assert sorted(spark.read.parquet(str(tmp_path / "packed")).collect(), key=key) == sorted(packed.collect(), key=key)


# 9 -----------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "nö"), (1, 2, "user", None), (2, 0, None, "x"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash"))
    got = {r.pair_id: r for r in preferences.format_preferences(df, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[0].prompt_turns == 1
    for side in ("chosen", "rejected"):
        s, e = map(int, got[0][f"{side}_mask"].split(":"))
        assert got[0][side][s:e] == {"chosen": "yes", "rejected": "nö"}[side] + "<|im_end|>\n"
    assert got[0].rejected.endswith("<|im_start|>user\n<|im_end|>\n")
    assert got[1].rejected == "" and got[1].chosen.startswith("<|im_start|>unknown\nx") and got[1].prompt == ""
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt_turns == 1
    assert preferences.format_preferences(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


# contracts ---------------------------------------------------------------------------------------


def test_op2_and_op4_digests(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r in ogg.op2_ogg_media(spark, str(tmp_path)).collect():
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            p = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            made = ogg.encode(p, len(raw))
            assert (r.media_bytes, r.media_sha256) == (len(made), hashlib.sha256(made).hexdigest())
            assert r.feature == f"streams=2 pages={made.count(b'OggS')} packets={3 + -(-len(p) // ogg.SAMPLES)} bad=0 lost=0 micros={len(p) * 125}"
    for r in pii.op4_contextual_pii(spark, str(tmp_path)).collect():
        if r.doc_id is not None and r.doc_id != 5:  # plain patterns take time with the square of a long word
            assert r.base_sha256 == hashlib.sha256(",".join(base_brute(TEXTS[r.doc_id] or "")).encode()).hexdigest()


def test_names_are_json_safe():
    from cladewise.llm import queries

    assert json.dumps(sorted(queries.QUERIES)) and set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
