"""Collocations, forced-boundary BPE and whitening against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import bpe_fragments, phrases, whitening
from cladewise.llm.token_ids import tokenizer_file

# 11 ----------------------------------------------------------------------------------------------


def collocations_brute(rows, least=10, share=50, top=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        lost = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * f[q]}
        scored = []
        for p, a in cand.items():
            if p not in lost:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return out


def odd_texts():
    rng = random.Random(3)
    common, rare = ["the", "of", "A", "a", "new", "york", "city", "é", "ünï"], [f"w{i}" for i in range(40)]
    rows = []
    for i in range(200):
        words = [rng.choice(common if rng.random() < 0.8 else rare) + rng.choice(["", "", "", ",", ". ", "\n", "\t", "  ", "\x1c", "\xa0"]) for _ in range(rng.randint(0, 60))]
        rows.append((" ".join(words), ["en", "fr", None, "und", ""][i % 5]))
    rows += [("new york city " * 400, "en"), ("a a a a " * 300, "en"), (None, "en"), ("", None), (" \t\n.,", "fr"), ("x" * 300_000 + " new york " + "y" * 300_000 + " tail", "en")]
    rows += [("word " * 70_000, "fr"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 20, "shard_words": 500}, {"class_bits": 2, "shard_words": 3000}, {"top": 7, "salts": 3}])
def test_collocations_brute_force(spark, options):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, f long, hash string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(df, **options).collect()}
    assert got == collocations_brute(rows, top=options.get("top", 2000))


def test_collocations_empty(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    none = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_large_counts(spark):
    """Products beyond 64 bits are exact."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r", 1_000_000)).first()[0] == 1_000_000 * a * a // (left * right)


def test_equal_hashes_are_counted_again(spark, monkeypatch):
    """Where two words share a hash under the first seed, another seed is taken."""
    rows = [("aa bb cc. " * 12, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    first, seen = phrases.word_counts, []

    def doubled(texts, seed):
        seen.append(seed)
        out = first(texts, seed)
        return out.withColumn("clash", F.lit(True)) if seed == 1 else out

    monkeypatch.setattr(phrases, "word_counts", doubled)
    assert {tuple(r) for r in phrases.collocations(df).collect()} == collocations_brute(rows)
    assert seen == [1, 2]


def test_fragments_own_each_phrase_once():
    """Every phrase of frequent words is counted by one fragment, that of its rarest word, and blanks stand for rarer words."""
    rng = np.random.default_rng(1)
    h = rng.integers(1, 6, 300).astype(np.uint64)
    f = np.array([0, 5, 50, 20, 20, 90])[h.astype(int)]
    piece = np.cumsum(rng.random(300) < 0.1)
    columns, bits, route = phrases.fragments(h, piece, f, 10, 1 << 40)
    words, count = phrases.mine([phrases.pack(columns, bits, np.ones(len(bits), np.int64))], 1)
    want = Counter()
    for k in (2, 3):
        for i in range(len(h) - k + 1):
            if piece[i] == piece[i + k - 1] and (f[i : i + k] >= 10).all():
                want[(*h[i : i + k].tolist(), *([0] * (3 - k)))] += 1
    assert {tuple(int(w[i]) for w in words): int(count[i]) for i in range(len(count))} == dict(want)
    rank = {int(x): (int(y), int(x)) for x, y in zip(h, f, strict=True)}
    for row in zip(*columns, strict=True):
        assert all(not x or rank[int(x)] >= rank[int(row[0])] for x in row[1:])
    alone = phrases.fragments(h, piece, f, 10, 0)
    assert (np.bitwise_count(alone[1]) == 1).all() and len(alone[1]) == sum(want.values())


# 12 ----------------------------------------------------------------------------------------------

ODD = [
    "the quick brown fox jumps over the lazy dog", None, "", " \n\t ", "one", "word " * 30_000 + "x" * 300_000, "Ünïcode 😀 tëxt, 12   and \x85 more",
    "<|endoftext|> inside 1 2 3<|endoftext|><|endoftext|>", "it's 'tis we'll ...'s don't  go\x1c\n héé 12a", "a  \n \n  b\t\t c　d e   f", "日本語のテキスト。 日本", "x\x00y \x1f z\x7f ~ !", "\r\n\r\n  \r\n end ", " lead", "trail ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def random_texts(n):
    rng = random.Random(11)
    some = [*"abz'sSTtrlmdv.,!?-_019 \n\t\r\x0b\x0c\x1c\x85\xa0éß́日😀 ​　﻿𝟘"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 80))) for _ in range(n)] + [" ".join("".join(rng.choice("ZqxjkVWetaoin'\"%") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(n // 4)]


def test_bpe_as_the_library(library):
    coder = bpe_fragments.FragmentCoder(tokenizer_file("byte_bpe_50k.json"))
    for text in [t for t in ODD if t] + random_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text.encode()), "<u4").tolist() == ids, text[:200]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(5)
    for _ in range(300):  # ids that no text gives
        ids = [rng.randrange(50_300) for _ in range(30)]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_certain_cuts():
    """Cuts are where no token holds both bytes; none behind white space, within a character or before what may go on. Words that are not plain are cut too."""
    coder = bpe_fragments.FragmentCoder(tokenizer_file("byte_bpe_50k.json"))
    text = "ab cdé  'tis don't x1,2 zqzqVjQx ñÿ×÷ç e\u0301 日本 .'s \n\n a"
    raw = text.encode()
    at = coder.cuts(raw).tolist()
    assert at and not coder.inside.all()
    for i in at:
        assert not coder.inside[256 * raw[i - 1] + raw[i]] and raw[i - 1] not in bpe_fragments.WHITE and not 0x80 <= raw[i] < 0xC0
        assert raw[i - 1] != ord("'") or raw[i] in bpe_fragments.WHITE
    fragments = [raw[s:e].decode() for s, e in zip([0, *at], [*at, len(raw)])]
    assert "".join(fragments) == text and " cdé" in fragments and "ab" in fragments and "'t" in fragments and any(f in "zqzqVjQx" and len(f) < 8 for f in fragments)
    asked = []

    class Seen:
        def tokenize(self, part):
            asked.append(part)
            return model.tokenize(part)

    model, coder.model = coder.model, Seen()
    coder.fragment("日zqVj".encode())
    assert len(asked) > 2


def test_bpe_whole_texts(spark, library):
    rows = [(i, t, 0, "clash") for i, t in enumerate(ODD)] + [(None, "no id", 0, "clash"), (0, ODD[0], 0, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string")
    got = bpe_fragments.decode(bpe_fragments.encode(df)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_fragments.decode(bpe_fragments.encode(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, [72, None, 99_999_999, 50256]), (2, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe_fragments.decode(odd).orderBy("doc_id").collect()] == ["i<|endoftext|>", ""]


def test_bpe_query(spark, library):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe_fragments.op12_forced_boundary_bpe(spark, d).collect()} == want


# 13 ----------------------------------------------------------------------------------------------


def exact(rows, scale=1024, shift=100_000):
    """Ids, integers, exact deviations and the covariance matrix by fractions."""
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[int(np.floor(scale * c)) + shift for c in [*v, *[0.0] * (d - len(v))]] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return [i for i, _ in good], y, [sum(a * a for a in r) for r in y], cov


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 5)) * [5, 3, 2, 1, 0.5]
    rows = [(i, v.tolist()) for i, v in enumerate(base @ rng.normal(size=(5, 5)))]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5), (1004, []), (1005, [1.0, 2.0]), (None, [0.1] * 5), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).repartition(5)
    ids, y, deviation, cov = exact(rows)
    n = len(ids)
    model = whitening.fit(whitening.whole(df, "vec_id", "embedding"))
    assert model.n == n and [[Fraction(a, n**3) for a in row] for row in model.scatter] == cov
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation)) for r in got) == sorted((i is None, i or 0, s) for i, s in zip(ids, deviation, strict=True))
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, u = e[::-1], u[:, ::-1]
    want = (np.array(y, float) / n) @ (u / np.sqrt(e))
    place = {i: k for k, i in enumerate(ids)}
    signs = np.sign((model.components * u).sum(0))
    for r in got:
        assert np.allclose(r.whitened, want[place[r.vec_id]] * signs, atol=1e-8)
        assert np.allclose(r.explained, e / e.sum(), rtol=1e-9) and r.n == n and r.identity_error < 1e-9
    w = np.array([r.whitened for r in got])
    assert abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(5)).max() < 1e-9


def test_whitening_extremes(spark):
    """Entries near the ends of 64 bits: scatter and deviations stay exact where they fit."""
    rows = [(0, [1e12, -3.0]), (1, [-7e11, 5.0]), (2, [3.5, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, _, deviation, cov = exact(rows)
    model = whitening.fit(whitening.whole(df, "vec_id", "embedding"))
    assert [[Fraction(a, 27) for a in row] for row in model.scatter] == cov
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()} == dict(zip(ids, deviation, strict=True))
    far = spark.createDataFrame([(0, [1e300]), (1, [-1e300])], "vec_id long, embedding array<double>")
    assert [r.whitened for r in whitening.whiten(far).orderBy("vec_id").collect()] == [[1.0], [-1.0]]


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).orderBy("vec_id").collect()
    assert [r.whitened[1] for r in got] == [None] * 4 and got[0].explained == [1.0, 0.0] and got[0].identity_error < 1e-12
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    r = whitening.whiten(one).first()
    assert r.whitened == [None, None] and r.identity_error is None and int(r.deviation) == 0
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_whitening_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, y, deviation, cov = exact(rows)
    got = whitening.op13_residue_whitening(spark, d).collect()
    assert len(got) == 8 * len(ids) and {r.component for r in got} == set(range(1, 9))
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, deviation, strict=True))
    v = np.array([[float(c) for c in r] for r in cov])
    w = np.zeros((len(ids), 8))
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    # Each column is a projection on an eigenvector: V u = e u, found back by least squares.
    e = np.linalg.eigvalsh(v)[::-1][:8]
    u = np.linalg.lstsq(np.array(y, float) / len(ids), w * np.sqrt(e), rcond=None)[0]
    assert np.allclose(v @ u, u * e, rtol=1e-6, atol=1e-6 * e[0]) and np.allclose((u * u).sum(0), 1, atol=1e-8)
    assert np.allclose([next(r.explained for r in got if r.component == k + 1) for k in range(8)], e / np.trace(v), rtol=1e-9)
    assert got[0].identity_error < 1e-9
