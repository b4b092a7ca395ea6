"""Collocations: phrases of two or three words whose parts belong together, mined by pivot partitioning.

Everything is per language. A phrase's pivot is its rarest word.

1. Words are counted, each task's own counts first. ``2**class_bits`` classes of
   word hashes keep the greatest count of their words: an array of fixed size,
   which is broadcast. It says which words cannot be in a frequent phrase, and
   orders words by rarity (ties by hash). Any order that all tasks share gives
   each phrase one pivot; this one also makes it a rare word.
2. Each word sends one fragment to its partition: itself and up to two words
   before and behind, as far as these are in the same piece and not rarer. What
   is rarer is blanked, and so is all beyond it. A word before must be more
   frequent, not equal, so a phrase that holds its pivot twice is counted once.
   Equal fragments of a task become one with a count, and a partition's
   fragments go in compressed blocks.
3. Partitions are mined locally: of each fragment the phrases that hold its
   pivot, and no other, so a phrase's count is complete where it is made.

A word that occurs more than ``hot`` times sends its fragments one phrase at a
time, and these go by the phrase's hash, so no partition holds all of them.

Words are 64-bit hashes until the end. That no two words share one is checked
while they are counted; where two do, everything is counted again with another
hash.

A phrase of a = f(phrase) occurrences, cut in two, has the score
``unit * a * a / (f(first) * f(rest))``, rounded down; the lowest-scoring cut
counts, the first of equal ones. Phrases inside a longer candidate that occurs
at least ``share`` percent as often are left out. Scores are decimals of 38
digits: exact up to 10**15 occurrences of a phrase.

Defined results: a null or empty text has no words; a null language is ``und``;
ids are not looked at, so rows that repeat count again; bytes that are not
UTF-8 are taken as they stand; ties by score go to the more frequent phrase,
then to the lesser by its UTF-8 bytes; an empty table gives no rows; columns of
other names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import release, slices
from .scratch import Scratch
from .wordhash import mix

#: Bytes hashed at once; longer texts are cut between words.
STEP = 1 << 18
#: Words, or fragments, that a task holds before it sends them.
HELD = 1 << 20
_SOFT, _HARD = b" \t", b".,;:!?\n\x0b\x0c\r"
_IS_HARD = np.zeros(256, bool)
_IS_HARD[list(_HARD)] = True
_IS_GAP = _IS_HARD.copy()
_IS_GAP[list(_SOFT)] = True
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = _LOWER[97:123]
_MASK = (1 << 64) - 1
#: A fragment's phrases: which of the words at -2, -1, 0, 1, 2 each has. Columns of fragments are the pivot, -2, -1, 1, 2.
PHRASES = [(2, 0), (0, 3), (1, 2, 0), (2, 0, 3), (0, 3, 4)]


class Words:
    """Hashes of words, by a polynomial whose base follows from the seed."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.base = int(mix(np.array([0x9E3779B97F4A7C15 + seed], np.uint64))[0]) & ~7 | 5
        self.up, self.down = self._powers(self.base), self._powers(pow(self.base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(STEP + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def language(self, name: str) -> np.uint64:
        return np.uint64(int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, salt=str(self.seed).encode()).digest(), "little"))

    def _long(self, word: bytes) -> int:
        h, at = 0, 1
        for i in range(0, len(word), STEP):
            part = _LOWER[np.frombuffer(word[i : i + STEP], np.uint8)]
            h = (h + at * int((part * self.up[: len(part)]).sum(dtype=np.uint64))) & _MASK
            at = at * pow(self.base, STEP, 1 << 64) & _MASK
        return h

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, number of the piece, start and end of each word."""
        out, at, piece = [], 0, 0
        while at < len(raw):
            end = min(len(raw), at + STEP)
            if end < len(raw):
                cut = max(raw.rfind(bytes([c]), at, end) for c in _SOFT + _HARD)
                if cut < at:  # one word fills the step
                    m = _GAP.search(raw, end)
                    end = m.start() if m else len(raw)
                    h = np.array([(self._long(raw[at:end]) + end - at) & _MASK], np.uint64)
                    out.append((h, np.array([piece]), np.array([at]), np.array([end])))
                    at = end
                    continue
                end = cut + 1
            b = np.frombuffer(raw, np.uint8, end - at, at)
            edge = np.diff(np.concatenate(([True], _IS_GAP[b], [True])).astype(np.int8))
            start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_LOWER[b] * self.up[: len(b)], out=total[1:])
            hard = np.cumsum(_IS_HARD[b])
            out.append(((total[stop] - total[start]) * self.down[start] + (stop - start).astype(np.uint64), hard[start] + piece, start + at, stop + at))
            piece += int(hard[-1])
            at = end
        if not out:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Language, bytes, and words of some texts of that language at a time, with a hard mark between texts. Columns: text, lang."""
        for batch in slices(batches):
            by: dict[str, list[bytes]] = {}
            for raw, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw:
                    by.setdefault(lang, []).append(raw)
            for lang, texts in by.items():
                salt, group, size = self.language(lang), [], 0
                for i, raw in enumerate(texts):
                    group.append(raw)
                    size += len(raw)
                    if size >= STEP or i + 1 == len(texts):
                        joined = b"\n".join(group)
                        h, piece, start, stop = self.of(joined)
                        if len(h):
                            h = mix(h ^ salt)
                            yield lang, joined, np.where(h == 0, np.uint64(1), h), piece, start, stop  # 0 is a blank
                        group, size = [], 0


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """hash, lang, word, f, clash (whether two words have this hash). Columns of texts: text as binary, lang."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, held, size = Words(seed), {}, 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h = np.concatenate([p[1] for p in parts])
                u, first, f = np.unique(h, return_index=True, return_counts=True)
                ends = np.cumsum([len(p[1]) for p in parts])
                part = np.searchsorted(ends, first, side="right")
                word = []
                for p, i in zip(part.tolist(), (first - np.concatenate(([0], ends))[part]).tolist(), strict=True):
                    raw, _, start, stop = parts[p]
                    word.append(raw[start[i] : stop[i]].lower())
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array([lang] * len(u), pa.string()), pa.array(word, pa.binary()), pa.array(f)], ["hash", "lang", "word", "f"])
            held.clear()

        for lang, raw, h, _, start, stop in by.texts(batches):
            held.setdefault(lang, []).append((raw, h, start, stop))
            size += len(h)
            if size >= HELD:
                yield from sent()
                size = 0
        yield from sent()
        release()

    counted = texts.mapInArrow(task, "hash long, lang string, word binary, f long")
    one = F.struct("lang", F.col("word").cast("string").alias("word"))
    both = counted.repartition("hash").groupBy("hash").agg(F.sum("f").alias("f"), F.min(one).alias("a"), F.max(one).alias("b"))
    return both.select("hash", "a.lang", "a.word", "f", (F.col("a") != F.col("b")).alias("clash"))


def _differ(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row begins that is not the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _key(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), 0x51ED27, np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + c)
    return h


def fragments(h: np.ndarray, piece: np.ndarray, f: np.ndarray, least: int, hot: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pivot and the words at -2, -1, 1, 2 (0: blank); bits of the phrases to count; what routes each fragment."""
    n, alive = len(h), f >= least

    def near(d: int) -> np.ndarray:
        """Whether the word d places on may stand in a phrase with this one as pivot."""
        ok = np.zeros(n, bool)
        if abs(d) < n:
            here, there = (slice(0, n - d), slice(d, n)) if d > 0 else (slice(-d, n), slice(0, n + d))
            more = (f[there] > f[here]) | (f[there] == f[here]) & (h[there] > h[here])
            if d > 0:
                more |= h[there] == h[here]
            ok[here] = more & alive[here] & alive[there] & (piece[here] == piece[there])
        return ok

    left, right = near(-1), near(1)
    left2, right2 = left & near(-2), right & near(2)
    bits = (left | right << 1 | left2 << 2 | (left & right) << 3 | right2 << 4).astype(np.uint8) if n else np.zeros(0, np.uint8)
    at = np.flatnonzero(bits)
    padded = np.concatenate((np.zeros(2, np.uint64), h, np.zeros(2, np.uint64)))
    blank = np.uint64(0)
    columns = [h[at]] + [np.where(ok[at], padded[at + 2 + d], blank) for d, ok in ((-2, left2), (-1, left), (1, right), (2, right2))]
    bits, busy = bits[at], f[at] > hot
    parts = [([c[~busy] for c in columns], bits[~busy], mix(columns[0][~busy] + np.uint64(0x5851F42D4C957F2D)))]
    for k, used in enumerate(PHRASES):  # of hot pivots each phrase by itself
        of = busy & (bits >> k & 1).astype(bool)
        own = [c[of] if i in used else np.zeros(int(of.sum()), np.uint64) for i, c in enumerate(columns)]
        parts.append((own, np.full(len(own[0]), 1 << k, np.uint8), _key([own[i] for i in used])))
    return [np.concatenate([p[0][i] for p in parts]) for i in range(5)], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _shards(route: np.ndarray, shards: int) -> np.ndarray:
    """Ascends with the route."""
    return ((route >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack(columns: list[np.ndarray], bits: np.ndarray, count: np.ndarray) -> bytes:
    """A block of fragments: its words once, then their places in it, column by column."""
    known, place = np.unique(np.concatenate(columns), return_inverse=True)
    kind = "<u2" if len(known) <= 1 << 16 else "<u4"
    head = np.array([len(bits), len(known)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + known.astype("<u8").tobytes() + place.astype(kind).tobytes() + bits.tobytes() + count.astype("<u4").tobytes())


def unpack(block: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    kind, at = ("<u2" if m <= 1 << 16 else "<u4"), 8 + 8 * m
    known = np.frombuffer(raw, "<u8", m, 8)
    place = np.frombuffer(raw, kind, 5 * n, at)
    at += place.nbytes
    return [known[place[i * n : (i + 1) * n]] for i in range(5)], np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, "<u4", n, at + n)


def mine(blocks: list[bytes], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words (0: none) and counts of the phrases of a partition that occur at least this often."""
    parts = [unpack(b) for b in blocks]
    columns, bits = [np.concatenate([p[0][i] for p in parts]) for i in range(5)], np.concatenate([p[1] for p in parts])
    count = np.concatenate([p[2] for p in parts]).astype(np.int64)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for k, used in enumerate(PHRASES):
        has = (bits >> k & 1).astype(bool)
        words = [columns[i][has] for i in used] + [np.zeros(int(has.sum()), np.uint64)] * (3 - len(used))
        for to, x in zip(found, [*words, count[has]], strict=True):
            to.append(x)
    *words, count = (np.concatenate(x) for x in found)
    key = _key(words)
    order = np.argsort(key, kind="stable")
    words, key, count = [w[order] for w in words], key[order], count[order]
    new = _differ(words)
    if (new[1:] & (key[1:] == key[:-1])).any():  # two phrases of one key
        order = np.lexsort(words)
        words, count = [w[order] for w in words], count[order]
        new = _differ(words)
    at = np.flatnonzero(new)
    f = np.add.reduceat(count, at) if len(at) else count
    return [w[at][f >= least] for w in words], f[f >= least]


def mined(texts: DataFrame, greatest, seed: int, shards: int, least: int, hot: int) -> DataFrame:
    """w1, w2, w3 (0: none), f of each phrase of ``least`` occurrences or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = Words(seed), greatest.value
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            columns = [np.concatenate([p[0][i] for p in held]) for i in range(5)]
            bits, route = np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
            order = np.lexsort((_key(columns), route))
            columns, bits, route = [c[order] for c in columns], bits[order], route[order]
            at = np.flatnonzero(_differ([*columns, bits]))
            count = np.diff(np.append(at, len(bits)))
            columns, bits, shard = [c[at] for c in columns], bits[at], _shards(route[at], shards)
            edges = [*np.flatnonzero(_differ([shard])).tolist(), len(shard)]
            blocks = [pack([c[s:e] for c in columns], bits[s:e], count[s:e]) for s, e in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]]), pa.array(blocks, pa.binary())], ["shard", "block"])

        for _, _, h, piece, _, _ in by.texts(batches):
            f = known[(h & np.uint64(len(known) - 1)).astype(np.int64)]
            held.append(fragments(h, piece, f, least, hot))
            size += len(held[-1][1])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()
        release()

    def local(part: pd.DataFrame) -> pd.DataFrame:
        words, f = mine(list(part["block"]), least)
        return pd.DataFrame({f"w{i}": w.view(np.int64) for i, w in enumerate(words, 1)} | {"f": f})

    return texts.mapInArrow(send, "shard long, block binary").groupBy("shard").applyInPandas(local, "w1 long, w2 long, w3 long, f long")


def _score(a: str, left: str, right: str, unit: int):
    """Decimals, as products may pass 64 bits."""
    exact = {x: f"CAST({x} AS DECIMAL(19, 0))" for x in (a, left, right)}
    return F.expr(f"CAST({unit} AS DECIMAL(7, 0)) * {exact[a]} * {exact[a]} div ({exact[left]} * {exact[right]})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 10, share: int = 50, unit: int = 1_000_000, top: int | None = 2000, class_bits: int = 20, shard_words: int = 1 << 20, hot: int = 1 << 18, salts: int = 64, seeds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; ``top`` of each language, or all."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    for seed in seeds:
        words = scratch.save(word_counts(texts, seed))
        total, clash = words.agg(F.sum("f"), F.max("clash")).first()
        if not clash:
            break
        scratch.drop(words)
    else:
        raise ValueError("two words share a hash, whatever the seed")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least).select("hash", "lang", "word", "f")
    classes = words.groupBy(F.col("hash").bitwiseAND((1 << class_bits) - 1).alias("class")).agg(F.max("f").alias("f")).toArrow()  # 2**class_bits rows at most
    greatest = np.zeros(1 << class_bits, np.int64)
    greatest[classes.column("class").to_numpy()] = classes.column("f").to_numpy()
    shards = max(1, -(-(total or 0) // shard_words))
    found = scratch.save(mined(texts, spark.sparkContext.broadcast(greatest), seed, shards, least, hot))

    two, three = found.filter("w3 = 0").select("w1", "w2", "f"), found.filter("w3 <> 0")
    word = words.select(F.col("hash").alias("h"), "lang", "word", F.col("f").alias("fw"))

    def named(df: DataFrame, i: int) -> DataFrame:
        kind = word.select(F.col("h").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("fw").alias(f"f{i}"), *(["lang"] if i == 1 else []))
        return df.join(kind, f"w{i}")

    longer = three.select("w1", "w2", "f").union(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
    longer = longer.groupBy("w1", "w2").agg(F.max("f").alias("longest"))
    pairs = two.join(longer, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longest") < share * F.col("f"), F.lit(True)))
    pairs = named(named(pairs, 1), 2).select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    pairs = pairs.withColumn("score", _score("a", "l", "r", unit))
    head = two.select("w1", "w2", F.col("f").alias("f12"))
    tail = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"))
    triples = named(named(named(three.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]), 1), 2), 3)
    triples = triples.withColumn("s1", _score("f", "f1", "f23", unit)).withColumn("s2", _score("f", "f12", "f3", unit))
    late = F.col("s2") < F.col("s1")
    triples = triples.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"), F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    out = pairs.union(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # a language may have most phrases: first the best of each of its parts
        out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        rank = F.col("rank").cast("long")
    else:
        rank = F.lit(None).cast("long")
    return out.join(sizes, "lang").select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_pivot_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, 1 AS k, w[i] AS x, NULL AS y, NULL AS z FROM i
  UNION ALL SELECT lang, 2, w[i], w[i + 1], NULL FROM i WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i], w[i + 1], w[i + 2] FROM i WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, x, y, z, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
u AS (SELECT lang, x, f FROM f WHERE k = 1),
b AS (SELECT lang, x, y, f FROM f WHERE k = 2 AND f >= 10),
c AS (SELECT lang, x, y, z, f FROM f WHERE k = 3 AND f >= 10),
o AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM c UNION ALL SELECT lang, y, z, f FROM c) GROUP BY ALL),
s AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * b.f * b.f) // (l.f::HUGEINT * r.f) AS score
  FROM b JOIN u l ON l.lang = b.lang AND l.x = b.x JOIN u r ON r.lang = b.lang AND r.x = b.y LEFT JOIN o ON o.lang = b.lang AND o.x = b.x AND o.y = b.y
  WHERE o.f IS NULL OR 100 * o.f < 50 * b.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2)
  FROM (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, u1.f AS l1, b1.f AS r1, b2.f AS l2, u2.f AS r2,
      (1000000::HUGEINT * c.f * c.f) // (u1.f::HUGEINT * b1.f) AS s1, (1000000::HUGEINT * c.f * c.f) // (b2.f::HUGEINT * u2.f) AS s2
    FROM c JOIN u u1 ON u1.lang = c.lang AND u1.x = c.x JOIN b b1 ON b1.lang = c.lang AND b1.x = c.y AND b1.y = c.z
    JOIN b b2 ON b2.lang = c.lang AND b2.x = c.x AND b2.y = c.y JOIN u u2 ON u2.lang = c.lang AND u2.x = c.z)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT k.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""
