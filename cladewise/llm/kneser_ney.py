"""Quality of texts by an interpolated modified Kneser-Ney bigram model of trusted text.

Words are hashed to ``2**vocab_bits`` classes. Trusted text is that of all
labelled documents of quality 1 that are not toxic; by a hash of the id three
quarters of them train, all that there are, and the others set the thresholds,
so these come from text that the model has not seen.

What ids are trusted stays a table. A Bloom filter of them, of a fixed size,
tells where texts are read which can be trusted; the words of these are joined
with the table by id, so only trusted ones count.

Counts of pairs are merged by shard, a hash of the pair, so that a frequent
first word makes no shard larger than others; there are as many shards as the
words ask for. Discounts D1, D2 and D3+ follow
from the counts of counts; the lower order holds continuation counts with
discounts of its own, down to a uniform distribution. Documents that train are
scored by the same model and so vouch for themselves; they are trusted anyway.

Statistics of single words are arrays of ``2**vocab_bits`` entries, and
``2**filter_bits`` bits tell which pairs may be known (a Bloom filter, a
segment for each shard): sizes that are fixed, and these are broadcast. Pairs
and their counts stay in shards.

Scoring reads each text once. What single words give is summed where the text
is read; the pairs that can be known go to their shards in compressed blocks,
repeated pairs of a document as one, a sharded join of the documents' pairs
with the counts. They come back as one sum for each document, shard and block.
A shard's blocks are dealt over as many tasks as their number asks for. Logs
are fixed-point numbers, so sums do not depend on an order and reruns agree.

A document is kept if its perplexity is at most the ``quantile`` of trusted
held-out text of its language, raised by the factor ``margin`` and, as the mean
over few words scatters more, by ``exp(spread / sqrt(words))``.

Defined results: a null or empty text, or one without words, has no perplexity
and is not kept; null is a language like others; a language with fewer than
``least_docs`` held-out documents uses all languages' threshold; rows of one id
are scored together and share the result, as do rows without id; with no
trusted text at all there is no model and every text with words is kept; an
empty table gives no rows; columns of other names are kept by ``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import forget_tokenizers, slices
from .scratch import Scratch
from .wordhash import mix, word_hashes

#: Pairs that a task holds before it sends them.
BLOCK = 1 << 20
#: Logs are multiples of 1 / ONE.
ONE = 1 << 20
#: Words of a shard that one task answers.
PER_DEAL = 16_000_000
#: Words of all documents for which there is one shard, and the fewest and most shards.
PER_SHARD, SHARDS = 8_000_000, (16, 1 << 15)
#: Log perplexities are counted in bins of 1 / BINS before those of a quantile's bin are put in order.
BINS = 1024
#: Stands for a null id between the steps.
NO_ID = -(1 << 63)


def word_classes(text: list, bits: int) -> Iterator[np.ndarray]:
    """Classes of the words of each text, 1 and up; 0 is the start of a text."""
    for _, group in word_hashes(text):
        for words in group:
            yield np.concatenate((np.zeros(1, np.int64), 1 + (words >> np.uint64(64 - bits)).astype(np.int64) % ((1 << bits) - 1)))


def _pair(classes: np.ndarray, bits: int) -> np.ndarray:
    return (classes[:-1] << bits) | classes[1:]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.uint16)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard of the keys with their places, in the order they have."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(keys) else ():
        yield int(shard[at[0]]), at


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def _unpack(b: bytes, kind: str) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack_steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers differ by little, and small numbers pack well."""
    return _pack(np.diff(ascending, prepend=0))


def _unpack_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<i8"))


def discounts(often: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts of 0, 1, 2 and 3 or more, within 10 and 95 % of the count. often: how many counts are 1, 2, 3 and 4."""
    n = np.maximum(often, 1.0)
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1 * i), 0.95 * i) for i, x in enumerate(d, 1))])


def _sum_up(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights, len(u)).astype(np.int64)


def _record(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)


def trusted_ids(labels: DataFrame, seed: int) -> DataFrame:
    """doc_id and held (sets thresholds; the others train): all documents of which every label is good and none toxic."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("doc_id is not null and q = 1 and coalesce(t, 0) = 0")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(held=mix(pdf["doc_id"].to_numpy(np.int64).astype(np.uint64) + np.uint64(seed)) % np.uint64(4) == 0)

    return good.select("doc_id").mapInPandas(split, "doc_id long, held boolean")


def id_filter(ids: DataFrame, filter_bits: int, shards: int = 64) -> PairFilter:
    """The filter of the column doc_id, of 2**filter_bits bits."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.sort(pdf["doc_id"].to_numpy(np.int64))
            yield pd.DataFrame([(s, _pack_steps(keys[at])) for s, at in _by_shard(keys, shards)], columns=["shard", "keys"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([_unpack_steps(x) for x in pdf["keys"]]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "keys": [_pack_steps(keys)]})

    return known_pairs(ids.select("doc_id").mapInPandas(parts, "shard int, keys binary").groupBy("shard").applyInPandas(merge, "shard int, keys binary"), filter_bits, shards)


def words_of(docs: DataFrame, ids: DataFrame, bits: int, filter_bits: int) -> DataFrame:
    """doc_id and classes, packed, of the documents whose id is in ids. Texts that the filter of ids keeps back are not shuffled; over BLOCK words go in parts."""
    shards = 64
    may = docs.sparkSession.sparkContext.broadcast(id_filter(ids, filter_bits, shards))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        for batch in slices(batches):
            own = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(may.value.may_have(own, _shard(own, shards))))
            rows = [(i, _pack(c[at : at + BLOCK + 1].astype(np.uint32))) for i, c in zip(batch.column(0).to_pylist(), word_classes(batch.column(1).to_pylist(), bits), strict=True) for at in range(0, len(c) - 1, BLOCK)]
            yield _record(["doc_id", "classes"], [pa.int64(), pa.binary()], rows)

    found = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(task, "doc_id long, classes binary")
    return found.join(ids.select("doc_id").hint("merge"), "doc_id")  # ids grow with the labels, so they are not broadcast


def count_pairs(words: DataFrame, bits: int, shards: int) -> DataFrame:
    """(shard, keys, counts): pairs of all rows, summed within blocks. words: classes, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = _sum_up(np.concatenate(held))
            rows = [(s, _pack_steps(keys[at]), _pack(n[at].astype(np.int32))) for s, at in _by_shard(keys, shards)]
            return _record(["shard", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()], rows)

        for batch in slices(batches):
            for packed in batch.column(0).to_pylist():
                held.append(_pair(_unpack(packed, "<u4").astype(np.int64), bits))
                size += len(held[-1])
                if size > BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return words.select("classes").mapInArrow(task, "shard int, keys binary, counts binary")


def merge_counts(parts: DataFrame) -> DataFrame:
    """One row for each shard: its pairs, ascending, and their counts."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _sum_up(np.concatenate([_unpack_steps(x) for x in pdf["keys"]]), np.concatenate([_unpack(x, "<i4") for x in pdf["counts"]]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "keys": [_pack_steps(keys)], "counts": [_pack(n.astype(np.int32))]})

    return parts.groupBy("shard").applyInPandas(merge, "shard int, keys binary, counts binary")


def _statistics(merged: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """Arrays by word class: total, n1, n2, n3 (followers seen once, twice, more often) and before (distinct words before it); and counts of counts.

    Each task sums those of its shards in arrays of 2**bits entries and sends them in ranges, which are summed by range.
    """
    span = 1 << max(0, bits - 4)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((5, 1 << bits), np.int64)
        for pdf in batches:
            for k, c in zip(pdf["keys"], pdf["counts"], strict=True):
                keys, n = _unpack_steps(k), _unpack(c, "<i4").astype(np.int64)
                v, start = np.unique(keys >> bits, return_index=True)  # keys ascend
                w, before = np.unique(keys & ((1 << bits) - 1), return_counts=True)
                out[:4, v] += [np.add.reduceat(x, start) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
                out[4, w] += before
        if out.any():
            for part in range((1 << bits) // span):
                yield pd.DataFrame({"part": [part], "sums": [_pack(out[:, part * span : (part + 1) * span].ravel())]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = sum(_unpack(x, "<i8") for x in pdf["sums"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "sums": [_pack(out)]})

    def counts_of_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["counts"]:
                n = _unpack(c, "<i4")
                yield pd.DataFrame({"i": [1, 2, 3, 4], "n": [int((n == i).sum()) for i in (1, 2, 3, 4)]})

    rows = merged.mapInPandas(own, "part int, sums binary").groupBy("part").applyInPandas(total, "part int, sums binary").orderBy("part").collect()  # 5 * 2**bits numbers
    table = np.concatenate([_unpack(bytes(r["sums"]), "<i8").reshape(5, -1) for r in rows], axis=1)
    often = {r["i"]: r["s"] for r in merged.mapInPandas(counts_of_counts, "i int, n long").groupBy("i").agg(F.sum("n").alias("s")).collect()}
    return *table, np.array([often.get(i, 0) for i in (1, 2, 3, 4)], float)


def lower_order(before: np.ndarray, vocabulary: int) -> np.ndarray:
    """Continuation probability of every word class."""
    total = before.sum()
    d = discounts(np.array([(before == i).sum() for i in (1, 2, 3, 4)], float))
    n = np.minimum(before, 3)
    left = d[n].sum() / total
    return np.maximum(before - d[n], 0) / total + left / vocabulary


class Model:
    """The fixed-size part: logs of the lower order and of the back-off weights, totals and discounts."""

    def __init__(self, bits: int, total, n1, n2, n3, before, discount) -> None:
        self.bits, self.discount, self.total = bits, discount, total.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, (discount[1] * n1 + discount[2] * n2 + discount[3] * n3) / np.maximum(total, 1), 1.0)
        self.lower, self.back = np.log(lower_order(before, 1 << bits)).astype(np.float32), np.log(np.maximum(back, 1e-9)).astype(np.float32)

    def base(self, classes: np.ndarray) -> np.ndarray:
        """Log probability of each word but the first if its pair is unknown."""
        return np.rint((self.back[classes[:-1]].astype(np.float64) + self.lower[classes[1:]]) * ONE).astype(np.int64)

    def gains(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What known pairs add to the log probability."""
        v, w = keys >> self.bits, keys & ((1 << self.bits) - 1)
        low = self.back[v].astype(np.float64) + self.lower[w]
        p = (n - self.discount[np.minimum(n, 3)]) / self.total[v] + np.exp(low)
        return np.rint(np.log(p) * ONE).astype(np.int64) - np.rint(low * ONE).astype(np.int64)


class PairFilter:
    """A Bloom filter of pairs with two hashes; each shard's pairs have a segment of their own."""

    def __init__(self, bits: int, shards: int) -> None:
        self.span = 1 << max(3, bits - (shards - 1).bit_length())
        self.flags = np.zeros(shards * self.span // 8, np.uint8)

    def places(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, start = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), shard.astype(np.int64) * self.span
        return start + (h & np.uint64(self.span - 1)).astype(np.int64), start + ((h >> np.uint64(32)) & np.uint64(self.span - 1)).astype(np.int64)

    def segment(self, keys: np.ndarray) -> bytes:
        """The packed segment of one shard's pairs."""
        flags = np.zeros(self.span, bool)
        for at in self.places(keys, np.zeros(1, np.int64)):
            flags[at] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def put(self, shard: int, segment: bytes) -> None:
        self.flags[shard * self.span // 8 : (shard + 1) * self.span // 8] = np.frombuffer(segment, np.uint8)

    def may_have(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        a, b = ((self.flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in self.places(keys, shard))
        return (a & b).astype(bool)


def known_pairs(merged: DataFrame, filter_bits: int, shards: int) -> PairFilter:
    """The filter of the merged counts: 2**filter_bits bits come to the driver, a shard at a time."""
    out = PairFilter(filter_bits, shards)
    empty = PairFilter(filter_bits, shards)
    empty.flags = empty.flags[:0]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, k in zip(pdf["shard"], pdf["keys"], strict=True):
                yield pd.DataFrame({"shard": [s], "segment": [empty.segment(_unpack_steps(k))]})

    for r in merged.mapInPandas(segments, "shard int, segment binary").toLocalIterator():
        out.put(r["shard"], bytes(r["segment"]))
    return out


def _requests(keys: np.ndarray, owner: np.ndarray, shards: int) -> dict[int, tuple[bytes, ...]]:
    """For each shard the pairs asked for: ascending keys as steps, owners of each, steps of owners, and how often each owner has the pair."""
    both, times = np.unique((keys.astype(np.uint64) << np.uint64(20)) | owner.astype(np.uint64), return_counts=True)
    keys, owner = (both >> np.uint64(20)).astype(np.int64), (both & np.uint64((1 << 20) - 1)).astype(np.int64)
    out = {}
    for s, at in _by_shard(keys, shards):
        k, o, t = keys[at], owner[at], times[at]
        fresh = np.concatenate(([True], k[1:] != k[:-1]))
        step = np.diff(o, prepend=0)
        step[fresh] = o[fresh]
        owners = np.diff(np.append(np.flatnonzero(fresh), len(k)))
        out[s] = _pack_steps(k[fresh]), _pack(owners.astype(np.uint32)), _pack(step.astype(np.uint32)), _pack(t.astype(np.uint32))
    return out


def _answers(keys: np.ndarray, gain: np.ndarray, n: int, steps: bytes, owners: bytes, owner_steps: bytes, times: bytes) -> np.ndarray:
    """Sums for the n documents of one block of requests."""
    asked, owners = _unpack_steps(steps), _unpack(owners, "<u4")
    if not len(asked) or not len(keys):
        return np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    got = np.repeat(np.where(keys[at] == asked, gain[at], 0), owners) * _unpack(times, "<u4").astype(np.int64)
    # Owners ascend under each key: a running sum, less what it was where the key began.
    run = np.cumsum(_unpack(owner_steps, "<u4").astype(np.int64))
    first = np.cumsum(owners) - owners
    before = np.where(first > 0, run[first - 1], 0)
    out = np.zeros(n, np.int64)
    np.add.at(out, run - np.repeat(before, owners), got)
    return out


REQUESTS = ["shard", "deal", "ids", "steps", "owners", "owner_steps", "times", "words", "base", "langs"]
REQUEST_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.list_(pa.string())]
REQUEST_SCHEMA = "shard int, deal int, ids binary, steps binary, owners binary, owner_steps binary, times binary, words binary, base binary, langs array<string>"


def perplexities(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, vocab_bits: int = 20, filter_bits: int = 27, shards: int | None = None, seed: int = 3) -> DataFrame | None:
    """doc_id, lang, words, log_ppl (mean negative log probability) and role ('train', 'held' or null). docs: doc_id long, text, lang."""
    spark = docs.sparkSession
    some = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # about as many words
    shards = shards or min(max(SHARDS[0], -(-some // PER_SHARD)), SHARDS[1])
    bits, deal = vocab_bits, max(1, -(-some // (shards * PER_DEAL)))
    trusted = scratch.save(trusted_ids(labels, seed))
    merged = scratch.save(merge_counts(count_pairs(words_of(docs, trusted.filter("not held"), bits, filter_bits), bits, shards)))
    if merged.isEmpty():
        return None
    total, n1, n2, n3, before, often = _statistics(merged, vocab_bits)
    model = spark.sparkContext.broadcast(Model(vocab_bits, total, n1, n2, n3, before, discounts(often)))
    shared = spark.sparkContext.broadcast(known_pairs(merged, filter_bits, shards))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        m, known = model.value, shared.value
        part, number = TaskContext.get().partitionId(), 0
        docs_, keys, owner, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            asked = _requests(np.concatenate(keys), np.concatenate(owner), shards) if keys else {}
            ids, words, base, langs = zip(*docs_, strict=True)
            packed = _pack_steps(np.array(ids, np.int64))
            about = _pack(np.array(words, np.int64)), _pack(np.array(base, np.int64)), langs
            home = (part + number) % shards  # one row of each block tells what is known of its documents
            asked.setdefault(home, (b"",) * 4)
            to = (part + number // shards) % deal
            return _record(REQUESTS, REQUEST_TYPES, [(s, to, packed, *x, *(about if s == home else (None,) * 3)) for s, x in asked.items()])

        for batch in slices(batches):
            for i, c, lang in zip(batch.column(0).to_pylist(), word_classes(batch.column(1).to_pylist(), bits), batch.column(2).to_pylist(), strict=True):
                # A text of over BLOCK words goes in parts; each is a row of the same id.
                for at in range(0, max(1, len(c) - 1), BLOCK):
                    own = c[at : at + BLOCK + 1]
                    k = _pair(own, bits)
                    k = k[known.may_have(k, _shard(k, shards))]
                    if len(k):
                        keys.append(k)
                        owner.append(np.full(len(k), len(docs_)))
                    docs_.append((NO_ID if i is None else i, len(own) - 1, int(m.base(own).sum()), lang))
                    size += len(k) + 1
                    if size > BLOCK >> 1:
                        yield flush()
                        number += 1
                        docs_, keys, owner, size = [], [], [], 0
        if docs_:
            yield flush()

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m = model.value
        keys, gain = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(right):
            keys = _unpack_steps(right["keys"].iloc[0])
            gain = m.gains(keys, _unpack(right["counts"].iloc[0], "<i4").astype(np.int64))
        out = {k: [] for k in ("doc_id", "lang", "words", "score")}
        for r in left.itertuples():
            ids = _unpack_steps(r.ids)
            sums = _answers(keys, gain, len(ids), r.steps, r.owners, r.owner_steps, r.times)
            home = r.langs is not None
            some = slice(None) if home else sums != 0
            n = len(ids[some])
            out["doc_id"].append(ids[some])
            out["lang"].append(np.array(r.langs, object) if home else np.full(n, None))
            out["words"].append(_unpack(r.words, "<i8") if home else np.zeros(n, np.int64))
            out["score"].append(sums + _unpack(r.base, "<i8") if home else sums[some])
        if not len(left):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "lang": pd.Series([], dtype=object), "words": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    asked = docs.select("doc_id", "text", "lang").mapInArrow(score, REQUEST_SCHEMA)
    dealt = merged.select("shard", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("deal"))
    sums = asked.groupBy("shard", "deal").cogroup(dealt.groupBy("shard", "deal")).applyInPandas(answer, "doc_id long, lang string, words long, score long")
    each = sums.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.sum("words").alias("words"), F.sum("score").alias("score"))
    role = F.when(F.col("held"), "held").when(~F.col("held"), "train").alias("role")
    return each.join(trusted, "doc_id", "left").select("doc_id", "lang", "words", F.when(F.col("words") > 0, -F.col("score") / F.lit(float(ONE)) / F.col("words")).alias("log_ppl"), role)


def quantile_of(values: DataFrame, by: str, value: str, quantile: float) -> DataFrame:
    """by, cut (the interpolated quantile, as F.percentile gives it) and n, for any number of values: they are counted in bins, and only those of the bins that the quantile lies in are put in order."""
    each = values.groupBy(by, F.floor(F.col(value) * BINS).alias("bin"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    bins = each.groupBy(by, "bin").agg(F.sum("k").alias("k"))
    group = Window.partitionBy(by)
    bins = bins.withColumn("upto", F.sum("k").over(group.orderBy("bin"))).withColumn("n", F.sum("k").over(group)).withColumn("at", (F.col("n") - 1) * F.lit(quantile))
    hit = bins.filter((F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("k") <= F.ceil("at"))).select(F.col(by).alias("_by"), F.col("bin").alias("_bin"), (F.col("upto") - F.col("k")).alias("base"), "n", "at")
    upto = F.col("base") + F.sum("k").over(Window.partitionBy(by, "bin").orderBy("v"))
    inside = each.join(hit, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bin") == F.col("_bin"))).withColumn("upto", upto)
    has = lambda place: F.max(F.when((F.col("upto") - F.col("k") <= place) & (F.col("upto") > place), F.col("v")))
    ends = inside.groupBy(by).agg(has(F.floor("at")).alias("a"), has(F.ceil("at")).alias("b"), F.first("at").alias("at"), F.first("n").alias("n"))
    between = (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    return ends.select(by, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("cut"), "n")


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.99, margin: float = 1.5, spread: float = 3.0, least_docs: int = 50, **options) -> DataFrame:
    """doc_id, lang, words, perplexity, threshold, keep: a row for each id."""
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = perplexities(docs, labels, scratch, **options)
    if scored is None:
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        none = F.lit(None).cast("double")
        return docs.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.lit(None).cast("long").alias("words"), none.alias("perplexity"), none.alias("threshold"), F.max(words).alias("keep"))
    scored = scratch.save(scored)
    held = scored.filter("role = 'held' and log_ppl is not null")
    by = scratch.save(quantile_of(held, "lang", "log_ppl", quantile).filter(F.col("n") >= least_docs).select(F.col("lang").alias("_lang"), "cut"))
    every = next((r["cut"] for r in quantile_of(held.withColumn("every", F.lit(0)), "every", "log_ppl", quantile).collect()), None)
    limit = F.coalesce(F.col("cut"), F.lit(every).cast("double")) + F.log(F.lit(float(margin))) + F.lit(spread) / F.sqrt(F.greatest("words", F.lit(1)))
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("limit", limit)
    keep = F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= F.col("limit"), F.lit(True))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "lang", "words", F.exp("log_ppl").alias("perplexity"), F.exp("limit").alias("threshold"), keep.alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is kept."""
    scratch = Scratch(docs.sparkSession, "kept")
    gone = scratch.save(classify(docs, labels, **options).filter("not keep").select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op3_kneser_ney_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
