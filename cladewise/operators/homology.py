"""Search of sequences by seeds on both strands, with ungapped extension and significance.

1. An index holds the seeds of all records: words of k bases at every
   ``stride``-th place, as numbers of two bits a base. Words with other letters
   and words that repeat one, two or three bases are no seeds. k grows with the
   database, so that a word of a query meets 1/16 of a record by chance. The
   index is written once, dealt out and sorted by seed, and serves any number
   of searches.
2. A query and its reverse complement look up the words at all their places.
   Seeds of one query, strand, record and diagonal become islands, new ones
   where more than ``gap`` places lie between.
3. Each island is extended without gaps to both sides, until the score has
   fallen by more than ``drop`` below the best. Only the part of a record that a
   query can cover is read.
4. Scores become bits and E-values by the constants of Karlin and Altschul for
   the scoring; a record's best segment is its hit.

All hits up to an E-value are found, not the first few; nothing is capped. A
seed that very many records share is a key that AQE splits. Where an option
``common`` is given, seeds of more records are left out of the lookup, as in
usual searches; without it none is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions import sequence as S
from cladewise.operators.lineage_cut import cut, new_path

_TWO_BITS = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _TWO_BITS[ord(_c)] = _TWO_BITS[ord(_c.lower())] = _i
LEAST_K, MOST_K = 11, 31


@dataclass(frozen=True)
class Scoring:
    """Ungapped scores; lam and kappa: fixed values of Karlin and Altschul for match 1, mismatch -2 and even bases."""

    match: int = 1
    mismatch: int = -2
    drop: int = 20
    gap: int = 40
    lam: float = 1.33271
    kappa: float = 0.620991

    def bits(self, raw: Column) -> Column:
        return (F.lit(self.lam) * raw - F.lit(log(self.kappa))) / F.lit(log(2.0))

    def evalue(self, raw: Column, m: Column, n: Column) -> Column:
        return F.lit(self.kappa) * m * n * F.exp(F.lit(-self.lam) * raw)


def word_size(bases: int) -> int:
    """The least k, from 11 to 31, of which there are 16 times as many words as bases."""
    return next((k for k in range(LEAST_K, MOST_K) if 4**k >= 16 * bases), MOST_K)


def seeds_of(seq: str, k: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0, multiples of the stride) and numbers of a sequence's seeds."""
    codes = _TWO_BITS[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(0, n, stride)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    good = bad[at + k] == bad[at]
    for period in (1, 2, 3):  # words that repeat so few bases say little
        same = np.concatenate(([0], np.cumsum(codes[period:] == codes[:-period])))
        good &= same[at + k - period] - same[at] < k - period
    at = at[good]
    word = np.zeros(len(at), np.int64)
    for i in range(k):
        word = word << 2 | codes[at + i]
    return at, word


def _seed_rows(df: DataFrame, k: int, stride: int, *keys: str) -> DataFrame:
    """keys, at, seed. df: keys, seq."""
    n = len(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [seeds_of(s or "", k, stride) for s in part.column(n).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(a) for a, _ in found]))
                at, seed = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(n)), pa.array(at.astype(np.int32)), pa.array(seed)], [*keys, "at", "seed"])

    kinds = dict(df.dtypes)
    return df.select(*keys, "seq").mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", at int, seed long")


@dataclass(frozen=True)
class SeedIndex:
    """A written index: path/seeds (seed, id, at) and path/records (id, seq, and other columns)."""

    path: str
    k: int
    stride: int
    bases: int

    def seeds(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/seeds")

    def records(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")


def build_index(records: DataFrame, path: str | None = None, *, k: int | None = None, stride: int = 4) -> SeedIndex:
    """records: id, seq and others, which are kept."""
    spark = records.sparkSession
    path = path or new_path(spark, "seed-index")
    records.write.parquet(f"{path}/records")
    held = spark.read.parquet(f"{path}/records")
    bases = held.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
    k = k or word_size(bases)
    _seed_rows(held, k, stride, "id").repartition("seed").sortWithinPartitions("seed", "id", "at").select("seed", "id", "at").write.parquet(f"{path}/seeds")
    return SeedIndex(path, k, stride, bases)


#: Cells of a table of scores beside islands, and letters of rows, that are looked at together.
CELLS = 1 << 20


def extend(query: str, part: str, offset: int, places: list[int], k: int, s: Scoring) -> list[tuple[int, int, int]]:
    """Segments (start in the query, length, score) of one diagonal. part: the record's letters beside the query's from ``offset`` on; places: where seeds begin in the query."""
    return extend_all([(query, part, offset, places)], k, s)[0]


def extend_all(rows: list[tuple], k: int, s: Scoring) -> list[list[tuple[int, int, int]]]:
    """The segments of each row of query, part, offset and places, as ``extend`` has them."""
    out, group, size = [], [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size > CELLS:
            out += _extend_group(group, k, s)
            group, size = [], 0
    return out + (_extend_group(group, k, s) if group else [])


def _extend_group(rows: list[tuple], k: int, s: Scoring) -> list[list[tuple[int, int, int]]]:
    a = np.frombuffer("".join(q[o : o + len(p)] for q, p, o, _ in rows).encode("ascii", "replace"), np.uint8)
    b = np.frombuffer("".join(p for _, p, _, _ in rows).encode("ascii", "replace"), np.uint8)
    each = np.where((a == b) & (_TWO_BITS[a] < 4), s.match, s.mismatch).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(each)))
    size, offset = (np.array(x, np.int64) for x in ([len(r[1]) for r in rows], [r[2] for r in rows]))
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    at = np.concatenate([np.asarray(r[3], np.int64) for r in rows]) - offset[row]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.concatenate((np.ones(min(1, len(at)), bool), (np.diff(at) > s.gap) | (np.diff(row) > 0)))
    first = np.flatnonzero(new)
    row, start, end = row[first], at[first], at[np.append(first[1:], len(at)) - 1] + k
    here = base[row]
    score = sums[here + end] - sums[here + start]
    right, r = _sides(each, here + end, 1, size[row] - end, s.drop)
    left, n = _sides(each, here + start - 1, -1, start, s.drop)
    out = [set() for _ in rows]
    for i, x in zip(row.tolist(), zip((start - n + offset[row]).tolist(), (end + r - start + n).tolist(), (score + right + left).tolist(), strict=True), strict=True):
        out[i].add(x)
    return [sorted(x) for x in out]


def _sides(each: np.ndarray, first: np.ndarray, step: int, size: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """For the ``size`` scores from ``first`` on in steps: the best score of a start of these, 0 if none is better, and how many it takes; what lies behind a fall is not looked at."""
    best, taken = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    wide = np.arange(int(size.max(initial=0)))
    rows = max(1, CELLS // max(1, len(wide)))
    for low in range(0, len(first) if len(wide) else 0, rows):
        part = slice(low, low + rows)
        inside = wide < size[part, None]
        run = np.where(inside, each[np.where(inside, first[part, None] + step * wide, 0)], 0).cumsum(axis=1)
        fallen = np.maximum(np.maximum.accumulate(run, axis=1), 0) - run > drop
        run[np.logical_or.accumulate(fallen | ~inside, axis=1)] = 0
        at = run.argmax(axis=1)
        best[part] = np.maximum(run[np.arange(len(run)), at], 0)
        taken[part] = np.where(best[part] > 0, at + 1, 0)
    return best, taken


SEGMENTS = "array<struct<start:int,length:int,raw:int>>"


def segments(queries: DataFrame, index: SeedIndex, scoring: Scoring = Scoring(), *, common: int | None = None) -> DataFrame:
    """query, id, strand, start, length, raw, s_start, m: every extended island. start counts in the query as it is read on that strand. queries: id, seq; where they have ``left_out`` and records have ``names``, records that bear such a name are not looked at."""
    spark = queries.sparkSession
    seq = F.upper(S.ungapped(F.col("seq")))
    strands = queries.select(F.col("id").alias("query"), F.explode(F.array(F.struct(F.lit(1).alias("strand"), seq.alias("seq")), F.struct(F.lit(-1).alias("strand"), S.reverse_complement(seq).alias("seq")))).alias("x")).select("query", "x.*")
    strands = cut(strands)
    known, records = index.seeds(spark), index.records(spark)
    if common is not None:
        often = known.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common).select("seed")
        known = known.join(often, "seed", "left_anti")
    asked = _seed_rows(strands, index.k, 1, "query", "strand").withColumnRenamed("at", "q_at")
    pairs = asked.join(known, "seed")
    diagonals = pairs.groupBy("query", "strand", "id", (F.col("at") - F.col("q_at")).alias("diagonal")).agg(F.collect_list("q_at").alias("places"))  # at most a query's length
    if "left_out" in queries.columns and "names" in records.columns:
        seen = diagonals.select("query", "id").distinct().join(queries.select(F.col("id").alias("query"), "left_out"), "query").join(records.select("id", "names"), "id")
        diagonals = diagonals.join(seen.filter(F.arrays_overlap("names", "left_out")).select("query", "id"), ["query", "id"], "left_anti")
    m = F.length("q_seq")
    beside = records.select("id", F.upper(S.ungapped(F.col("seq"))).alias("r_seq"))
    rows = diagonals.join(strands.withColumnRenamed("seq", "q_seq"), ["query", "strand"]).join(beside, "id")
    # Where the query reaches over the record's start, its letters from ``offset`` on stand beside the record's first.
    offset = F.greatest(F.lit(0), -F.col("diagonal"))
    rows = rows.select("query", "id", "strand", "diagonal", "places", "q_seq", m.alias("m"), offset.alias("offset"), F.substring(F.col("r_seq"), F.greatest(F.col("diagonal"), F.lit(0)) + 1, m - offset).alias("part"))
    k = index.k

    def run(q: pd.Series, part: pd.Series, off: pd.Series, places: pd.Series) -> pd.Series:
        found = extend_all(list(zip(q, part, off, places, strict=True)), k, scoring)
        return pd.Series([[{"start": a, "length": n, "raw": r} for a, n, r in x] for x in found], dtype=object)

    found = rows.withColumn("found", F.pandas_udf(run, SEGMENTS)("q_seq", "part", "offset", "places"))
    return found.select("query", "id", "strand", "m", "diagonal", F.inline("found")).select("query", "id", "strand", "start", "length", "raw", (F.col("start") + F.col("diagonal")).alias("s_start"), "m")


def search(queries: DataFrame, index: SeedIndex, scoring: Scoring = Scoring(), *, most_evalue: float = 10.0, common: int | None = None) -> DataFrame:
    """query, id, ord, raw, score (bits), significance (E-value), q_start, q_len, q_strand, s_start, s_len, s_strand, segments: the best segment of every record, in order of score and id; of equal ones that of the query's own strand, then the first.

    Where strands differ, the record's is the one that is turned.
    """
    kind = segments(queries, index, scoring, common=common)
    e = scoring.evalue(F.col("raw"), F.col("m").cast("double"), F.lit(float(index.bases)))
    good = kind.withColumn("significance", e).filter(F.col("significance") <= most_evalue)
    q_start = F.when(F.col("strand") == 1, F.col("start")).otherwise(F.col("m") - F.col("start") - F.col("length"))
    best = F.min_by(F.struct("raw", "significance", q_start.alias("q_start"), "length", "s_start", "strand"), F.struct(-F.col("raw"), -F.col("strand"), q_start, "s_start"))
    one = good.groupBy("query", "id").agg(best.alias("b"), F.count(F.lit(1)).alias("segments"))
    out = one.select("query", "id", F.col("b.raw").alias("raw"), scoring.bits(F.col("b.raw")).alias("score"), "b.significance", "b.q_start", F.col("b.length").alias("q_len"), F.lit(1).alias("q_strand"), "b.s_start", F.col("b.length").alias("s_len"), F.col("b.strand").alias("s_strand"), "segments")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy(F.col("raw").desc(), "id")))


def windowed(hits: DataFrame, flanks: int = 0) -> DataFrame:
    """Hits with ``seq``, the whole record's, cut to the part that the query may cover and turned to its strand. hits: search results with seq and m, the query's length."""
    w = S.hit_window(F.col("q_start"), F.col("q_len"), F.col("q_strand"), F.col("s_start"), F.col("s_len"), F.col("s_strand"), F.col("m"), flanks, F.length("seq"))
    part = F.substring(F.col("seq"), w["start"] + 1, w["end"] - w["start"])
    return hits.withColumn("seq", S.trim_unknown(F.when(F.col("q_strand") == F.col("s_strand"), part).otherwise(S.reverse_complement(part))))
