"""Whitening of vectors from an exact scatter matrix in residue numbers.

Components become integers, x = floor(scale * c) + shift. With n rows and the
sums S of each dimension, y = n * x - S is x centred, n times, and still whole.

1. One pass gives n, S and the least and greatest x of each dimension, and with
   these a bound of every entry of the scatter matrix A = sum of y y'.
2. Primes below 2**20 are taken until their product exceeds twice that bound. A
   second pass multiplies residues of y, a matrix product for each prime and
   block of rows; residues lie around 0 and blocks are small enough that sums
   stay below 2**53, so products in doubles are exact. What tasks have, one
   matrix for each prime, is summed by Spark.
3. The sums' residues give A by the Chinese remainder theorem, exactly, and
   V = A / n**3 rounds each entry once. Its eigenvectors come from ``eigh``.
4. A third pass projects y / n and divides by the root of the eigenvalue.

The driver sees matrices of the vectors' width only, whatever the rows.

Defined results: rows whose vector is null or holds a null or a component that
is not finite take no part; null ids and repeated rows count as they come; of
vectors of different lengths the shorter end in zeros; components saturate at
2**62; where a component's eigenvalue is 0, as far as doubles tell, its
whitened value is null; deviations beyond 38 digits are null; an empty table,
or one of empty vectors, gives no rows; columns of other names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of one matrix product: residues are below 2**19, so sums stay below 2**51.
BLOCK = 1 << 13
PRIMES_BELOW = 1 << 20
MOST = float(1 << 62)


def primes(product: int) -> list[int]:
    """The greatest primes below 2**20 whose product is above this."""
    found, total, p = [], 1, PRIMES_BELOW - 1
    while total <= product:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            total *= p
        p -= 2
    return found


def whole(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    # A null component makes the test null; NaN is the greatest double.
    good = F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(good, F.lit(False)))


def blocks(batches: Iterator[pa.RecordBatch], width: int | None, scale: float, shift: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, integers and, for each dimension, how many rows have it; width: of all rows, by default of the block's longest."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            raw = part.column(1)
            lengths = np.diff(raw.offsets.to_numpy())
            flat = raw.flatten().to_numpy(zero_copy_only=False)
            d = int(lengths.max(initial=0)) if width is None else width
            if (lengths == d).all():
                c = flat.reshape(len(lengths), d)
            else:
                c = np.zeros((len(lengths), d))
                c[np.arange(d) < lengths[:, None]] = flat
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(c * scale, -MOST, MOST)).astype(np.int64) + shift
            yield part.column(0), x, (np.arange(d) < lengths[:, None]).sum(0)


def _sums(x: np.ndarray) -> list[int]:
    """Sums of columns; 31 bits of each entry at a time, so that no sum passes 64 bits."""
    low, high = (x & 0x7FFFFFFF).sum(0), (x >> 31).sum(0)
    return [(int(h) << 31) + int(s) for s, h in zip(low, high, strict=True)]


def _squares(y: np.ndarray) -> list[int]:
    """Sums of squares of rows, exactly; 24 bits of each entry at a time."""
    if y.dtype == object:
        return [sum(v * v for v in row) for row in y]
    a, b, c = y & 0xFFFFFF, y >> 24 & 0xFFFFFF, y >> 48
    parts = ((a, a, 1, 0), (a, b, 2, 24), (b, b, 1, 48), (a, c, 2, 48), (b, c, 2, 72), (c, c, 1, 96))
    sums = [np.einsum("ij,ij->i", p, q).tolist() for p, q, _, _ in parts]
    return [sum(s * times << by for s, (_, _, times, by) in zip(row, parts, strict=True)) for row in zip(*sums, strict=True)]


@dataclass
class Fit:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    #: A column for each component.
    components: np.ndarray
    #: Of all dimensions.
    trace: float
    small: bool
    scatter: list[list[int]]

    @property
    def live(self) -> np.ndarray:
        """Components with any variance."""
        e = self.eigenvalues
        return e > len(self.sums) * np.finfo(float).eps * max(e.max(initial=0), 0)


def centred(x: np.ndarray, n: int, sums: list[int], small: bool) -> np.ndarray:
    """n * x - S; Python's integers where 64 bits may not do."""
    if small:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def fit(rows: DataFrame, *, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Fit | None:
    """From rows of ``whole``; None without any component."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, count in blocks(batches, None, scale, shift):
            d = x.shape[1]
            sums = [s - (len(x) - int(c)) * shift for s, c in zip(_sums(x), count, strict=True)]  # of rows that have the dimension
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(0, np.int64),) * 2
            columns = [pa.array([-1, *range(d)], pa.int32()), pa.array([len(x), *count.tolist()], pa.int64()), pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0)), pa.array([0, *low.tolist()], pa.int64()), pa.array([0, *high.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", "s", "low", "high"])

    found = rows.mapInArrow(moments, "i int, n long, s decimal(38,0), low long, high long")
    # A row for each dimension.
    per = {r["i"]: r for r in found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    n, d = per[-1]["n"] if per else 0, len(per) - 1
    if not n or not d:
        return None
    sums, most, reach = [], 0, 0
    for i in range(d):
        r, lack = per[i], n - per[i]["n"]
        s = int(r["s"]) + lack * shift
        low, high = (min(r["low"], shift), max(r["high"], shift)) if lack else (r["low"], r["high"])
        sums.append(s)
        most = max(most, n * high - s, s - n * low)
        reach = max(reach, n * max(abs(low), abs(high)) + abs(s))
    small = reach < 1 << 62
    by = primes(max(1, 2 * n * most * most))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(by), d, d), np.int64)
        for _, x, _ in blocks(batches, d, scale, shift):
            for k, p in enumerate(by):
                r = (x % p * (n % p) - np.array([s % p for s in sums])) % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        i, j = np.triu_indices(d)
        for k in range(len(by)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k, i, j])], ["k", "i", "j", "r"])

    summed = rows.mapInArrow(residues, "k int, i int, j int, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r")).toArrow()
    k, i, j, r = (summed.column(c).to_numpy() for c in ("k", "i", "j", "r"))
    left = np.zeros((len(by), d, d), object)
    left[k, i, j] = r.astype(object)
    modulus = math.prod(by)
    scatter = sum(left[k] * (modulus // p * pow(modulus // p, -1, p)) for k, p in enumerate(by)) % modulus
    scatter = np.where(scatter > modulus // 2, scatter - modulus, scatter)
    scatter = np.triu(scatter) + np.triu(scatter, 1).T
    v = np.array([[a / n**3 for a in row] for row in scatter.tolist()], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, sums, e, u, sum(scatter.diagonal().tolist()) / n**3, small, scatter.tolist())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """vec_id, n, deviation (decimal), whitened (array), explained (array), identity_error of each row that takes part."""
    rows = whole(df, id_col, vec_col)
    model = fit(rows, components=components, scale=scale, shift=shift)
    if model is None:
        return df.sparkSession.createDataFrame([], "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    n, d, live = model.n, len(model.sums), model.live
    by_root = model.components / np.sqrt(np.where(live, model.eigenvalues, 1.0))
    sums, small = model.sums, model.small

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in blocks(batches, d, scale, shift):
            y = centred(x, n, sums, small)
            w = (y / n).astype(np.float64) @ by_root
            flat = pa.array(w.ravel(), mask=np.broadcast_to(~live, w.shape).ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            squares = pa.array([Decimal(s) if s < 10**38 else None for s in _squares(y)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([ids, squares, pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "whitened"])

    out = Scratch(df.sparkSession, "whiten").save(rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>"))
    at = [int(i) for i in np.flatnonzero(live)]
    w, pairs = F.col("whitened"), [(a, b) for i, a in enumerate(at) for b in at[i:]]
    # Spark's covariance updates means as it goes: it is centred before it multiplies.
    got = out.agg(*(F.covar_pop(w[a], w[b]) for a, b in pairs)).first() if pairs else []
    error = max((abs(c - (a == b)) for c, (a, b) in zip(got, pairs, strict=True)), default=None)
    explained = [float(e) / model.trace if model.trace else None for e in model.eigenvalues]
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*(F.lit(e).cast("double") for e in explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_residue_whitening(spark, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
    return out.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("pos")].alias("explained"), "identity_error")
