"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, floor(scale * x). An added coordinate makes the
nearest by distance the highest by inner product: data y get
``sqrt(M**2 - |y|**2)`` with M the greatest length, queries get 0, and then
``|q - y|**2 = |q|**2 + M**2 - 2 q.y``.

1. Pivots: a sample of data vectors, as many as the root of their number, 64 to
   1024, or ``pivots``.
2. Data and queries go to their nearest pivot's cell. A summary of each data
   cell keeps its k + 1 least distances to the pivot, one of each query cell
   its radius. From these alone follows, for each query cell, a distance within
   which any of its queries has k neighbours besides itself.
3. A data vector goes to a group of query cells only if the triangle inequality
   leaves it within that distance of one of them. Large query cells are split,
   small ones share a group, so a group has at most ``group_rows`` queries.
4. Groups are cut by a hash of the data id into as many chunks of bounded size
   as the data sent to them ask for. Each chunk is solved by one matrix product,
   exactly; the best k of each query and chunk meet in a window.

A cell that holds most of the data is spread over the chunks like any other.

Defined results: vectors that are null, or hold a null or a component that is
not finite, take no part, nor do rows without id; rows that repeat an id count
once (the least vector); vectors of different lengths
compare as if the shorter one ended in zeros; an empty vector scores 0; with
fewer than k candidates all are returned; ties go to the smaller id; components
beyond 64 bits saturate and scores beyond 64 bits wrap; an empty table gives no
rows; columns of other names do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Distances are floats; bounds are widened by this share of M.
SLACK = 1e-6


def _vectors(raw, dim: int) -> np.ndarray:
    """Arrays of integers, or an Arrow column of them, as rows of one matrix; shorter ones end in zeros."""
    if isinstance(raw, pa.Array):
        flat, ends = raw.flatten().to_numpy(zero_copy_only=False), np.diff(raw.offsets.to_numpy())
        if (ends == dim).all():
            return flat.reshape(len(raw), dim)
        raw = np.split(flat, np.cumsum(ends)[:-1])
    out = np.zeros((len(raw), dim), np.int64)
    for i, x in enumerate(raw):
        out[i, : len(x)] = x
    return out


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, v (64-bit integers), norm2, for each row with a whole vector."""
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    # A null component makes the test null, and a comparison with NaN or infinity fails: NaN is the greatest double.
    whole = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).cast("array<bigint>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("norm2", norm)


def _to_pivots(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, own_pivots: np.ndarray) -> np.ndarray:
    """Distances in the widened space; own: the added coordinate."""
    x = x.astype(np.float64)
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T + (own[:, None] - own_pivots) ** 2
    return np.sqrt(np.maximum(d2, 0))


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, data id and score of the k best data of each query, its own row left out. data_ids must ascend."""
    top = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(data).max(initial=0))) * max(1, queries.shape[1])
    if top < 2**53:
        score = (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    else:
        score = queries @ data.T
    n = len(data_ids)
    own = query_ids[:, None] == data_ids[None, :]
    if top < 2**62 // n:
        rank = score * n - np.arange(n)
        rank[own] = np.iinfo(np.int64).min
        kk = min(k + 1, n)
        at = np.argpartition(rank, n - kk, axis=1)[:, n - kk :] if kk < n else np.broadcast_to(np.arange(n), rank.shape)
        order = np.argsort(-np.take_along_axis(rank, at, 1), axis=1, kind="stable")
        at = np.take_along_axis(at, order, 1)
    else:
        at = np.stack([np.lexsort((data_ids, ~row)) for row in score])
    rows = np.repeat(np.arange(len(query_ids)), at.shape[1])
    cols = at.ravel()
    keep = ~own[rows, cols]
    place = np.cumsum(keep.reshape(at.shape), axis=1).ravel()
    keep &= place <= k
    rows, cols = rows[keep], cols[keep]
    return query_ids[rows], data_ids[cols], score[rows, cols]


def knn_join(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 5, scale: float = 256.0, pivots: int | None = None, group_rows: int = 2048, chunk_rows: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on ``id``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "knn")
    rows = scratch.save(integers(df, id_col, vec_col, scale))
    n, width, m2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm2")).first()
    result = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, m2 = max(1, width), float(m2)
    pivots = pivots or min(1024, max(64, math.isqrt(n)))
    sample = rows.select("v", "norm2").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(4 * pivots).collect()  # bounded
    chosen = list({tuple(r["v"]): r["norm2"] for r in sample}.items())[:pivots]
    p = _vectors([v for v, _ in chosen], dim).astype(np.float64)
    own_p = np.sqrt(np.maximum(m2 - np.array([x for _, x in chosen]), 0))

    def assign(data: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _vectors(batch.column(1), dim)
                own = np.sqrt(np.maximum(m2 - batch.column(2).to_numpy(), 0)) if data else np.zeros(batch.num_rows)
                d = _to_pivots(x, own, p, own_p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "dist"])

        return task

    schema = "id long, v array<long>, cell int, dist double"
    data = scratch.save(rows.mapInArrow(assign(True), schema))
    queries = scratch.save(rows.filter(is_query).mapInArrow(assign(False), schema))

    # Summaries: at most pivots * (k + 1) and pivots rows.
    near = data.select("cell", "dist", "id").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id"))).filter(F.col("r") <= k + 1).select("cell", "dist").collect()
    cells = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).orderBy("cell").collect()
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    between = _to_pivots(p, own_p, p, own_p)
    slack = SLACK * (1 + float(np.sqrt(m2)))
    of = np.array([r["cell"] for r in near], int)
    dist = np.array([r["dist"] for r in near])
    low, high = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)  # data cell, query cell
    groups: dict[int, list[int]] = {}
    at, room = -1, 0
    for c in cells:
        i, size, radius = c["cell"], c["n"], c["radius"]
        bound = np.sort(radius + between[i, of] + dist)[min(k, len(of) - 1)] if len(of) > k else np.inf
        low[:, i], high[:, i] = between[i] - radius - bound - slack, between[i] + radius + bound + slack
        if size > room:
            need = -(-size // group_rows)
            groups[i] = list(range(at + 1, at + 1 + need))
            at, room = at + need, group_rows - size if need == 1 else 0
        else:
            groups[i] = [at]
            room -= size
    wanted = sorted(groups)
    chunk = chunk_rows or min(32768, max(512, -(-n // 48)))
    each = np.array([len(groups[j]) for j in wanted])
    listed = np.array([g for j in wanted for g in groups[j]], np.int64)
    begins = np.cumsum(each) - each

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()[:, None]
            row, j = np.nonzero((low[cell][:, wanted] <= d) & (d <= high[cell][:, wanted]))
            # All groups of each cell that a row goes to, each group once.
            times = each[j]
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            to = np.unique(np.repeat(row, times) * (at + 1) + listed[np.repeat(begins[j], times) + inside])
            ends = np.searchsorted(to, np.arange(batch.num_rows + 1) * (at + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((to % (at + 1)).astype(np.int32)))], ["id", "v", "groups"])

    sent = scratch.save(data.mapInArrow(spread, "id long, v array<long>, groups array<int>").select(F.explode("groups").alias("grp"), "id", "v"))
    # A row for each group: as many chunks as the data that its bounds let in ask for. And one for each cell: at most as many as pivots.
    chunks = scratch.save(sent.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")))
    parts = spark.createDataFrame([(i, groups[i][0], len(groups[i])) for i in wanted], "cell int, first int, parts int")
    left = sent.join(chunks, "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", "v")
    asked = queries.join(parts, "cell").select((F.col("first") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))).cast("int").alias("grp"), "id", "v")
    right = asked.join(chunks, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "v")

    def solve(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        d = d.sort_values("id")
        a, b, c = best(_vectors(list(q["v"]), dim), q["id"].to_numpy(), _vectors(list(d["v"]), dim), d["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    found = left.groupBy("grp", "chunk").cogroup(right.groupBy("grp", "chunk")).applyInPandas(solve, result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP1_SQL = """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, floor(256 * x::DOUBLE)::BIGINT AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score FROM v q JOIN v d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
