"""Connected components by alternating large-star and small-star.

Edges are pairs of longs. Large-star ties the larger neighbours of each node to
the least node of its neighbourhood; small-star ties the smaller neighbours and
the node itself to the least of these. Both keep components; when every node
either has no smaller neighbour or has one neighbour only, each component is a
star around its least node. The large star's aggregate tells that, so the round
that would change nothing is not made.

The least neighbour is an aggregate, combined before the shuffle. It is joined
back to the edges from a written table, so that Spark may split the rows of a
node with very many neighbours. Nothing is collected; each round's edges are
written out and counted as they are, and the last round's removed. Their
number says into how many files the next step goes: a task has about
``PER_TASK`` edges, or its share where there are more than shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import Scratch


#: Edges, or nodes, for a task.
PER_TASK = 1 << 15


def _parts(scratch: Scratch, rows: int) -> int:
    return max(1, min(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PER_TASK)))


def _written(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> tuple[DataFrame, int]:
    """The edges as a written table, and their number. rows: how many there are at most."""
    seen = Observation()
    out = edges.observe(seen, F.count(F.lit(1)).alias("n"))
    made = scratch.save(out if rows is None else out.coalesce(_parts(scratch, rows)))
    return made, seen.get["n"]


def _least(sides: DataFrame, scratch: Scratch, rows: int) -> tuple[DataFrame, bool]:
    """u and m, the least of a node and its neighbours v; and whether some node has a smaller neighbour and others beside it."""
    seen = Observation()
    per = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    per = per.observe(seen, F.max(((F.col("m") < F.col("u")) & (F.col("n") > 1)).cast("int")).alias("open"))
    made = scratch.save(per.select("u", F.least("u", "m").alias("m")).coalesce(_parts(scratch, rows)))
    return made, bool(seen.get["open"])


def components_counted(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``components``, and how many nodes there are at most."""
    now, n = _written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), scratch)
    while n:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, open_ = _least(both, scratch, 2 * n)
        if not open_:
            scratch.drop(least)
            break
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        mid, n = _written(large.filter("a < b").distinct(), scratch, n)
        scratch.drop(now, least)
        sides = mid.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least, _ = _least(sides, scratch, n)
        small = sides.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now, n = _written(small.filter("a < b").distinct(), scratch, 2 * n)
        scratch.drop(mid, least)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), 2 * n


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node. Nulls and loops are left out."""
    return components_counted(edges, scratch)[0]
