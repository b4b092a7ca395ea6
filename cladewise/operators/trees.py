"""Trees: constrained neighbour joining, bootstrap, sister groups, clade support.

One tree has at most a few dozen leaves; Spark spreads queries and replicates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.sequence import LEAST_ALIGNED, SATURATED
from cladewise.operators.alignment import spread

_CODE = np.full(256, 0, np.uint8)
for _i, _c in enumerate("ACGT", 1):
    _CODE[ord(_c)] = _i
TRIES = 10


def indicators(columns: np.ndarray) -> np.ndarray:
    """Of a matrix of bases (1 to 4 for A, C, G and T, 0 unknown): seven matrices of 0 and 1, for known, purine, pyrimidine and each base."""
    kinds = (columns > 0, (columns == 1) | (columns == 3), (columns == 2) | (columns == 4), *(columns == i for i in (1, 2, 3, 4)))
    return np.stack(kinds).astype(np.float32)


def k2p_matrices(each: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kimura distances of the rows from their indicators, a matrix for each row of ``times``: how often each column counts. And whether all pairs have bases enough. Counts are whole numbers, so products of matrices give them exactly."""
    size, purine, pyrimidine, *same = np.moveaxis((each[None] * times[:, None, None, :].astype(np.float32)) @ each.transpose(0, 2, 1), 1, 0)
    n = size.shape[-1]
    off = ~np.eye(n, dtype=bool)
    enough = (size[:, off] >= LEAST_ALIGNED).all(1)
    kind = purine + pyrimidine
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = ((kind - sum(same)) / size.astype(float)), ((size - kind) / size.astype(float))
        x, y = 1 - 2 * p - q, 1 - 2 * q
        d = np.where((x <= 0) | (y <= 0), SATURATED, -0.5 * np.log(np.maximum(x, 1e-300)) - 0.25 * np.log(np.maximum(y, 1e-300)))
    return np.where(off, d, 0.0), enough


def k2p_matrix(each: np.ndarray, times: np.ndarray) -> np.ndarray | None:
    """One matrix; None if some pair has too few bases."""
    d, enough = k2p_matrices(each, times[None])
    return d[0] if enough[0] else None


def patterns(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sites of an alignment, as columns, and which of them each site is."""
    found, which = np.unique(columns.T, axis=0, return_inverse=True)
    return found.T, which.ravel()


class Constraints:
    """Groups of leaves that a tree must hold together. Leaves that are in no group join any other and do not count.

    A node may stand if each group lies outside of it, holds it or is held by
    it; for a group that is told from ``others``, only these two count, and it
    is as good if the node holds all others, since the tree has no root. Nodes
    never change, so a pair is looked at once, when its later node is made:
    counts of a node's leaves in each group tell it.
    """

    def __init__(self, groups: np.ndarray, others: np.ndarray | None = None, split: np.ndarray | None = None) -> None:
        """groups: a row of booleans over the leaves for each; others: the same, or else all leaves of other groups; split: for each, whether it is told from others."""
        n = groups.shape[1]
        rest = groups.any(0) & ~groups if others is None else others
        self.split = np.zeros(len(groups), bool) if split is None else split
        self.inside, self.outside = groups.T.astype(np.int16), rest.T.astype(np.int16)
        self.sizes, self.rests = self.inside.sum(0), self.outside.sum(0)
        pair = lambda x: x[:, None, :] + x[None, :, :]
        self.leaves = self.fit(pair(self.inside), pair(self.outside)) if n else np.ones((0, 0), bool)

    def fit(self, inside: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """Whether nodes with so many leaves in each group, and so many beside it, may stand."""
        good = (inside == 0) | (inside == self.sizes) | (outside == 0)
        if self.split.any():
            good |= self.split & (outside == self.rests)
        return good.all(-1)


def joined_trees(d: np.ndarray, constraints: Constraints | None, rngs: list[np.random.Generator]) -> list[np.ndarray]:
    """Neighbour joining of several matrices over the same leaves, all of them a step at a time.

    For each its clades, smallest first: a row of booleans over the leaves.
    Only allowed pairs are joined; equal pairs are drawn from by the matrix's
    generator. A new node takes the place of the first it joins, and the last
    node that of the second.
    """
    many, n = len(d), d.shape[-1]
    every, nodes, at = d.astype(float), np.tile(np.eye(n, dtype=bool), (many, 1, 1)), np.arange(many)
    lower = np.where(np.tri(n, dtype=bool), np.inf, 0.0)
    out: list[list[np.ndarray]] = [[] for _ in range(many)]
    which = at.copy()  # whose matrix each is; those without an allowed pair end early
    if constraints is not None:
        wall = np.tile(np.where(constraints.leaves, 0.0, np.inf), (many, 1, 1))
        inside = np.tile(constraints.inside, (many, 1, 1))
        outside = np.tile(constraints.outside, (many, 1, 1))
    for m in range(n, 3, -1):
        total = every.sum(2)
        q = (m - 2) * every - total[:, :, None] - total[:, None, :] + lower[:m, :m]
        if constraints is not None:
            q += wall
        flat = q.reshape(len(at), m * m)
        best = flat.argmin(1)
        least = flat[at, best]
        going = np.isfinite(least)
        if not going.all():
            which, every, nodes, flat, best, least = which[going], every[going], nodes[going], flat[going], best[going], least[going]
            if constraints is not None:
                wall, inside, outside = wall[going], inside[going], outside[going]
            at = np.arange(len(which))
            if not len(at):
                break
        equal = flat <= least[:, None] + 1e-12
        for r in np.flatnonzero(equal.sum(1) > 1):
            ties = np.flatnonzero(equal[r])
            best[r] = ties[rngs[which[r]].integers(len(ties))]
        i, j = best // m, best % m
        row = (every[at, i] + every[at, j] - every[at, i, j][:, None]) / 2
        row[at, i] = 0.0
        every[at, i, :] = every[at, :, i] = row
        every[at, j, :] = every[at, m - 1, :]
        every[at, :, j] = every[at, :, m - 1]
        every[at, j, j] = 0.0
        nodes[at, i] |= nodes[at, j]
        for r, clade in zip(which.tolist(), nodes[at, i]):
            out[r].append(clade)
        nodes[at, j] = nodes[:, m - 1]
        every, nodes = every[:, : m - 1, : m - 1], nodes[:, : m - 1]
        if constraints is not None:
            for x in (inside, outside):
                x[at, i] += x[at, j]
                x[at, j] = x[:, m - 1]
            wall[at, j, :] = wall[at, m - 1, :]
            wall[at, :, j] = wall[at, :, m - 1]
            inside, outside, wall = inside[:, : m - 1], outside[:, : m - 1], wall[:, : m - 1, : m - 1]
            fits = constraints.fit(inside + inside[at, i][:, None], outside + outside[at, i][:, None])
            wall[at, i, :] = wall[at, :, i] = np.where(fits, 0.0, np.inf)
    return [np.array(x, bool).reshape(-1, n) for x in out]


def neighbour_joining(d: np.ndarray, names: list[str], constraints: list[frozenset[str]], rng: np.random.Generator) -> list[frozenset[str]]:
    """Clades of the tree by name, smallest first."""
    groups = np.array([[x in c for x in names] for c in constraints], bool).reshape(len(constraints), len(names))
    found = joined_trees(d[None], Constraints(groups) if len(groups) else None, [rng])[0]
    return [frozenset(names[i] for i in np.flatnonzero(row)) for row in found]


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("\x1f".join(map(str, key)).encode()).digest()[:8], "little"))


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words; bit i of word w is column 64 * w + i."""
    n = rows.shape[1]
    wide = np.zeros((len(rows), -(-n // 64) * 64), bool)
    wide[:, :n] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")


def _constraints(names: list[str], sets) -> Constraints | None:
    """sets: rows of members and others; a group tells something if it and what it is told from have two leaves of the tree each."""
    rows = list(sets) if sets is not None else []
    own = np.array([np.isin(names, list(s["members"])) for s in rows], bool).reshape(-1, len(names))
    split = np.array([s["others"] is not None for s in rows], bool)
    told = np.array([np.isin(names, list(s["others"])) if s["others"] is not None else np.zeros(len(names), bool) for s in rows], bool).reshape(-1, len(names))
    others = np.where(split[:, None], told & ~own, own[~split].any(0) & ~own) if len(rows) else own
    some = (own.sum(1) > 1) & (~split | (others.sum(1) > 1))
    return Constraints(own[some], others[some], split[some]) if some.any() else None


SPLITS = "query string, rep int, clades array<array<bigint>>"
#: Replicates that one row of work stands for: an alignment is copied once for so many.
TOGETHER = 50


def leaf_names(members: DataFrame) -> DataFrame:
    """query, names: the leaves in order of name; a leaf's place is its bit."""
    return members.groupBy("query").agg(F.array_sort(F.collect_set("name")).alias("names"))


def bootstrap_splits(aligned: DataFrame, replicates: int = 100, constraints: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """query, rep, clades: the clades of every replicate's tree as bit sets over ``leaf_names``; none where no draw gave distances of all pairs.

    aligned: query, name, aligned. constraints: query, members, and where a
    group is told from some others only, ``others``. Replicates of one query run
    in parallel; each has a seed from query and number alone.
    """
    whole = aligned.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("name", "aligned"))).alias("rows"))  # one alignment
    if constraints is not None:
        others = F.col("others") if "others" in constraints.columns else F.lit(None).cast("array<string>")
        whole = whole.join(constraints.groupBy("query").agg(F.collect_set(F.struct("members", others.alias("others"))).alias("sets")), "query", "left")
    else:
        whole = whole.withColumn("sets", F.lit(None).cast("array<struct<members:array<string>,others:array<string>>>"))
    tasks = whole.select("query", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(TOGETHER))).alias("first"), "rows", "sets")

    def run(batches):
        for pdf in batches:
            out = []
            for query, first, rows, sets in zip(pdf["query"], pdf["first"], pdf["rows"], pdf["sets"], strict=True):
                names = [r["name"] for r in rows]
                columns, which = patterns(np.stack([_CODE[np.frombuffer(r["aligned"].upper().encode("ascii", "replace"), np.uint8)] for r in rows]))
                each, sites = indicators(columns), len(which)
                fixed = _constraints(names, sets)
                reps = range(first, min(first + TOGETHER, replicates))
                rngs = [_rng(seed, query, rep) for rep in reps]
                found: dict[int, np.ndarray] = {}
                left = list(range(len(reps))) if sites else []
                for _ in range(TRIES):
                    if not left:
                        break
                    times = np.stack([np.bincount(which[rngs[r].integers(sites, size=sites)], minlength=columns.shape[1]) for r in left])
                    d, enough = k2p_matrices(each, times)
                    found |= {r: d[k] for k, r in enumerate(left) if enough[k]}
                    left = [r for k, r in enumerate(left) if not enough[k]]
                some = sorted(found)
                trees = dict(zip(some, joined_trees(np.stack([found[r] for r in some]), fixed, [rngs[r] for r in some]), strict=True)) if some else {}
                out += [(query, rep, words_of(trees[r]).tolist() if r in trees else []) for r, rep in enumerate(reps)]
            yield pd.DataFrame(out, columns=["query", "rep", "clades"])

    return spread(tasks, "query", "first").mapInPandas(run, SPLITS)


def _has(clade: Column, i: Column) -> Column:
    return F.get(clade, F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 64).cast("int"))) != 0


def named(clade: Column, names: Column) -> Column:
    """The names of a bit set's leaves, in order."""
    return F.filter(names, lambda x, i: _has(clade, i))


def bits_of(members: Column, names: Column) -> Column:
    """The bit set of some of the names."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 64).cast("int"))
    word = lambda w: F.aggregate(F.sequence(w * 64, F.least(w * 64 + 63, F.size(names) - 1)), F.lit(0).cast("bigint"), lambda a, i: F.when(F.array_contains(members, F.get(names, i)), a.bitwiseOR(bit(i))).otherwise(a))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(names) - 1) / 64).cast("int")), word)


def size_of(clade: Column) -> Column:
    return F.aggregate(clade, F.lit(0), lambda a, w: a + F.bit_count(w))


def within(a: Column, b: Column) -> Column:
    """Whether one bit set is part of another."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)) == 0), lambda x: x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def apart(a: Column, b: Column) -> Column:
    """Whether two bit sets have nothing in common."""
    return F.forall(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) == 0), lambda x: x)


def compatible(a: Column, b: Column) -> Column:
    """Whether two clades can stand in one rooted tree."""
    return apart(a, b) | within(a, b) | within(b, a)


CLADES = "query string, rep int, clade array<string>"


def split_names(splits: DataFrame, leaves: DataFrame) -> DataFrame:
    """query, rep, clade (sorted names), a row for each clade; a tree without a clade has one empty one. leaves: query, names."""
    none = F.array(F.array().cast("array<bigint>"))
    each = splits.join(leaves, "query").select("query", "rep", "names", F.explode(F.when(F.size("clades") > 0, F.col("clades")).otherwise(none)).alias("c"))
    return each.select("query", "rep", F.when(F.size("c") > 0, named(F.col("c"), F.col("names"))).otherwise(F.array().cast("array<string>")).alias("clade"))


def as_splits(clades: DataFrame, leaves: DataFrame) -> DataFrame:
    """The other way round: query, rep, clades. clades: query, rep, clade (names)."""
    bits = F.when(F.size("clade") > 0, bits_of(F.col("clade"), F.col("names")))
    return clades.join(leaves, "query").select("query", "rep", bits.alias("c")).groupBy("query", "rep").agg(F.array_sort(F.collect_set("c")).alias("clades"))


def bootstrap_clades(aligned: DataFrame, replicates: int = 100, constraints: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """``bootstrap_splits`` by name: query, rep, clade, a row for each clade."""
    return split_names(bootstrap_splits(aligned, replicates, constraints, seed), leaf_names(aligned))


def clade_support(clades: DataFrame, replicates: int) -> DataFrame:
    """query, clade (names joined by commas), support: the share of replicates that have the clade."""
    return clades.filter(F.size("clade") > 0).groupBy("query", F.array_join("clade", ",").alias("clade")).agg((F.count_distinct("rep") / F.lit(float(replicates))).alias("support"))


def majority_clades(clades: DataFrame, replicates: int) -> DataFrame:
    """The clades of the majority-rule consensus: those in over half of the replicates."""
    return clade_support(clades, replicates).filter("support > 0.5")


def complementary(a: Column, b: Column, every: Column) -> Column:
    """Whether two sets of names are the two sides of one split of all names."""
    return ~F.arrays_overlap(a, b) & (F.size(F.array_union(a, b)) == F.size(F.array_distinct(every)))


def sister_sets(splits: DataFrame, leaves: DataFrame) -> DataFrame:
    """query, rep, side, sister (bit set): what stands beside the query's leaf, one side for each of its two rootings. Nothing is shuffled but a row for each query.

    With the leaf's least clade C, one rooting makes the rest of C the sister
    group; the other makes it what is outside C. Trees have no root: a clade is
    one side of a split. leaves: query, names, leaf (the query's own).
    """
    per = leaves.select("query", F.size("names").alias("n"), bits_of(F.col("names"), F.col("names")).alias("every"), bits_of(F.array("leaf"), F.col("names")).alias("own"))
    around = F.transform("clades", lambda c: F.when(apart(c, F.col("own")), minus(F.col("every"), c)).otherwise(c))
    least = F.array_min(F.transform(F.filter(around, lambda c: size_of(c) > 1), lambda c: F.struct(size_of(c).alias("n"), c.alias("c"))))["c"]
    found = splits.join(per, "query").withColumn("c", least).filter("c is not null")
    return found.select("query", "rep", F.posexplode(F.array(minus(F.col("c"), F.col("own")), minus(F.col("every"), F.col("c")))).alias("side", "sister"))


def sister_groups(clades: DataFrame, members: DataFrame, leaf: str = "query_leaf") -> DataFrame:
    """``sister_sets`` by name: query, rep, side, sister. clades: query, rep, clade. members: query, name, and ``query_leaf``, the name of the query's own leaf."""
    leaves = leaf_names(members).join(members.groupBy("query").agg(F.min(leaf).alias("leaf")), "query")
    found = sister_sets(as_splits(clades, leaves), leaves)
    return found.join(leaves, "query").select("query", "rep", "side", named(F.col("sister"), F.col("names")).alias("sister"))


def sister_occurrence(sisters: DataFrame) -> DataFrame:
    """In how many replicates each name is in the chosen sister group."""
    return sisters.select("query", "rep", F.explode("sister").alias("name")).groupBy("query", "name").agg(F.count_distinct("rep").alias("cnt"))


def occurrence_share(occurrence: DataFrame, n_trees: DataFrame) -> DataFrame:
    """Adds ``share`` of the query's trees. n_trees: query, n_trees."""
    return occurrence.join(n_trees, "query").withColumn("share", F.col("cnt").cast("double") / F.col("n_trees")).drop("n_trees")


def lowest_share(shares: DataFrame) -> DataFrame:
    """query, lowest: the share of the name that occurs least."""
    return shares.groupBy("query").agg(F.min("share").alias("lowest"))


def four_points(d: np.ndarray, tolerance: float = 1e-9) -> bool:
    """Whether distances fit a tree: of the three sums over any four points the two greatest are equal."""
    from itertools import combinations

    for a, b, c, e in combinations(range(len(d)), 4):
        x = sorted((d[a, b] + d[c, e], d[a, c] + d[b, e], d[a, e] + d[b, c]))
        if x[2] - x[1] > tolerance:
            return False
    return True
