"""Clades of many trees as bit sets: frequencies, monophyly, rooting and consensus trees.

Trees are rows of query, rep and clades, as ``trees.bootstrap_splits`` and
``newick.trees`` give them; leaves are query and names, in order, one row for
each query. Clades are counted where they are read, and meet groups of leaves
by one equi-join on their bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import trees as N


def every_bit(names: Column) -> Column:
    return N.bits_of(names, names)


def tree_leaves(parsed: DataFrame) -> DataFrame:
    """query, names of parsed trees. Raises when it runs if a query's trees differ in their leaves."""
    some = parsed.filter("problem is null").groupBy("query").agg(F.min("leaves").alias("names"), F.max("leaves").alias("other"))
    return some.select("query", F.when(F.col("names") == F.col("other"), F.col("names")).otherwise(F.raise_error(F.concat(F.lit("trees differ in leaves: "), F.col("query"))).cast("array<string>")).alias("names"))


def clade_counts(splits: DataFrame) -> DataFrame:
    """query, clade, n: in how many trees a clade stands."""
    return splits.select("query", F.explode(F.array_distinct("clades")).alias("clade")).groupBy("query", "clade").agg(F.count(F.lit(1)).alias("n"))


def group_bits(groups: DataFrame, leaves: DataFrame) -> DataFrame:
    """query, level, name, size, clade: the leaves of each group as bits. groups: query, level, name, leaf; leaves that are not in the tree do not count."""
    one = groups.groupBy("query", "level", "name").agg(F.collect_set("leaf").alias("members"))
    out = one.join(leaves, "query").select("query", "level", "name", N.bits_of(F.col("members"), F.col("names")).alias("clade"), F.col("names"))
    return out.select("query", "level", "name", N.size_of(F.col("clade")).alias("size"), "clade", every_bit(F.col("names")).alias("every")).filter("size > 0")


def monophyly(splits: DataFrame, groups: DataFrame, leaves: DataFrame, rooted: bool = True) -> DataFrame:
    """query, level, name, size, n, n_trees: in how many trees a group is a clade. One leaf alone, and all leaves, always are. Without a root a group is one if all other leaves are."""
    wanted = group_bits(groups, leaves)
    n_trees = splits.groupBy("query").agg(F.count(F.lit(1)).alias("n_trees"))
    sides = wanted.select("query", "level", "name", "size", "every", F.explode(F.array("clade") if rooted else F.array("clade", N.minus(F.col("every"), F.col("clade")))).alias("clade"))
    found = sides.join(clade_counts(splits), ["query", "clade"], "left").groupBy("query", "level", "name", "size", N.size_of(F.col("every")).alias("all")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    always = (F.col("size") == 1) | (F.col("size") == F.col("all")) | (F.lit(not rooted) & (F.col("size") == F.col("all") - 1))
    return found.join(n_trees, "query").select("query", "level", "name", "size", F.when(always, F.col("n_trees")).otherwise(F.col("n")).alias("n"), "n_trees")


def defining_groups(chosen: DataFrame, splits: DataFrame, groups: DataFrame, leaves: DataFrame) -> DataFrame:
    """query, rep, monophyletic, ingroup: whether the lowest group that a sister set shares is, with the query's leaf, one side of a split of its tree; and whether it is more than the sister set itself.

    chosen: query, rep, sister (bits), level, name (null without a lineage). leaves: query, names, leaf.
    """
    own = leaves.select("query", N.bits_of(F.array("leaf"), F.col("names")).alias("own"), every_bit(F.col("names")).alias("every"))
    bits = group_bits(groups, leaves).select("query", "level", "name", F.col("clade").alias("members"))
    x = chosen.join(bits, ["query", "level", "name"], "left").join(own, "query")
    x = x.withColumn("members", F.coalesce("members", "sister")).withColumn("side", F.zip_with("members", "own", lambda a, b: a.bitwiseOR(b)))
    x = x.join(splits.select("query", "rep", "clades"), ["query", "rep"])
    other = N.minus(F.col("every"), F.col("side"))
    trivial = (N.size_of(F.col("side")) <= 1) | (N.size_of(other) <= 1)
    mono = trivial | F.array_contains("clades", F.col("side")) | F.array_contains("clades", other)
    more = N.size_of(F.col("members")) > N.size_of(F.col("sister"))
    return x.select("query", "rep", mono.alias("monophyletic"), (mono & more).alias("ingroup"))


def rooted_by(splits: DataFrame, leaves: DataFrame, outgroup: DataFrame) -> DataFrame:
    """splits as trees that are rooted between the outgroup and the rest; clades are null where the outgroup is no side of a split. A root with three children needs no care: what it leaves out is the other side of a split.

    outgroup: query, name.
    """
    out = outgroup.groupBy("query").agg(F.collect_set("name").alias("members")).join(leaves, "query")
    out = out.select("query", N.bits_of(F.col("members"), F.col("names")).alias("out"), every_bit(F.col("names")).alias("every"))
    x = splits.join(out, "query").withColumn("rest", N.minus(F.col("every"), F.col("out")))
    fits = (N.size_of(F.col("out")) == 1) | (N.size_of(F.col("rest")) == 1) | F.array_contains("clades", F.col("out")) | F.array_contains("clades", F.col("rest"))
    side = lambda c: F.when(N.within(c, F.col("out")) | N.within(c, F.col("rest")), c).otherwise(N.minus(F.col("every"), c))
    both = F.filter(F.array("out", "rest"), lambda c: N.size_of(c) > 1)
    clades = F.when(fits, F.array_sort(F.array_union(F.filter(F.transform("clades", side), lambda c: N.size_of(c) > 1), both)))
    return x.select("query", "rep", clades.alias("clades"))


def majority(splits: DataFrame, share: float = 0.5) -> DataFrame:
    """query, clade, support: the clades in more than this share, a half or more, of a query's trees. Any two of them fit into one tree."""
    if share < 0.5:
        raise ValueError("only clades of more than half of the trees are sure to fit")
    n = splits.groupBy("query").agg(F.count(F.lit(1)).alias("n_trees"))
    x = clade_counts(splits).join(n, "query").withColumn("support", F.col("n").cast("double") / F.col("n_trees"))
    return x.filter(F.col("support") > share).select("query", "clade", "support")


def nested(clades: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds ``parent``: the least clade that holds a clade, null at the root. Of a leaf's clades each is held by the next in size, so a clade's first leaf tells its parent; no two clades are compared."""
    each = clades.join(leaves, "query").select("query", "clade", N.size_of(F.col("clade")).alias("size"), N.named(F.col("clade"), F.col("names")).alias("members"))
    at = each.select("query", "clade", "size", F.explode("members").alias("leaf"), (F.get("members", F.lit(0)) == F.col("leaf")).alias("first"))
    chain = at.withColumn("parent", F.lead("clade").over(Window.partitionBy("query", "leaf").orderBy("size")))
    return clades.join(chain.filter("first").select(F.col("query").alias("_q"), F.col("clade").alias("_c"), "parent"), (F.col("query") == F.col("_q")) & (F.col("clade") == F.col("_c"))).drop("_q", "_c")


def newick(clades: DataFrame, leaves: DataFrame, label: Column | None = None) -> DataFrame:
    """query, newick: clades that fit into one tree as nested text, children in order of their first leaf. label: text behind a clade, from the columns of clades.

    Leaves are put in order by the first leaves of the clades around them, the
    largest first: so each clade stands together. A clade opens at its first
    leaf and closes at its last. One sort for each query; no pass for each depth.
    """
    none = F.lit("") if label is None else label
    each = clades.withColumn("label", none).join(leaves, "query").select("query", "clade", "label", N.size_of(F.col("clade")).alias("size"), N.named(F.col("clade"), F.col("names")).alias("members"))
    each = each.withColumn("first", F.get("members", F.lit(0)))
    every = leaves.select("query", F.explode("names").alias("leaf"))
    around = each.select("query", F.explode("members").alias("leaf"), F.struct((-F.col("size")).alias("size"), "first").alias("c")).groupBy("query", "leaf").agg(F.array_sort(F.collect_list("c")).alias("c"))
    key = F.concat(F.coalesce(F.transform("c", lambda x: x["first"]), F.array().cast("array<string>")), F.array("leaf"))
    placed = every.join(around, ["query", "leaf"], "left").select("query", "leaf", F.row_number().over(Window.partitionBy("query").orderBy(key)).alias("place"))
    opens = each.groupBy("query", F.col("first").alias("leaf")).agg(F.count(F.lit(1)).alias("opens"))
    last = each.select("query", "clade", "label", "size", F.explode("members").alias("leaf")).join(placed, ["query", "leaf"]).groupBy("query", "clade", "label", "size").agg(F.max_by("leaf", "place").alias("leaf"))
    closes = last.groupBy("query", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "label"))), lambda x: F.concat(F.lit(")"), x["label"])), "").alias("closes"))
    text = F.concat(F.repeat(F.lit("("), F.coalesce("opens", F.lit(0)).cast("int")), F.col("leaf"), F.coalesce("closes", F.lit("")))
    tokens = placed.join(opens, ["query", "leaf"], "left").join(closes, ["query", "leaf"], "left").select("query", "place", text.alias("t"))
    whole = tokens.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), ",").alias("t"))
    return whole.select("query", F.concat(F.lit("("), "t", F.lit(");")).alias("newick"))


def consensus_newick(splits: DataFrame, leaves: DataFrame, share: float = 0.5) -> DataFrame:
    """query, newick: the majority-rule consensus of each query's trees, with the support in percent, rounded down, behind each clade."""
    return newick(majority(splits, share), leaves, F.floor(F.col("support") * 100 + F.lit(1e-9)).cast("string"))
