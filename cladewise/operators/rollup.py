"""Lineages of sampled trees rolled up into a summary by path, and what is read off it.

The summary is a long table keyed by query and path: additive counts, so two
summaries merge by a union and a sum, and Spark combines before it shuffles.
Equal lineages are counted before their prefixes are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.operators.lineage_cut import cut

KEY = ["query", "path", "depth", "rank", "level", "name"]


def summarise(trees: DataFrame, *flags: str) -> DataFrame:
    """query, path, depth, rank, level, name, cnt and one count for each boolean flag column. trees: query, lineage, flags; or cnt, already counted."""
    if "cnt" in trees.columns:
        whole = trees.select("query", "lineage", "cnt", *flags)
    else:
        whole = trees.groupBy("query", "lineage").agg(F.count(F.lit(1)).alias("cnt"), *(F.count_if(F.col(f)).alias(f) for f in flags))
    rows = whole.filter(F.size("lineage") > 0).select("query", F.explode(L.prefixes(F.col("lineage"))).alias("p"), "cnt", *flags)
    last = F.try_element_at("p", F.lit(-1))
    rows = rows.select("query", L.path(F.col("p")).alias("path"), F.size("p").alias("depth"), last["rank"].alias("rank"), last["level"].alias("level"), last["name"].alias("name"), "cnt", *flags)
    return rows.groupBy(*KEY).agg(F.sum("cnt").alias("cnt"), *(F.sum(f).alias(f) for f in flags))


def tree_counts(trees: DataFrame) -> DataFrame:
    """Number of trees of each query, those without consensus included."""
    return trees.groupBy("query").agg(F.count(F.lit(1)).alias("n_trees"))


def posteriors(summary: DataFrame, n_trees: DataFrame) -> DataFrame:
    """The share of a query's trees in which a path occurs."""
    return summary.join(n_trees, "query").withColumn("prob", F.col("cnt").cast("double") / F.col("n_trees"))


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy(*KEY).agg(F.sum("cnt").alias("cnt"))


def repair(summary: DataFrame) -> DataFrame:
    """Parents count at least as often as their children together, from the leaves up: one pass for each depth."""
    depth = summary.agg(F.max("depth")).first()[0] or 0
    out = summary
    for d in range(depth - 1, 0, -1):
        out = cut(out) if d % 4 == 0 else out  # else the plan doubles with each depth
        below = out.filter(F.col("depth") == d + 1).groupBy("query", parent_path(F.col("path")).alias("path")).agg(F.sum("cnt").alias("_below"))
        out = out.join(below, ["query", "path"], "left").withColumn("cnt", F.when(F.col("depth") == d, F.greatest("cnt", F.coalesce("_below", F.lit(0)))).otherwise(F.col("cnt"))).drop("_below")
    return out


def parent_path(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def leaves(summary: DataFrame) -> DataFrame:
    inner = summary.select("query", parent_path(F.col("path")).alias("path")).distinct()
    return summary.join(inner, ["query", "path"], "left_anti")


def densify(trees: DataFrame, levels: tuple[str, ...], filler: str = "placeHolder") -> DataFrame:
    """Every lineage gets an entry for each level above its last; missing ones are fillers."""
    wanted = F.array(*(F.struct(F.lit(L.LEVELS.index(x) + 1).alias("rank"), F.lit(x).alias("level")) for x in levels))
    last = F.coalesce(F.try_element_at("lineage", F.lit(-1))["rank"], F.lit(0))
    name = lambda w: F.coalesce(F.get(F.transform(F.filter("lineage", lambda e: e["rank"] == w["rank"]), lambda e: e["name"]), F.lit(0)), F.lit(filler))
    full = F.transform(F.filter(wanted, lambda w: w["rank"] <= last), lambda w: F.struct(w["rank"].alias("rank"), w["level"].alias("level"), name(w).alias("name")))
    return trees.withColumn("lineage", full)


def consolidate(trees: DataFrame, levels: tuple[str, ...], prune_level: float, filler: str = "placeHolder") -> DataFrame:
    """Removes fillers, rank by rank from the top.

    Under each parent, if fillers count less than ``prune_level`` times what the
    real names count, the fillers' trees end there; else the rank is dropped for
    that parent and its children move up. Equal lineages are counted first; each
    level is one aggregate over these, whose plan is cut so that it runs once.
    Returns query, lineage and cnt, the number of trees.
    """
    out = cut(densify(trees, levels, filler).groupBy("query", "lineage").agg(F.count(F.lit(1)).alias("cnt")).withColumn("done", F.array().cast(L.ENTRY_ARRAY)))
    # Ranks at which there is a filler at all; at others there is nothing to do but to pass on.
    filled = {r[0] for r in out.select(F.explode(F.array_distinct(F.transform(F.filter("lineage", lambda e: e["name"] == filler), lambda e: e["level"])))).distinct().collect()}

    def passed(rows: DataFrame, run: list[str]) -> DataFrame:
        inside = lambda e: e["level"].isin(run)
        return rows.select("query", F.filter("lineage", lambda e: ~inside(e)).alias("lineage"), "cnt", F.concat("done", F.filter("lineage", inside)).alias("done")) if run else rows

    run: list[str] = []
    for level in levels:
        if level not in filled:
            run.append(level)
            continue
        out, run = passed(out, run), []
        head = F.get("lineage", F.lit(0))
        at = F.coalesce(head["level"] == level, F.lit(False))
        parent = L.path(F.col("done"))
        out = out.withColumn("_parent", parent).withColumn("_at", at).withColumn("_fill", at & (head["name"] == filler))
        tally = out.filter("_at").groupBy("query", "_parent").agg(F.sum(F.when(F.col("_fill"), F.col("cnt")).otherwise(0)).alias("_fillers"), F.sum(F.when(F.col("_fill"), 0).otherwise(F.col("cnt"))).alias("_real")).filter("_fillers > 0")
        out = out.join(tally, ["query", "_parent"], "left")
        prune = F.col("_fillers") < F.col("_real") * F.lit(prune_level)
        rest = F.slice("lineage", F.lit(2), F.greatest(F.size("lineage") - 1, F.lit(0)))
        stays = F.col("_at") & F.col("_fillers").isNull()
        out = (
            out.withColumn("_prune", F.coalesce(prune, F.lit(False)))
            .withColumn("_done", F.when(stays | (F.col("_at") & F.col("_prune") & ~F.col("_fill")), F.concat("done", F.array(head))).otherwise(F.col("done")))
            .withColumn("lineage", F.when(~F.col("_at"), F.col("lineage")).when(F.col("_prune") & F.col("_fill"), F.array().cast(L.ENTRY_ARRAY)).otherwise(rest))
            .withColumn("done", F.col("_done"))
            .drop("_parent", "_at", "_fill", "_fillers", "_real", "_prune", "_done")
        )
        out = cut(out)
    return passed(out, run).groupBy("query", F.col("done").alias("lineage")).agg(F.sum("cnt").alias("cnt"))


def significant_ranks(post: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """query, cutoff, level, name, prob for the main ranks with prob >= cutoff / 100 on every rank above.

    A genus needs an order or a family as well, a species a genus, a subspecies a species.
    """
    main = post.filter(F.col("level").isin(*L.MAIN, "subspecies"))
    found = main.crossJoin(F.broadcast(cutoffs)).filter(F.col("prob") >= F.col("cutoff") / 100)  # cutoffs: a handful of numbers from the options
    have = Window.partitionBy("query", "cutoff")
    has = lambda *levels: F.max(F.col("level").isin(*levels)).over(have)
    found = found.withColumn("_genus", has("order", "family") & has("genus")).withColumn("_species", F.col("_genus") & has("species"))
    ok = F.when(F.col("level") == "genus", F.col("_genus")).when(F.col("level") == "species", F.col("_genus")).when(F.col("level") == "subspecies", F.col("_species")).otherwise(True)
    return found.filter(ok).select("query", "cutoff", "level", "name", "prob")


def most_probable(post: DataFrame) -> DataFrame:
    """The name with the highest probability at each main rank; of equal ones the first by name. A genus is named only where an order or a family is known, a species only with a genus."""
    w, all_ = Window.partitionBy("query", "level").orderBy(F.col("prob").desc(), "name", "path"), Window.partitionBy("query")
    has = lambda *levels: F.max(F.col("level").isin(*levels)).over(all_)
    main = post.filter(F.col("level").isin(*L.MAIN)).withColumn("_genus", has("order", "family")).withColumn("_species", F.col("_genus") & has("genus"))
    ok = F.when(F.col("level") == "genus", F.col("_genus")).when(F.col("level") == "species", F.col("_species")).otherwise(True)
    return main.filter(ok).withColumn("r", F.row_number().over(w)).filter("r = 1").select("query", "level", "name", "prob")


def significant_lineage(post: DataFrame, cutoff: float) -> DataFrame:
    """query and the path of names with a probability of at least the cutoff, which is over one half."""
    sure = post.filter(F.col("prob") >= cutoff)
    return sure.groupBy("query").agg(F.max_by("path", "depth").alias("path"), F.max("depth").alias("depth"))


def prior(k: Column, n: Column) -> Column:
    """Of a clade with k of n sequences: ``(2k - 1) / (2n - 3)``, 1 if it holds all."""
    return F.when(k == n, F.lit(1.0)).otherwise((2 * k - 1).cast("double") / (2 * n - 3))


def bayes_factor(p: Column, prior_: Column) -> Column:
    """Posterior odds over prior odds: infinite for a certain clade, 0 where only the prior is certain."""
    return F.when(p == 1, F.lit(float("inf"))).when(prior_ == 1, F.lit(0.0)).otherwise((p / (1 - p)) / (prior_ / (1 - prior_)))


def prior_counts(summary: DataFrame) -> DataFrame:
    """Adds ``prior_cnt``, found by name alone; a name that has several counts has none."""
    s = summary.groupBy("query", "name").agg(F.min("cnt").alias("_lo"), F.max("cnt").alias("_hi"))
    return summary.join(s, ["query", "name"]).withColumn("prior_cnt", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).drop("_lo", "_hi")


def unique_cutoffs(cutoffs: Column) -> Column:
    """In ascending order, each once."""
    return F.array_sort(F.array_distinct(cutoffs))


def leaf_sets(summary: DataFrame) -> DataFrame:
    """query, path, n, leaves of every node: a leaf's path is cut into its own ancestors, so there is no join on prefixes."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = leaves(summary).select("query", F.explode(up).alias("node"), "path")
    return below.groupBy("query", F.col("node").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("leaves"))


def candidates(post: DataFrame) -> DataFrame:
    """query, place, species, prob: all species of a query, the most probable first."""
    by_name = post.filter("level = 'species'").groupBy("query", F.col("name").alias("species")).agg((F.sum("cnt").cast("double") / F.max("n_trees")).alias("prob"))
    w = Window.partitionBy("query").orderBy(F.col("prob").desc(), "species")
    return by_name.withColumn("place", F.row_number().over(w)).select("query", "place", "species", "prob")


def ladder(summary: DataFrame) -> DataFrame:
    """Adds ``leaves`` and ``place``: nodes under one parent in order of their number of leaves, those with fewer first, then by path."""
    n = leaf_sets(summary).select("query", "path", F.col("n").alias("leaves"))
    w = Window.partitionBy("query", parent_path(F.col("path"))).orderBy("leaves", "path")
    return summary.join(n, ["query", "path"]).withColumn("place", F.row_number().over(w))


def level_counts(assigned: DataFrame, analysed: DataFrame) -> DataFrame:
    """How many queries have a name at a rank and cutoff, and their share of those analysed."""
    total = analysed.agg(F.count_distinct("query").alias("analysed"))
    return assigned.groupBy("cutoff", "level", "name").agg(F.count_distinct("query").alias("cnt")).crossJoin(total).withColumn("share", F.col("cnt").cast("double") / F.col("analysed"))


def assignment_table(assigned: DataFrame) -> DataFrame:
    """A row for each query and cutoff with a column for each main rank; NA where there is none."""
    wide = assigned.groupBy("query", "cutoff").pivot("level", list(L.MAIN)).agg(F.first("name"))
    return wide.select("query", "cutoff", *(F.coalesce(F.col(x), F.lit("NA")).alias(x) for x in L.MAIN))


def consensus(members: DataFrame, group: list[str]) -> DataFrame:
    """The entries that all members of a group share. members: group, member, lineage. Members without lineage do not count."""
    some = members.filter(F.size("lineage") > 0)
    size = some.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    entries = some.select(*group, F.inline("lineage")).groupBy(*group, "rank", "level", "name").agg(F.count(F.lit(1)).alias("_k"))
    kept = entries.join(size, group).filter("_k = _n")
    return kept.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "level", "name"))).alias("lineage"))


def significance_tree(post: DataFrame, cutoff: float) -> DataFrame:
    """The certain lineages of all queries as one summary, each query a leaf one rank below: path, cnt."""
    sure = significant_lineage(post, cutoff)
    parts = F.split("path", "/")
    nodes = sure.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    leaves_ = sure.select(F.concat_ws("/", "path", F.concat(F.lit("query:"), L.escaped(F.col("query")))).alias("path"))
    return nodes.unionByName(leaves_).groupBy("path").agg(F.count(F.lit(1)).alias("cnt"))


def benchmark(post: DataFrame, truth: DataFrame) -> DataFrame:
    """query, level, name, prob, correct, prob_true. truth: query, level, name. Names that end in ``sp.`` are left out."""
    best = most_probable(post).filter(~F.col("name").rlike(r"sp\.$"))
    true = truth.select("query", "level", F.col("name").alias("true_name"))
    of_true = post.join(true, ["query", "level"]).filter("name = true_name").groupBy("query", "level").agg(F.sum("prob").alias("prob_true"))
    return best.join(true, ["query", "level"]).join(of_true, ["query", "level"], "left").select("query", "level", "name", "prob", (F.col("name") == F.col("true_name")).alias("correct"), F.coalesce("prob_true", F.lit(0.0)).alias("prob_true"))
