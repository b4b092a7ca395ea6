"""Queries on lineages, summaries and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.operators import rollup as R
from cladewise.operators import selection as X
from cladewise.operators import trees as N
from cladewise.plans.adapters import FULL, PATHS, TREES, lineages, trees
from cladewise.plans.registry import query, table

WITH = f"WITH {PATHS}\n"
MAIN_ORDER = "CASE level WHEN 'phylum' THEN 1 WHEN 'class' THEN 2 WHEN 'order' THEN 3 WHEN 'family' THEN 4 WHEN 'genus' THEN 5 ELSE 6 END"


def _summary(spark, d):
    return R.summarise(lineages(spark, d))


def _post(spark, d):
    return R.posteriors(_summary(spark, d), R.tree_counts(trees(spark, d)))


@query(WITH + "SELECT query, path, depth::BIGINT AS depth, level, name, cnt::BIGINT AS cnt FROM u")
def lineage_rollup(spark, d):
    return _summary(spark, d).select("query", "path", F.col("depth").cast("long"), "level", "name", "cnt")


@query(WITH + "SELECT query, path, cnt::BIGINT AS cnt, n_trees::BIGINT AS n_trees, prob FROM post")
def posterior_by_path(spark, d):
    return _post(spark, d).select("query", "path", "cnt", "n_trees", "prob")


@query(WITH + "SELECT query, level, count(*)::BIGINT AS names, max(prob) AS highest, min(prob) AS lowest FROM post GROUP BY query, level")
def level_probs(spark, d):
    return _post(spark, d).groupBy("query", "level").agg(F.count(F.lit(1)).alias("names"), F.max("prob").alias("highest"), F.min("prob").alias("lowest"))


LEAVES = "l AS (SELECT * FROM post a WHERE NOT EXISTS (SELECT 1 FROM post b WHERE b.query = a.query AND b.depth = a.depth + 1 AND starts_with(b.path, a.path || '/')))"


@query(f"WITH {PATHS}, {LEAVES} SELECT query, path, prob FROM l")
def leaf_probs(spark, d):
    return R.leaves(_post(spark, d)).select("query", "path", "prob")


@query(f"WITH {PATHS}, {LEAVES} SELECT query, min(prob) AS lowest FROM l GROUP BY query")
def lowest_leaf_prob(spark, d):
    return R.leaves(_post(spark, d)).groupBy("query").agg(F.min("prob").alias("lowest"))


_SQL_FILL = ", ".join(f"CASE WHEN {last} >= {k} THEN coalesce({c}, 'placeHolder') END AS {c}2" for k, c in enumerate("pcofgs", 1) for last in ["CASE WHEN s IS NOT NULL THEN 6 WHEN g IS NOT NULL THEN 5 WHEN f IS NOT NULL THEN 4 WHEN o IS NOT NULL THEN 3 WHEN c IS NOT NULL THEN 2 WHEN p IS NOT NULL THEN 1 ELSE 0 END"])
_FILLED = "concat_ws('/', 'phylum:' || p2, 'class:' || c2, 'order:' || o2, 'family:' || f2, 'genus:' || g2, 'species:' || s2)"


@query(f"WITH {TREES}, x AS (SELECT *, {_SQL_FILL} FROM t) SELECT query, {_FILLED} AS path, count(*)::BIGINT AS cnt FROM x GROUP BY 1, 2")
def placeholder_densify(spark, d):
    return R.densify(lineages(spark, d), L.MAIN).groupBy("query", L.path(F.col("lineage")).alias("path")).agg(F.count(F.lit(1)).alias("cnt"))


# Only the class and the family can be missing: two steps of the general rule, written out.
def _consolidated(level: float) -> str:
    return f"""WITH {TREES}, m AS (SELECT * FROM t WHERE p IS NOT NULL),
cc AS (SELECT query, p, count(*) FILTER (WHERE c IS NULL) AS fill, count(*) FILTER (WHERE c IS NOT NULL) AS own FROM m GROUP BY ALL),
a AS (SELECT m.*, cc.fill > 0 AND NOT cc.fill < cc.own * {level} AS c_gone, cc.fill > 0 AND cc.fill < cc.own * {level} AND c IS NULL AS c_cut FROM m JOIN cc ON cc.query = m.query AND cc.p = m.p),
b AS (SELECT *, CASE WHEN c_gone THEN NULL ELSE c END AS c3, CASE WHEN c_cut THEN NULL ELSE o END AS o3 FROM a),
ff AS (SELECT query, p, c3, o3, count(*) FILTER (WHERE f IS NULL) AS fill, count(*) FILTER (WHERE f IS NOT NULL) AS own FROM b WHERE NOT c_cut GROUP BY ALL),
x AS (SELECT b.*, ff.fill > 0 AND NOT ff.fill < ff.own * {level} AS f_gone, ff.fill > 0 AND ff.fill < ff.own * {level} AND f IS NULL AS f_cut FROM b LEFT JOIN ff ON NOT c_cut AND ff.query = b.query AND ff.p = b.p AND ff.c3 IS NOT DISTINCT FROM b.c3 AND ff.o3 = b.o3),
y AS (SELECT query, concat_ws('/', 'phylum:' || p, 'class:' || c3, CASE WHEN NOT c_cut THEN 'order:' || o3 END, CASE WHEN NOT c_cut AND NOT f_gone THEN 'family:' || f END,
  CASE WHEN NOT c_cut AND NOT f_cut THEN 'genus:' || g END, CASE WHEN NOT c_cut AND NOT f_cut THEN 'species:' || s END) AS path FROM x
  UNION ALL SELECT query, '' FROM t WHERE p IS NULL)
SELECT query, path, count(*)::BIGINT AS cnt FROM y GROUP BY query, path"""


@query(_consolidated(0.0))
def collapse_rank(spark, d):
    return R.consolidate(lineages(spark, d), L.MAIN, 0.0).groupBy("query", L.path(F.col("lineage")).alias("path")).agg(F.sum("cnt").alias("cnt"))


@query(_consolidated(0.5))
def prune_placeholder(spark, d):
    return R.consolidate(lineages(spark, d), L.MAIN, 0.5).groupBy("query", L.path(F.col("lineage")).alias("path")).agg(F.sum("cnt").alias("cnt"))


def _repaired() -> str:
    own = "v AS (SELECT query, path, depth, CASE WHEN depth IN (1, 3) THEN cnt // 3 ELSE cnt END AS cnt FROM u), r6 AS (SELECT * FROM v WHERE depth = 6)"
    steps = "".join(f", r{k} AS (SELECT v.query, v.path, v.depth, greatest(v.cnt, coalesce(b.s, 0)) AS cnt FROM v LEFT JOIN (SELECT query, regexp_replace(path, '/[^/]*$', '') AS up, sum(cnt) AS s FROM r{k + 1} GROUP BY 1, 2) b ON b.query = v.query AND b.up = v.path WHERE v.depth = {k})" for k in range(5, 0, -1))
    return f"WITH {PATHS}, {own}{steps} " + " UNION ALL ".join(f"SELECT query, path, cnt::BIGINT AS cnt FROM r{k}" for k in range(1, 7))


@query(_repaired())
def count_repair(spark, d):
    """The counts of the first and third rank are cut to a third, so that parents count less than their children, and mended."""
    low = F.when(F.col("depth").isin(1, 3), F.floor(F.col("cnt") / 3)).otherwise(F.col("cnt"))
    return R.repair(_summary(spark, d).withColumn("cnt", low)).select("query", "path", "cnt")


@query(f"WITH {TREES} SELECT query, coalesce({FULL}, '') AS lineage, count(*)::BIGINT AS cnt, count(*) FILTER (WHERE s IS NOT NULL)::BIGINT AS complete FROM t GROUP BY 1, 2")
def monophyly_counts(spark, d):
    x = lineages(spark, d)
    return x.groupBy("query", L.path(F.col("lineage")).alias("lineage")).agg(F.count(F.lit(1)).alias("cnt"), F.count_if(L.name_at(F.col("lineage"), "species").isNotNull()).alias("complete"))


_CUTS = "k(cutoff) AS (VALUES (30), (50), (60))"
_SIG = f"""{PATHS}, {_CUTS},
f AS (SELECT query, cutoff, level, name, prob FROM post CROSS JOIN k WHERE prob >= cutoff / 100.0::DOUBLE),
h AS (SELECT *, max((level IN ('order', 'family'))::INT) OVER w = 1 AND max((level = 'genus')::INT) OVER w = 1 AS gen FROM f WINDOW w AS (PARTITION BY query, cutoff)),
sig AS (SELECT query, cutoff::BIGINT AS cutoff, level, name, prob FROM h WHERE level NOT IN ('genus', 'species') OR gen)"""


def _significant(spark, d):
    cuts = spark.createDataFrame([(30,), (50,), (60,)], "cutoff long")
    return R.significant_ranks(_post(spark, d), cuts)


@query(f"WITH {_SIG} SELECT * FROM sig")
def significant_ranks(spark, d):
    return _significant(spark, d)


@query(f"WITH {_SIG} SELECT cutoff, count(*)::BIGINT AS rows, count(DISTINCT query)::BIGINT AS queries FROM sig GROUP BY cutoff")
def ppcutoff_multi(spark, d):
    return _significant(spark, d).groupBy("cutoff").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("query").alias("queries"))


@query(f"WITH {_SIG} SELECT cutoff, level, name, count(DISTINCT query)::BIGINT AS cnt, (SELECT count(DISTINCT query) FROM t)::BIGINT AS analysed, count(DISTINCT query)::DOUBLE / (SELECT count(DISTINCT query) FROM t) AS share FROM sig GROUP BY cutoff, level, name")
def level_counts_norm(spark, d):
    return R.level_counts(_significant(spark, d), trees(spark, d))


_FIRST = ", ".join(f"coalesce(min(CASE WHEN level = '{x}' THEN name END), 'NA') AS \"{x}\"" for x in L.MAIN)


@query(f"WITH {_SIG} SELECT query, cutoff, {_FIRST} FROM (SELECT * FROM sig WHERE cutoff >= 50) GROUP BY query, cutoff")
def assignment_pivot(spark, d):
    return R.assignment_table(_significant(spark, d).filter("cutoff >= 50"))


@query(f"WITH {_SIG} SELECT count(DISTINCT query)::BIGINT AS identified FROM sig WHERE cutoff = 50")
def identified_total(spark, d):
    return _significant(spark, d).filter("cutoff = 50").agg(F.count_distinct("query").alias("identified"))


_BEST = f"""{PATHS}, h AS (SELECT *, bool_or(level IN ('order', 'family')) OVER w AS gen, bool_or(level = 'genus') OVER w AS spe FROM post WINDOW w AS (PARTITION BY query)),
b AS (SELECT query, level, name, prob, row_number() OVER (PARTITION BY query, level ORDER BY prob DESC, name, path) AS i FROM h WHERE NOT (level = 'genus' AND NOT gen) AND NOT (level = 'species' AND NOT (gen AND spe)))"""


@query(f"WITH {_BEST} SELECT query, level, name, prob FROM b WHERE i = 1")
def most_probable_names(spark, d):
    return R.most_probable(_post(spark, d))


@query(f"WITH {_BEST} SELECT query, name AS species, prob FROM b WHERE i = 1 AND level = 'species'")
def species_prob_argmax(spark, d):
    return R.most_probable(_post(spark, d)).filter("level = 'species'").select("query", F.col("name").alias("species"), "prob")


@query(f"WITH {PATHS} SELECT query, level, name, sum(prob_cnt)::BIGINT AS cnt, sum(prob_cnt)::DOUBLE / any_value(n_trees) AS prob FROM (SELECT query, level, name, cnt AS prob_cnt, n_trees FROM post) GROUP BY query, level, name")
def taxon_probability_table(spark, d):
    """Probability of a name at a rank, over all paths to it."""
    p = _post(spark, d).groupBy("query", "level", "name").agg(F.sum("cnt").alias("cnt"), F.first("n_trees").alias("n"))
    return p.select("query", "level", "name", "cnt", (F.col("cnt").cast("double") / F.col("n")).alias("prob"))


@query(f"WITH {PATHS}, z AS (SELECT query, path, depth, row_number() OVER (PARTITION BY query ORDER BY depth DESC) AS i FROM post WHERE prob >= 0.55) SELECT query, path, depth::BIGINT AS depth FROM z WHERE i = 1")
def significant_lineage(spark, d):
    return R.significant_lineage(_post(spark, d), 0.55).select("query", "path", F.col("depth").cast("long"))


@query(f"""WITH {PATHS}, w AS (SELECT query, path, level, prob, cnt, n_trees, CASE WHEN cnt = n_trees THEN 1.0::DOUBLE ELSE (2 * cnt - 1)::DOUBLE / (2 * n_trees - 3) END AS prior FROM post)
SELECT query, path, prior, CASE WHEN prob = 1 THEN 'Infinity'::DOUBLE WHEN prior = 1 THEN 0.0 ELSE prob / (1 - prob) / (prior / (1 - prior)) END AS factor FROM w""")
def prior_bayes_factor(spark, d):
    p = _post(spark, d).withColumn("prior", R.prior(F.col("cnt"), F.col("n_trees")))
    return p.select("query", "path", "prior", R.bayes_factor(F.col("prob"), F.col("prior")).alias("factor"))


@query(f"WITH {PATHS} SELECT query, path, cnt::BIGINT AS cnt FROM u")
def summary_merge(spark, d):
    """Summaries of the orders with and without a family, merged, are the summary of all."""
    x = lineages(spark, d)
    has = F.coalesce(F.exists("lineage", lambda e: e["level"] == "family"), F.lit(False))
    return R.merge_summaries(R.summarise(x.filter(has)), R.summarise(x.filter(~has))).select("query", "path", "cnt")


@query(f"""WITH {PATHS}, s AS (SELECT query, name, min(cnt) AS lo, max(cnt) AS hi FROM u GROUP BY query, name)
SELECT u.query, u.path, u.cnt::BIGINT AS cnt, CASE WHEN lo = hi THEN lo END::BIGINT AS prior_cnt FROM u JOIN s ON s.query = u.query AND s.name = u.name""")
def prior_by_name(spark, d):
    """Prior counts are joined by name alone; a name with several counts has none."""
    return R.prior_counts(_summary(spark, d)).select("query", "path", "cnt", "prior_cnt")


@query(f"WITH {PATHS} SELECT query, name, count(*)::BIGINT AS nodes, sum(cnt)::BIGINT AS cnt FROM u GROUP BY query, name")
def taxon_count_lookup(spark, d):
    return _summary(spark, d).groupBy("query", "name").agg(F.count(F.lit(1)).alias("nodes"), F.sum("cnt").alias("cnt"))


# Lineages of customers.
_CUST = """
m AS (SELECT c_custkey, r_name AS p, n_name AS c, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS o, s.s_name AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey)"""


def _customers(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    o = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return x.select("c_custkey", F.col("r_name").alias("p"), F.col("n_name").alias("c"), o.alias("o"), L.from_columns(phylum=F.col("r_name"), **{"class": F.col("n_name")}, order=o).alias("lineage"))


_TEXT = "concat_ws(', ', 'phylum: ' || p, 'class: ' || c, 'order: ' || o)"


@query(f"WITH {_CUST} SELECT c_custkey, {_TEXT} AS lineage FROM m")
def lineage_render(spark, d):
    return _customers(spark, d).select("c_custkey", L.render(F.col("lineage")).alias("lineage"))


@query(f"WITH {_CUST} SELECT c_custkey, p AS phylum, c AS class, o AS \"order\", (2 + (o IS NOT NULL)::INT)::BIGINT AS size FROM m")
def lineage_parse(spark, d):
    """Rendered and parsed again."""
    x = _customers(spark, d).select("c_custkey", L.parse(L.render(F.col("lineage"))).alias("l"))
    return x.select("c_custkey", *(L.name_at(F.col("l"), k).alias(k) for k in ("phylum", "class", "order")), F.size("l").cast("long").alias("size"))


@query(f"WITH {_CUST} SELECT c_custkey, coalesce(o, 'none') AS at_order, 'class' AS level_of_class, o IS NOT NULL AND o = 'BUILDING' AS has_building, concat_ws('/', 'phylum:' || p, 'order:' || o) AS without_class FROM m")
def lineage_accessors(spark, d):
    x = _customers(spark, d)
    l = F.col("lineage")  # noqa: E741
    return x.select("c_custkey", F.coalesce(L.name_at(l, "order"), F.lit("none")).alias("at_order"), L.level_of(l, F.col("c")).alias("level_of_class"), L.contains(l, F.lit("BUILDING")).alias("has_building"), L.path(L.without(l, "class")).alias("without_class"))


@query(f"WITH {TREES} SELECT query, tree_no FROM t WHERE (p IS NOT NULL)::INT + (c IS NOT NULL)::INT + (o IS NOT NULL)::INT + (f IS NOT NULL)::INT + (g IS NOT NULL)::INT + (s IS NOT NULL)::INT >= 5")
def minimal_taxonomy(spark, d):
    return lineages(spark, d).filter(L.minimal(F.col("lineage"))).select("query", "tree_no")


_LAG = f"{TREES}, g2 AS (SELECT *, lead(p) OVER w AS p2, lead(c) OVER w AS c2, lead(o) OVER w AS o2, lead(f) OVER w AS f2, lead(g) OVER w AS g3, lead(s) OVER w AS s2, lead(tree_no) OVER w AS next FROM t WINDOW w AS (PARTITION BY query ORDER BY tree_no))"
_BOTH = "concat_ws('/', CASE WHEN p = p2 THEN 'phylum:' || p END, CASE WHEN c = c2 THEN 'class:' || c END, CASE WHEN o = o2 THEN 'order:' || o END, CASE WHEN f = f2 THEN 'family:' || f END, CASE WHEN g = g3 THEN 'genus:' || g END, CASE WHEN s = s2 THEN 'species:' || s END)"


def _pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy("tree_no")
    return lineages(spark, d).withColumn("other", F.lead("lineage").over(w)).filter(F.col("other").isNotNull())


@query(f"WITH {_LAG} SELECT query, tree_no, {_BOTH} AS common FROM g2 WHERE next IS NOT NULL")
def consensus_pair(spark, d):
    return _pairs(spark, d).select("query", "tree_no", L.path(L.common(F.col("lineage"), F.col("other"))).alias("common"))


def _size(cols: str) -> str:
    return " + ".join(f"({c} IS NOT NULL)::INT" for c in cols.split())


@query(f"WITH {_LAG}, v AS (SELECT *, {_size('p c o f g s')} AS a, {_size('p2 c2 o2 f2 g3 s2')} AS b FROM g2 WHERE next IS NOT NULL) SELECT query, tree_no, CASE WHEN a > b THEN {FULL} WHEN b > a THEN concat_ws('/', 'phylum:' || p2, 'class:' || c2, 'order:' || o2, 'family:' || f2, 'genus:' || g3, 'species:' || s2) ELSE {_BOTH} END AS chosen FROM v")
def more_specific_consensus(spark, d):
    return _pairs(spark, d).select("query", "tree_no", L.path(L.more_specific(F.col("lineage"), F.col("other"))).alias("chosen"))


_PART = """li AS (SELECT l_orderkey, p_partkey, split_part(p_type, ' ', 1) AS a, CASE WHEN p_size > 5 THEN p_brand END AS b, p_name AS c FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _items(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(p, li.l_partkey == p.p_partkey)
    return x.select("l_orderkey", "p_partkey", L.from_columns(order=F.split("p_type", " ")[0], family=F.when(F.col("p_size") > 5, F.col("p_brand")), genus=F.col("p_name")).alias("lineage"))


@query(f"""WITH {_PART}, k AS (SELECT l_orderkey, count(*) AS n, count(a) AS na, count(DISTINCT a) AS da, min(a) AS a, count(b) AS nb, count(DISTINCT b) AS db, min(b) AS b, count(c) AS nc, count(DISTINCT c) AS dc, min(c) AS c FROM li GROUP BY 1),
v AS (SELECT l_orderkey, concat_ws('/', CASE WHEN na = n AND da = 1 THEN 'order:' || a END, CASE WHEN nb = n AND db = 1 THEN 'family:' || b END, CASE WHEN nc = n AND dc = 1 THEN 'genus:' || c END) AS consensus FROM k)
SELECT * FROM v WHERE consensus <> ''""")
def consensus_group(spark, d):
    """What the parts of an order have in common."""
    return R.consensus(_items(spark, d), ["l_orderkey"]).select("l_orderkey", L.path(F.col("lineage")).alias("consensus"))


# An order is a tree, its suppliers the sister group of the one query.
_OCC = "oc AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY 1), nt AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)"


def _occurrence(spark, d):
    li = table(spark, d, "lineitem")
    sisters = li.groupBy(F.lit("all").alias("query"), F.col("l_orderkey").alias("rep")).agg(F.collect_set("l_suppkey").alias("sister"))  # the lines of one order
    n = li.groupBy(F.lit("all").alias("query")).agg(F.count_distinct("l_orderkey").alias("n_trees"))
    return N.occurrence_share(N.sister_occurrence(sisters), n)


@query(f"WITH {_OCC} SELECT l_suppkey, cnt::BIGINT AS cnt, cnt::DOUBLE / n AS share FROM oc CROSS JOIN nt")
def homolog_occurrence(spark, d):
    return _occurrence(spark, d).select(F.col("name").alias("l_suppkey"), "cnt", "share")


@query(f"WITH {_OCC} SELECT min(cnt)::DOUBLE / any_value(n) AS lowest FROM oc CROSS JOIN nt")
def lowest_homolog_prob(spark, d):
    return N.lowest_share(_occurrence(spark, d)).select("lowest")


@query("SELECT s_nationkey::BIGINT AS s_nationkey, count(*)::BIGINT AS known, count(l.l_suppkey)::BIGINT AS seen, count(l.l_suppkey) < count(*) AS exhausted FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) l ON l_suppkey = s_suppkey GROUP BY 1")
def db_exhausted(spark, d):
    seen = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("id"))
    known = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("s_suppkey").alias("id"))
    return X.exhaustion(known, seen, "id", "s_nationkey").withColumnRenamed("not_reached", "exhausted")


@query("WITH x AS (SELECT l_returnflag, l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS clade FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, clade, count(*)::DOUBLE / 1000 AS support FROM x GROUP BY 1, 2")
def clade_support(spark, d):
    """The suppliers of an order under one return flag are a clade of that flag's tree number (the order's key), for a thousand replicates."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("query"), F.col("l_orderkey").alias("rep")).agg(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))).alias("clade"))
    return N.clade_support(x, 1000).select(F.col("query").alias("l_returnflag"), "clade", "support")


@query("WITH x AS (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s, l_orderkey FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R') SELECT f AS flag, s AS clade, count(*)::DOUBLE / any_value(n)::DOUBLE AS support FROM x, n GROUP BY 1, 2 HAVING count(*)::DOUBLE / any_value(n)::DOUBLE > 0.5")
def majority_consensus(spark, d):
    """Line statuses as clades of one name, in over half of as many trees as there are orders with returned lines."""
    li = table(spark, d, "lineitem")
    n = li.filter("l_returnflag = 'R'").agg(F.count_distinct("l_orderkey")).first()[0]
    x = li.select(F.col("l_returnflag").alias("query"), F.col("l_orderkey").alias("rep"), F.array("l_linestatus").alias("clade"))
    return N.majority_clades(x, max(1, n)).select(F.col("query").alias("flag"), "clade", "support")


@query(f"WITH {PATHS}, {LEAVES}, a AS (SELECT DISTINCT e.query, e.path, l.path AS leaf FROM u e JOIN l ON l.query = e.query AND (l.path = e.path OR starts_with(l.path, e.path || '/'))) SELECT query, path, count(*)::BIGINT AS leaves FROM a GROUP BY query, path")
def partition_list(spark, d):
    return R.leaf_sets(_summary(spark, d)).select("query", "path", F.col("n").alias("leaves"))


@query(f"WITH {PATHS}, {LEAVES}, a AS (SELECT DISTINCT e.query, e.path, l.path AS leaf FROM u e JOIN l ON l.query = e.query AND (l.path = e.path OR starts_with(l.path, e.path || '/'))) SELECT query, path, string_agg(leaf, '|' ORDER BY leaf) AS leaves FROM a GROUP BY query, path")
def leaf_sets(spark, d):
    """The leaves below each node of a query's summary."""
    return R.leaf_sets(_summary(spark, d)).select("query", "path", F.array_join("leaves", "|").alias("leaves"))
