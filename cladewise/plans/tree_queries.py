"""Queries on trees that are written to files and read back: clades, consensus, monophyly, rooting, sister groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.operators import tree_sets as M
from cladewise.operators import trees as N
from cladewise.operators.lineage_cut import cut, new_path
from cladewise.plans.registry import query, table
from cladewise.sources import newick

#: Three trees over six leaves; a part's size says which is its own.
SHAPES = ("((1:1,2:2):0.5,(3:1,(4:1,5:1):{n}):1,6:3)", "((1,3),(2,4)[a remark],('5',6))", "(((1:1,2:1):{n},3:1):2,(4:1,5:1):1,6:1)")
LEAVES = ("a1_Alpha", "b2_Beta", "c3_Gamma", "d4_Delta", "e5_Epsilon", "f6_Zeta")
CLADES = (("ab", "cde", "de"), ("ac", "bd", "ef"), ("abc", "ab", "de"))
_KIND = "CASE WHEN p_size <= 25 THEN 0 WHEN p_size <= 40 THEN 2 ELSE 1 END"


def _brands(spark, d):
    """Parsed trees of every part, by brand: written as one Nexus file for each brand and read back. The tree's name is the part's key."""
    kind = F.when(F.col("p_size") <= 25, 0).when(F.col("p_size") <= 40, 2).otherwise(1)
    text = F.when(kind == 0, F.lit(SHAPES[0])).when(kind == 1, F.lit(SHAPES[1])).otherwise(F.lit(SHAPES[2]))
    line = F.concat(F.lit("   tree part_"), F.col("p_partkey").cast("string"), F.lit(" = [&U] "), F.replace(text, F.lit("{n}"), F.col("p_size").cast("string")), F.lit(";"))
    head = "#NEXUS\n\nbegin trees;\n   translate\n" + ",\n".join(f"       {i} {x}" for i, x in enumerate(LEAVES, 1)) + ";\n"
    # Trees of a brand are dealt over a few files, each whole in itself.
    files = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 4).alias("piece"), line.alias("line"))
    whole = files.groupBy("p_brand", "piece").agg(F.concat(F.lit(head), F.array_join(F.collect_list("line"), "\n"), F.lit("\nend;")).alias("value"))
    path = new_path(spark, "trees")
    whole.select("p_brand", "piece", "value").write.partitionBy("p_brand", "piece").text(path)
    found = newick.nexus_trees(spark, path)
    return cut(found.withColumn("query", F.url_decode(F.url_decode(F.regexp_extract("query", "p_brand=([^/]+)", 1)))))


_LETTER = {x[0]: x for x in LEAVES}
_VALUES = ", ".join(f"({k}, [{', '.join(repr(_LETTER[x]) for x in c)}])" for k, row in enumerate(CLADES) for c in row)
_TREES = f"t AS (SELECT p_brand AS query, p_partkey, {_KIND} AS kind FROM part), c(kind, clade) AS (VALUES {_VALUES})"


@query(f"WITH {_TREES} SELECT query, p_partkey, array_to_string(clade, ',') AS clade FROM t JOIN c ON c.kind = t.kind")
def tree_file_clades(spark, d):
    """Clades of all trees read from files, numbers translated to names."""
    x = _brands(spark, d).filter("problem is null").select("query", F.regexp_extract("tree_name", r"part_(\d+)", 1).cast("long").alias("p_partkey"), "leaves", F.explode("clades").alias("c"))
    return x.select("query", "p_partkey", F.array_join(N.named(F.col("c"), F.col("leaves")), ",").alias("clade"))


@query(f"""WITH {_TREES}, n AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2 FROM t GROUP BY 1),
s AS (SELECT *, ((n0 + n2) * 100 // n)::VARCHAR AS p, (n0 * 100 // n)::VARCHAR AS p0, (n1 * 100 // n)::VARCHAR AS p1, (n2 * 100 // n)::VARCHAR AS p2 FROM n)
SELECT query, CASE WHEN 2 * n1 > n THEN '((a1_Alpha,c3_Gamma)' || p1 || ',(b2_Beta,d4_Delta)' || p1 || ',(e5_Epsilon,f6_Zeta)' || p1 || ');'
  WHEN 2 * (n0 + n2) <= n THEN '(a1_Alpha,b2_Beta,c3_Gamma,d4_Delta,e5_Epsilon,f6_Zeta);'
  WHEN 2 * n0 > n THEN '((a1_Alpha,b2_Beta)' || p || ',(c3_Gamma,(d4_Delta,e5_Epsilon)' || p || ')' || p0 || ',f6_Zeta);'
  WHEN 2 * n2 > n THEN '(((a1_Alpha,b2_Beta)' || p || ',c3_Gamma)' || p2 || ',(d4_Delta,e5_Epsilon)' || p || ',f6_Zeta);'
  ELSE '((a1_Alpha,b2_Beta)' || p || ',c3_Gamma,(d4_Delta,e5_Epsilon)' || p || ',f6_Zeta);' END AS newick FROM s""")
def consensus_tree(spark, d):
    """The majority-rule consensus of each brand's trees, as nested text with support."""
    x = _brands(spark, d)
    return M.consensus_newick(x, M.tree_leaves(x))


GROUPS = {"order": {"Low": "ab", "High": "def"}, "family": {"One": "cde", "Two": "de", "Three": "abc", "Four": "abd"}, "genus": {"Solo": "a", "All": "abcdef", "Five": "abcde"}}
_GROUPS = ", ".join(f"('{lv}', '{name}', '{','.join(_LETTER[x] for x in who)}', '{','.join(_LETTER[x] for x in 'abcdef' if x not in who)}', {len(who)})" for lv, names in GROUPS.items() for name, who in names.items())


def _monophyly(rooted: bool) -> str:
    alone = "size IN (1, 6)" if rooted else "size IN (1, 5, 6)"
    other = "" if rooted else " OR array_to_string(clade, ',') = rest"
    return f"""WITH {_TREES}, g(level, name, who, rest, size) AS (VALUES {_GROUPS}), k AS (SELECT DISTINCT level, name, kind FROM g JOIN c ON array_to_string(clade, ',') = who{other}),
n AS (SELECT query, count(*) AS n_trees FROM t GROUP BY 1), f AS (SELECT query, level, name, count(*) AS n FROM t JOIN k ON k.kind = t.kind GROUP BY 1, 2, 3)
SELECT n.query, g.level, g.name, size::BIGINT AS size, CASE WHEN {alone} THEN n_trees ELSE coalesce(f.n, 0) END::BIGINT AS n, n_trees::BIGINT AS n_trees FROM n CROSS JOIN g LEFT JOIN f ON f.query = n.query AND f.level = g.level AND f.name = g.name"""


def _grouped(spark, d, rooted: bool):
    x = _brands(spark, d)
    leaves = M.tree_leaves(x)
    rows = [(lv, name, _LETTER[w]) for lv, names in GROUPS.items() for name, who in names.items() for w in who]
    groups = leaves.select("query").crossJoin(spark.createDataFrame(rows, "level string, name string, leaf string"))  # a list of options for each query
    whole = lambda c: F.col(c).cast("long").alias(c)
    return M.monophyly(x, groups, leaves, rooted).select("query", "level", "name", whole("size"), whole("n"), whole("n_trees"))


@query(_monophyly(True))
def monophyly_map(spark, d):
    """In how many of a brand's trees each group of leaves is a clade."""
    return _grouped(spark, d, True)


@query(_monophyly(False))
def monophyly_unrooted(spark, d):
    """The same without regard to the root: a group counts if the others are a clade."""
    return _grouped(spark, d, False)


_OUT = ", ".join(f"({k}, '{','.join(_LETTER[x] for x in c)}')" for k, c in [(0, "ab"), (0, "cdef"), (0, "cde"), (0, "de"), (2, "ab"), (2, "cdef"), (2, "def"), (2, "de")])


@query(f"WITH {_TREES}, r(kind, clade) AS (VALUES {_OUT}) SELECT query, clade, count(*)::BIGINT AS n FROM t JOIN r ON r.kind = t.kind GROUP BY 1, 2")
def rooted_clades(spark, d):
    """Clades of the trees that can be rooted beside the first two leaves, counted by brand."""
    x = _brands(spark, d)
    leaves = M.tree_leaves(x)
    out = leaves.select("query", F.explode(F.array(*map(F.lit, LEAVES[:2]))).alias("name"))
    rooted = M.rooted_by(x, leaves, out).filter("clades is not null")
    return M.clade_counts(rooted).join(leaves, "query").select("query", F.array_join(N.named(F.col("clade"), F.col("names")), ",").alias("clade"), "n")


_SISTERS = ", ".join(f"({k}, '{','.join(_LETTER[x] for x in s)}')" for k, s in [(0, "a"), (0, "cdef"), (1, "d"), (1, "acef"), (2, "a"), (2, "cdef")])


@query(f"WITH {_TREES}, r(kind, sister) AS (VALUES {_SISTERS}) SELECT query, sister, count(*)::BIGINT AS n FROM t JOIN r ON r.kind = t.kind GROUP BY 1, 2")
def tree_file_sisters(spark, d):
    """What stands beside the second leaf in trees read from files, for either rooting, counted by brand."""
    x = _brands(spark, d)
    leaves = M.tree_leaves(x).withColumn("leaf", F.lit(LEAVES[1]))
    sets = N.sister_sets(x.filter("problem is null"), leaves).groupBy("query", "sister").agg(F.count(F.lit(1)).alias("n"))
    return sets.join(leaves, "query").select("query", F.array_join(N.named(F.col("sister"), F.col("names")), ",").alias("sister"), "n")
