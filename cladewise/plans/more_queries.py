"""Queries on option lists, partitions, taxonomy records and benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.functions import sequence as S
from cladewise.operators import rollup as R
from cladewise.operators import selection as X
from cladewise.operators import trees as N
from cladewise.operators.lineage_cut import new_path
from cladewise.plans.adapters import PATHS, lineages, trees
from cladewise.plans.registry import query, table
from cladewise.sources import database
from cladewise.sources.files import TAXON, sequence_records, taxonomy_rejects, taxonomy_rows, with_taxonomy
from cladewise.sources.sinks import dealt, write_xml


def _post(spark, d):
    return R.posteriors(R.summarise(lineages(spark, d)), R.tree_counts(trees(spark, d)))


@query(f"""WITH {PATHS}, z AS (SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY depth DESC) AS i FROM post WHERE prob >= 0.55),
l AS (SELECT query, path, string_split(path, '/') AS p FROM z WHERE i = 1), x AS (SELECT array_to_string(p[1:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM l) UNION ALL SELECT path || '/query:' || query FROM l)
SELECT path, count(*)::BIGINT AS cnt FROM x GROUP BY path""")
def significance_tree(spark, d):
    return R.significance_tree(_post(spark, d), 0.55)


@query(f"""WITH {PATHS}, b AS (SELECT query, level, name, prob, row_number() OVER (PARTITION BY query, level ORDER BY prob DESC, name, path) AS i FROM post),
w AS (SELECT DISTINCT n_name || ' ' || c_mktsegment AS query, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey),
y AS (SELECT query, 'phylum' AS level, r_name AS tn FROM w UNION ALL SELECT query, 'class', n_name FROM w UNION ALL SELECT query, 'order', c_mktsegment FROM w),
s AS (SELECT post.query, post.level, sum(cnt)::BIGINT AS c FROM post JOIN y ON y.query = post.query AND y.level = post.level AND y.tn = post.name GROUP BY 1, 2)
SELECT b.query, b.level, b.name, b.name = tn AS correct FROM b JOIN y ON y.query = b.query AND y.level = b.level LEFT JOIN s ON s.query = b.query AND s.level = b.level WHERE i = 1 AND NOT regexp_matches(name, 'sp\\.$')""")
def benchmark_stats(spark, d):
    """The most probable names against the true ones, which the query itself tells."""
    c, n, r, o = (table(spark, d, x) for x in ("customer", "nation", "region", "orders"))
    w = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    truth = w.select(F.concat_ws(" ", "n_name", "c_mktsegment").alias("query"), F.inline(F.array(*(F.struct(F.lit(k).alias("level"), F.col(v).alias("name")) for k, v in (("phylum", "r_name"), ("class", "n_name"), ("order", "c_mktsegment")))))).distinct()
    return R.benchmark(_post(spark, d), truth).select("query", "level", "name", "correct")


@query("SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_partkey <> a.p_partkey AND contains(lower(b.p_name), lower(a.p_name)))")
def reverse_containment(spark, d):
    """Parts that no other part of the same brand and type contains by name: what a forced inclusion leaves."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.col("p_name").alias("seq"))
    return X.not_contained(p, p, ["p_brand", "p_type"]).select(F.col("id").alias("p_partkey"))


@query("""WITH s AS (SELECT n_regionkey AS r, list_sort(list(n_name)) AS inside FROM nation GROUP BY 1), a AS (SELECT r.r_regionkey AS r, list_sort(list(n_name)) AS outside FROM region r JOIN nation n ON n.n_regionkey <> r.r_regionkey GROUP BY 1)
SELECT s.r::BIGINT AS region, len(s.inside)::BIGINT AS inside, len(a.outside)::BIGINT AS outside, NOT list_has_any(s.inside, a.outside) AND len(s.inside) + len(a.outside) = (SELECT count(*) FROM nation) AS complementary FROM s JOIN a ON a.r = s.r""")
def complement_partitions(spark, d):
    """Each region's nations and those of all the others, two sides of one split. Regions and nations are fixed lists."""
    n, r = table(spark, d, "nation"), table(spark, d, "region").select(F.col("r_regionkey").alias("r"))
    side = lambda where, name: r.join(n, where).groupBy("r").agg(F.collect_set("n_name").alias(name))
    x = side(F.col("r") == F.col("n_regionkey"), "inside").join(side(F.col("r") != F.col("n_regionkey"), "outside"), "r").crossJoin(n.agg(F.collect_set("n_name").alias("every")))
    return x.select(F.col("r").cast("long").alias("region"), F.size("inside").cast("long").alias("inside"), F.size("outside").cast("long").alias("outside"), N.complementary(F.col("inside"), F.col("outside"), F.col("every")).alias("complementary"))


@query("SELECT c_nationkey::BIGINT AS nation, count(*)::BIGINT AS kept FROM customer WHERE c_acctbal > 5000 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def include_minus_exclude(spark, d):
    """Forced ids without excluded ones, counted by nation."""
    c = table(spark, d, "customer")
    kept = X.include_minus_exclude(c.filter("c_acctbal > 5000"), c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), "c_custkey")
    return kept.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT n_regionkey::BIGINT AS region, list_sort(list(DISTINCT length(n_name)))::BIGINT[] AS cutoffs FROM nation GROUP BY 1")
def unique_cutoffs(spark, d):
    n = table(spark, d, "nation")
    return n.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.collect_list(F.length("n_name").cast("long")).alias("c")).select("region", R.unique_cutoffs(F.col("c")).alias("cutoffs"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice >= 50000 THEN o_orderpriority END AS genus FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, genus ORDER BY o_orderkey) AS i FROM o)
SELECT o_orderkey, genus IS NULL OR i = 1 AS novel FROM r""")
def null_is_novel(spark, d):
    """A hit without a genus always counts as a new one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_orderpriority")).alias("genus"))
    return X.novel(o, ["o_custkey"], "genus", ["o_orderkey"]).select("o_orderkey", "novel")


_TAXON_SQL = "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _taxa(spark, d, mark=None):
    """Suppliers as taxonomy XML, read back."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    taxon = lambda rank, name: F.concat(F.lit("<Taxon><TaxId>1</TaxId><ScientificName>"), name, F.lit(f"</ScientificName><Rank>{rank}</Rank></Taxon>"))
    lineage = F.concat(taxon("no rank", F.lit("root: all")), taxon("kingdom", F.col("r_name")), taxon("phylum", F.concat("n_name", F.lit("") if mark is None else mark)), taxon("phylum", F.lit("Again")), F.when(F.col("s_acctbal") >= 0, taxon("order", F.lit("Rich"))).otherwise(taxon("order", F.lit("unclassified, poor"))))
    xml = F.concat(F.lit("<Taxon><TaxId>"), F.col("s_suppkey").cast("string"), F.lit("</TaxId><ScientificName>"), F.col("s_name"), F.lit("</ScientificName><LineageEx>"), lineage, F.lit("</LineageEx></Taxon>"))
    return x.select(F.from_xml(xml, TAXON).alias("t")).select("t.*")


@query(f"""SELECT s_suppkey::VARCHAR AS taxid, regexp_replace(s_name, '[^A-Za-z0-9_\\s]', '_', 'g') AS organism, 'kingdom:' || r_name || '/phylum:' || n_name || CASE WHEN s_acctbal >= 0 THEN '/order:Rich' ELSE '' END || '/species:' || regexp_extract(s_name, '^\\S+( \\S+)?') AS path, false AS complete
{_TAXON_SQL}""")
def taxonomy_parse(spark, d):
    """Ranks that say nothing go, a second name of a rank goes, the species comes from the name."""
    return taxonomy_rows(_taxa(spark, d)).select("taxid", "organism", L.path(F.col("lineage")).alias("path"), "complete")


@query(f"SELECT s_suppkey::VARCHAR AS taxid, s_name AS organism, [n_name || CASE s_suppkey % 4 WHEN 1 THEN ': x' WHEN 2 THEN ';' ELSE ', y' END] AS names {_TAXON_SQL} WHERE s_suppkey % 4 <> 0")
def taxonomy_reject_list(spark, d):
    """Records with marks in a name that counts are rejected, and the names told."""
    k = F.col("s_suppkey") % 4
    return taxonomy_rejects(_taxa(spark, d, F.when(k == 0, "").when(k == 1, ": x").when(k == 2, ";").otherwise(", y")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN round(l_discount * 100) < 1 THEN '~0%' ELSE round(l_discount * 100)::INT::VARCHAR || '%' END AS share FROM lineitem")
def percent_format(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.percent(F.col("l_discount")).alias("share"))


_TAXIDS = "s AS (SELECT s_suppkey AS id FROM supplier), x AS (SELECT ps AS id, min(n) AS taxid FROM (SELECT l_suppkey AS ps, l_linenumber AS n FROM lineitem WHERE l_quantity > 49) GROUP BY 1), y AS (SELECT n_nationkey AS taxid, min(n_name) AS name FROM nation WHERE n_nationkey <> 3 GROUP BY 1)"


def _taxids(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    ids = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("taxid"))
    tree = table(spark, d, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("taxid"), L.from_columns(phylum=F.col("n_name")).alias("lineage"))
    return with_taxonomy(s, ids, tree)


@query(f"WITH {_TAXIDS} SELECT s.id, x.taxid::BIGINT AS taxid, 'phylum:' || y.name AS path FROM s JOIN x ON x.id = s.id JOIN y ON y.taxid = x.taxid")
def taxid_join(spark, d):
    """Suppliers by way of a number to a nation's lineage; the least number counts."""
    return _taxids(spark, d)[0].select("id", F.col("taxid").cast("long").alias("taxid"), L.path(F.col("lineage")).alias("path"))


@query(f"WITH {_TAXIDS} SELECT s.id, x.taxid::BIGINT AS taxid FROM s LEFT JOIN x ON x.id = s.id LEFT JOIN y ON y.taxid = x.taxid WHERE y.taxid IS NULL")
def taxid_rejects(spark, d):
    return _taxids(spark, d)[1].select("id", F.col("taxid").cast("long").alias("taxid"))


@query("SELECT s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS taxid, upper(replace(s_name, '#', '')) AS sequence FROM supplier WHERE s_suppkey % 5 <> 0")
def sequence_xml_parse(spark, d):
    """Suppliers as sequence records in XML, read back: the last id of its kind, the first taxon; every fifth has no taxon and is rejected."""
    qualifier = lambda v: F.struct(F.lit("db_xref").alias("GBQualifier_name"), v.alias("GBQualifier_value"))
    tax = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("taxon:"), F.col("s_nationkey").cast("string"))).otherwise("BOLD:x")
    quals = F.array(qualifier(F.lit("other:1")), qualifier(tax), qualifier(F.lit("BOLD:taxon:77")))
    seqids = F.array(F.lit("gb|ABC"), F.lit("gi|0"), F.concat(F.lit("gi|"), F.col("s_suppkey").cast("string")))
    x = dealt(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).select(F.replace("s_name", F.lit("#"), F.lit("")).alias("GBSeq_sequence"), F.struct(seqids.alias("GBSeqid")).alias("GBSeq_other-seqids"), F.struct(F.array(F.struct(F.struct(quals.alias("GBQualifier")).alias("GBFeature_quals"))).alias("GBFeature")).alias("GBSeq_feature-table"))
    path = new_path(spark, "sequences")
    write_xml(x, path, "GBSet", "GBSeq")
    return sequence_records(spark, path)[0]


@query(f"WITH {PATHS}, b AS (SELECT query, name AS species, sum(cnt)::DOUBLE AS c, any_value(n_trees) AS n FROM post WHERE level = 'species' GROUP BY 1, 2) SELECT query, row_number() OVER (PARTITION BY query ORDER BY c / n DESC, species)::BIGINT AS place, species, c / n AS prob FROM b")
def candidate_species(spark, d):
    """All species of a query, the most probable first."""
    return R.candidates(_post(spark, d)).select("query", F.col("place").cast("long"), "species", "prob")


@query(f"""WITH {PATHS}, l AS (SELECT query, path FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.query = a.query AND b.depth = a.depth + 1 AND starts_with(b.path, a.path || '/'))),
lv AS (SELECT e.query, e.path, count(DISTINCT l.path) AS leaves FROM u e JOIN l ON l.query = e.query AND (l.path = e.path OR starts_with(l.path, e.path || '/')) GROUP BY 1, 2)
SELECT query, path, leaves::BIGINT AS leaves, row_number() OVER (PARTITION BY query, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END ORDER BY leaves, path)::BIGINT AS place FROM lv""")
def ladderised_tree(spark, d):
    """Siblings in order of their number of leaves."""
    return R.ladder(R.summarise(lineages(spark, d))).select("query", "path", "leaves", F.col("place").cast("long"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority DESC, o_orderkey)::BIGINT AS place FROM orders")
def display_order(spark, d):
    """A customer's orders by price, then by priority, both from the highest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("identity"), F.col("o_orderpriority").alias("seq"))
    return X.display_order(o).select(F.col("query").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.col("place").cast("long"))


_BATCH = """s AS (SELECT s_suppkey::VARCHAR AS id, s_suppkey AS k, s_name, n_nationkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT *, 'first' AS batch, 1 AS i FROM s WHERE k % 3 <> 0 UNION ALL SELECT *, 'second', 2 FROM s WHERE k % 3 <> 1),
c AS (SELECT *, CASE WHEN k % 11 = 0 AND batch = 'first' THEN 'no sequence' WHEN k % 7 = 0 THEN 'no taxid' WHEN n_nationkey % 5 = 4 THEN 'no lineage' WHEN n_nationkey % 5 = 3 THEN 'mark in a name' WHEN n_nationkey % 5 = 2 THEN 'too few levels' END AS reason FROM b)"""


def _compiled(spark, d) -> str:
    """Two batches of suppliers that overlap, merged into one database; the first is merged again at the end of its own turn."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumn("id", F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey")
    taxids = x.filter(k % 7 != 0).select("id", F.col("n_nationkey").cast("string").alias("taxid"))
    five = L.from_columns(phylum=F.col("r_name"), **{"class": F.concat("n_name", F.when(F.col("n_nationkey") % 5 == 3, ": x").otherwise(""))}, order=F.lit("O"), family=F.lit("F"), genus=F.when(F.col("n_nationkey") % 5 != 2, F.lit("G")))
    taxonomy = n.join(r, n.n_regionkey == r.r_regionkey).filter(F.col("n_nationkey") % 5 != 4).select(F.col("n_nationkey").cast("string").alias("taxid"), five.alias("lineage"))
    path = new_path(spark, "compiled")
    for name, part in (("first", k % 3 != 0), ("first", k % 3 != 0), ("second", k % 3 != 1)):
        seq = F.when((k % 11 == 0) & F.lit(name == "first"), "").otherwise(F.concat(F.lit("ACGT"), F.lit(name)))
        database.merge_batch(path, name, x.filter(part).select("id", F.concat_ws(" ", "s_name", F.lit(name)).alias("organism"), seq.alias("sequence")), taxids, taxonomy)
    return path


@query(f"WITH {_BATCH}, g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS last FROM c WHERE reason IS NULL) SELECT id, n_nationkey::VARCHAR AS taxid, s_name || ' ' || batch AS organism, 'phylum:' || r_name || '/class:' || n_name || '/order:O/family:F/genus:G' AS path, 'ACGT' || batch AS sequence, batch FROM g WHERE last = 1")
def compile_database(spark, d):
    """The records of two overlapping batches: the last good one of each id."""
    return database.records(spark, _compiled(spark, d)).select("id", "taxid", "organism", L.path(F.col("lineage")).alias("path"), "sequence", "batch")


@query(f"WITH {_BATCH} SELECT batch, id, reason FROM c WHERE reason IS NOT NULL")
def compile_ledger(spark, d):
    """What the batches' records were rejected for."""
    return database.ledger(spark, _compiled(spark, d)).select("batch", "id", "reason")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def indexed_join(spark, d):
    """All orders with the customers of a written index, which is not shuffled."""
    path = new_path(spark, "index")
    database.write_index(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), path, 16)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return o.join(database.open_index(spark, path).hint("merge"), "id").select("o_orderkey", F.col("id").alias("c_custkey"), "c_name")
