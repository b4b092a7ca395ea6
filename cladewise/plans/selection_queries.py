"""Queries on hits, records, sources and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.operators import selection as X
from cladewise.operators import tables as T
from cladewise.operators.lineage_cut import new_path
from cladewise.plans.adapters import HITS, hits
from cladewise.plans.registry import query, table
from cladewise.sources import files, sinks


def _order():
    return [F.col("score").desc(), F.col("id")]


_RANK = f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM h)"


@query(f"{_RANK} SELECT query, id, species, score FROM r WHERE i <= 20")
def topk_hits(spark, d):
    return X.top(hits(spark, d), ["query"], _order(), 20)


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, species ORDER BY score DESC, id) AS i FROM h) SELECT query, id, species, score FROM r WHERE i <= 2")
def individuals_per_species(spark, d):
    return X.top(hits(spark, d), ["query", "species"], _order(), 2)


@query(f"WITH {HITS} SELECT query, count(DISTINCT species)::BIGINT AS species, count(*)::BIGINT AS hits FROM h GROUP BY query")
def diversity_counts(spark, d):
    return X.diversity(hits(spark, d), "query", "species")


@query(f"WITH {HITS} SELECT query, id, score, max(score) OVER (PARTITION BY query ORDER BY id ROWS UNBOUNDED PRECEDING) AS best FROM h")
def running_best_score(spark, d):
    return X.running_best(hits(spark, d), ["query"], [F.col("id")], "score").select("query", "id", "score", "best")


@query(f"{_RANK}, s AS (SELECT *, row_number() OVER (PARTITION BY query, species ORDER BY score DESC, id) AS k FROM r) SELECT query, id, (i <= 30)::BOOLEAN AS within_soft, k = 1 AS first_of_species FROM s WHERE i <= 50 AND (i <= 30 OR k = 1)")
def soft_hard_cap(spark, d):
    """After 30 hits only the first of a species is taken, and none after 50."""
    x = X.capped(hits(spark, d), "query", "species", _order(), 30, 50)
    return x.select("query", "id", (F.col("place") <= 30).alias("within_soft"), (F.col("turn") == 1).alias("first_of_species"))


@query(f"WITH {HITS} SELECT query, count(*) FILTER (WHERE score >= 50)::BIGINT AS significant, CASE WHEN count(*) FILTER (WHERE score >= 50) < 5 THEN 'too few' WHEN count(DISTINCT species) < 3 THEN 'too alike' ELSE 'ok' END AS status FROM h GROUP BY query")
def significant_count(spark, d):
    return X.set_status(hits(spark, d), "query", F.col("score") >= 50, 5, "species", 3)


@query(f"WITH {HITS}, b AS (SELECT *, max(score) OVER (PARTITION BY query ORDER BY id ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER (PARTITION BY query ORDER BY id) AS i FROM h), f AS (SELECT query, min(i) AS cut FROM b WHERE score < best * 0.5 AND i > 5 GROUP BY query) SELECT b.query, b.id FROM b LEFT JOIN f ON f.query = b.query WHERE i <= coalesce(cut, i)")
def relative_score_stop(spark, d):
    """In order of id, up to the first hit after the fifth that has under half of the best score so far."""
    return X.until_low(hits(spark, d), "query", [F.col("id")], "score", 0.5, 5).select("query", "id")


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, species ORDER BY score DESC, id) AS round FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round, score DESC, id) AS place FROM r) SELECT query, id, round::BIGINT AS round, place::BIGINT AS place FROM p WHERE place <= 12")
def fill_in_round_robin(spark, d):
    return X.round_robin(hits(spark, d), "query", "species", _order(), 12).select("query", "id", F.col("round").cast("long"), F.col("place").cast("long"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 2080) AND split_part(p_type, ' ', 1) <> 'PROMO'")
def exclude_taxon_anti(spark, d):
    p = table(spark, d, "part")
    names = p.select("p_partkey", F.explode(F.array("p_brand", F.split("p_type", " ")[0])).alias("name"))
    taxa = p.filter("p_retailprice > 2080").select(F.col("p_brand").alias("name")).union(spark.createDataFrame([("PROMO",)], "name string")).distinct()
    return X.without_taxa(p, names, taxa, "p_partkey").select("p_partkey", "p_name")


@query("SELECT n.n_nationkey::BIGINT AS n_nationkey, s.s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN '(l!?)' ELSE '(l)' END AS status FROM nation n LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) s ON s.s_nationkey = n.n_nationkey")
def lookup_with_status(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return X.with_status(n, s, "k").select(F.col("k").cast("long").alias("n_nationkey"), "s_suppkey", "status")


@query("SELECT DISTINCT r.r_name, n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey <> n.n_nationkey AND contains(upper(m.n_name), upper(n.n_name)))")
def seq_containment_reject(spark, d):
    """Names that are part of another name of their region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), "r_name", F.col("n_name").alias("seq"))
    return X.include_minus_exclude(x, X.not_contained(x, x, ["r_name"], k=4), "id").select("r_name", F.col("seq").alias("n_name")).distinct()


@query("SELECT a.p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size > 40 AND contains(upper(b.p_name), upper(substr(a.p_name, 1, 14))))")
def contained_in_accepted(spark, d):
    """Parts of which the first letters of the name are part of the name of a large part of the same brand."""
    p = table(spark, d, "part")
    accepted = p.filter("p_size > 40").select("p_brand", F.col("p_name").alias("seq"))
    return X.contained(p.select("p_partkey", "p_brand", F.substring("p_name", 1, 14).alias("seq")), accepted, ["p_brand"]).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_acctbal > 0")
def failed_assignments(spark, d):
    """Queries that no later stage knows and that are not set aside."""
    known = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    aside = table(spark, d, "customer").filter("not c_acctbal > 0").select("c_custkey")
    return X.failed(table(spark, d, "customer").select("c_custkey"), known, aside, "c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity = 50)")
def not_assigned(spark, d):
    found = table(spark, d, "lineitem").filter("l_discount >= 0.1 and l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return X.failed(table(spark, d, "supplier").select("s_suppkey"), found, None, "s_suppkey")


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS n_regionkey, 'NULL' AS r_regionkey FROM nation UNION ALL SELECT r_name, 'NULL', r_regionkey::VARCHAR FROM region")
def union_missing_columns(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return T.union_filled(a, table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")).select("name", "n_regionkey", "r_regionkey")


@query("SELECT r_name, r_regionkey::VARCHAR AS r_regionkey FROM region UNION ALL SELECT 'ATLANTIS', '99'")
def append_row(spark, d):
    return T.append_row(table(spark, d, "region").select("r_name", "r_regionkey"), {"r_name": "ATLANTIS", "r_regionkey": "99"})


@query("SELECT a.n_name, b.n_nationkey::BIGINT AS other FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS i FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey DESC) AS i FROM nation) b ON a.i = b.i")
def zip_join(spark, d):
    n = table(spark, d, "nation")
    return T.zip_join(n.select("n_name"), n.select(F.col("n_nationkey").cast("long").alias("other")), [F.col("n_name")], [F.col("other").desc()])


@query("SELECT n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS found FROM nation")
def row_membership(spark, d):
    return T.with_membership(table(spark, d, "nation"), table(spark, d, "supplier").filter("s_acctbal < 0"), {"n_nationkey": "s_nationkey"}).select("n_name", "found")


@query("SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def set_difference(spark, d):
    return X.include_minus_exclude(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")), table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").cast("long").alias("k")), "k")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 3)::BIGINT AS chunk FROM orders")
def chunking(spark, d):
    """All orders in chunks of three."""
    return T.chunks(table(spark, d, "orders").select("o_custkey", "o_orderkey"), 3, [F.col("o_custkey"), F.col("o_orderkey")]).select("o_orderkey", "chunk")


@query("SELECT c_custkey, lag(c_custkey) OVER w AS previous, lead(c_custkey) OVER w AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name, c_custkey)")
def previous_next(spark, d):
    return T.neighbours(table(spark, d, "customer"), ["c_nationkey"], ["c_name", "c_custkey"], "c_custkey").select("c_custkey", F.col("previous_c_custkey").alias("previous"), F.col("next_c_custkey").alias("next"))


@query("SELECT event_id, lower(event_type) AS key, round(value, 2)::DECIMAL(18,2)::VARCHAR || '=' || user_id::VARCHAR AS value FROM events")
def kv_load(spark, d):
    """Lines key=value split at the first mark; lines without one go."""
    e = table(spark, d, "events")
    lines = e.select("event_id", F.explode(F.array(F.concat(F.lower("event_type"), F.lit("="), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("="), F.col("user_id").cast("string")), F.lit("no mark here"))).alias("value"))
    return files.key_value_lines(lines).select("event_id", "key", "value")


@query("SELECT l_orderkey, l_linenumber, (l_linenumber - 1)::BIGINT AS q_start, l_quantity::BIGINT AS q_len, CASE WHEN l_returnflag = 'R' AND l_quantity > 1 THEN -1 ELSE 1 END::BIGINT AS s_strand, l_extendedprice AS score FROM lineitem")
def xml_hits(spark, d):
    """Search results written as XML files and read back: positions from 0, strand from the order of the ends, the first segment only."""
    li = sinks.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice"))
    q1, q2 = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int") - 1
    rev = F.col("l_returnflag") == "R"
    one = lambda score: F.struct(score.alias("Hsp_bit-score"), F.lit(0.001).alias("Hsp_evalue"), q1.alias("Hsp_query-from"), q2.alias("Hsp_query-to"), F.when(rev, q2).otherwise(q1).alias("Hsp_hit-from"), F.when(rev, q1).otherwise(q2).alias("Hsp_hit-to"))
    found = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("Hit_id"), q2.alias("Hit_len"), F.struct(F.array(one(F.col("l_extendedprice")), one(F.lit(1.0))).alias("Hsp")).alias("Hit_hsps"))
    path = new_path(spark, "hits")
    sinks.write_xml(found, path, "Hits", "Hit")
    x = files.search_results(spark, path)
    key = F.split("id", ":")
    return x.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), F.col("q_start").cast("long"), F.col("q_len").cast("long"), F.col("s_strand").cast("long"), "score")


@query("SELECT p_partkey::VARCHAR || ' ' || p_name AS title, replace(upper(p_name || p_type || p_brand || p_name || p_type || p_brand || p_name || p_type), ' ', '') AS sequence FROM part")
def fasta_round_trip(spark, d):
    """Parts written as FASTA with folded lines and read back."""
    path = new_path(spark, "fasta")
    seq = F.replace(F.upper(F.concat("p_name", "p_type", "p_brand", "p_name", "p_type", "p_brand", "p_name", "p_type")), F.lit(" "), F.lit(""))
    sinks.write_fasta(table(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("title"), seq.alias("sequence")), path)
    return files.fasta(spark, path).select("title", "sequence")


@query("SELECT s_suppkey::VARCHAR AS id, 'phylum:' || r_name || '/class:' || n_name AS path, s_name AS organism, 'ACGT' || repeat('N', length(s_name) - 4) AS sequence FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 7 <> 0")
def native_db_round_trip(spark, d):
    """Suppliers as records of a sequence database, written as FASTA and built from it; every seventh has no lineage and is rejected."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    lineage = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("phylum: "), "r_name", F.lit(", class: "), "n_name")).otherwise("none")
    path = new_path(spark, "database")
    sinks.write_fasta(x.select(F.concat_ws(" ; ", F.col("s_suppkey").cast("string"), lineage, "s_name").alias("title"), F.concat(F.lit("ac-gt"), F.repeat(F.lit("#"), F.length("s_name") - 4)).alias("sequence")), path)
    records, _ = files.native_records(files.fasta(spark, path))
    return records.select("id", L.path(F.col("lineage")).alias("path"), "organism", "sequence")


@query("SELECT name, level, count(*)::BIGINT AS ids FROM (SELECT r_name AS name, 'phylum' AS level, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'class', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1, 2")
def taxon_index(spark, d):
    """How many records the inverted index has under each name."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    x = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    records = x.select(F.col("s_suppkey").alias("id"), L.from_columns(phylum=F.col("r_name"), **{"class": F.col("n_name")}).alias("lineage"))
    return files.taxon_index(records).groupBy("name", "level").agg(F.count("id").alias("ids"))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def table_round_trip(spark, d):
    """Orders written as tab-separated text and read back, every cell a string."""
    path = new_path(spark, "table")
    sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return files.table(spark, path)


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html)::BIGINT AS size FROM pages")
def page_records(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("size"))


@query("WITH s AS (SELECT s_suppkey, upper(s_name) AS seq FROM supplier), k AS (SELECT DISTINCT s_suppkey, substr(seq, i, 8) AS kmer FROM s, range(1, 200) t(i) WHERE i <= greatest(length(seq) - 7, 1)), c AS (SELECT a.s_suppkey AS query, b.s_suppkey AS id, count(*) AS score FROM k a JOIN k b ON a.kmer = b.kmer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS ord FROM c) SELECT query, id, score::BIGINT AS score, ord::BIGINT AS ord FROM r WHERE ord <= 10")
def kmer_search(spark, d):
    """The ten records that share most 8-letter words with each, a report of the best."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("seq"))
    return X.kmer_search(s, s, 8, 10).select("query", "id", "score", F.col("ord").cast("long"))


@query("SELECT p_partkey, '>' || p_partkey::VARCHAR || chr(10) || upper(p_name) AS record FROM part")
def fasta_records(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.fasta_text(F.col("p_partkey").cast("string"), F.upper("p_name")).alias("record"))


def _event_hits(spark, d):
    """Each user's events as hits in order of value; names repeat, and short sequences lie within longer ones."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("query"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).alias("ord"), F.col("event_id").alias("n"), F.col("value").alias("score"), "event_type")
    name = lambda k: F.concat_ws(" ", "event_type", (F.col("n") % k).cast("string"))
    seq = F.repeat(F.concat("event_type", (F.col("n") % 3).cast("string")), (1 + F.col("n") % 4).cast("int"))
    return e.select("query", "ord", F.col("n").cast("string").alias("id"), "score", (F.lit(1.0) / (1 + F.col("score"))).alias("significance"), seq.alias("seq"), name(12).alias("species"), F.when(F.col("n") % 7 != 0, name(6)).alias("genus"), name(4).alias("family"), name(2).alias("order"), F.col("event_type").alias("class"), F.lit("p").alias("phylum"))


#: Quotas that a user's events rarely meet in one search of so many hits.
MANY_ROUNDS, FEW_HITS = X.Quotas(significance=0.5, nrsignificant=3, relbitscore=0.1, besthits=8, alignmentlimit=30, individuals=2, genera=9, families=9, orders=7, classes=4), 6


@query()
def greedy_rounds(spark, d):
    """Selection that needs several searches of each query, with spares, containment and stops. Tests compare it with a plain compilation."""
    return X.select_homologues(_event_hits(spark, d), MANY_ROUNDS, FEW_HITS).drop("seq")


@query()
def greedy_select(spark, d):
    """The sequential scan over each user's events as hits. No SQL: each hit depends on what was accepted before."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("query"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).alias("ord"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("score"), (F.lit(1.0) / (1 + F.col("value"))).alias("significance"), F.concat("event_type", F.col("event_id").cast("string")).alias("seq"), "event_type")
    h = e.select("query", "ord", "id", "score", "significance", "seq", F.concat_ws(" ", "event_type", (F.col("id").cast("long") % 40).cast("string")).alias("species"), F.concat_ws(" ", "event_type", (F.col("id").cast("long") % 10).cast("string")).alias("genus"), F.col("event_type").alias("family"), F.col("event_type").alias("order"), F.lit("c").alias("class"), F.lit("p").alias("phylum"))
    return X.select_homologues(h).drop("seq")
