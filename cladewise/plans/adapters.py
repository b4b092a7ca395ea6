"""The driver's tables seen as lineages, hits and sequences, in Spark and in SQL."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.functions import sequence as S
from cladewise.plans.registry import table

MAP_FROM, MAP_TO = "BDEFHIJKLMNOPQRSUVWXYZ", "CTACTGACGTACGTACTACGTA"
#: Letters of either case in capitals, and as bases.
_UPPER = {c: c.upper() for c in ascii_letters}
BASES = {c: u.translate(str.maketrans(MAP_FROM, MAP_TO)) for c, u in _UPPER.items()}


def trees(spark: SparkSession, d: str) -> DataFrame:
    """query, tree_no and six names: an order is a sampled tree, its nation and market segment the query. Customers in debt have no class, small orders no family, pending orders no lineage."""
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    some = F.col("o_orderstatus") != "P"
    price = F.col("o_totalprice")
    return x.select(
        F.concat_ws(" ", "n_name", "c_mktsegment").alias("query"),
        F.col("o_orderkey").alias("tree_no"),
        F.when(some, F.col("r_name")).alias("p"),
        F.when(some & (F.col("c_acctbal") >= 0), F.col("n_name")).alias("c"),
        F.when(some, F.col("c_mktsegment")).alias("o"),
        F.when(some & (price >= 50000), F.concat(F.lit("Tier "), F.floor(price / 100000).cast("string"))).alias("f"),
        F.when(some, F.col("o_orderstatus")).alias("g"),
        F.when(some, F.concat(F.col("o_orderstatus"), F.lit(" "), F.year("o_orderdate").cast("string"))).alias("s"),
    )


def lineage_of(x: DataFrame) -> Column:
    return L.from_columns(phylum=x.p, **{"class": x.c}, order=x.o, family=x.f, genus=x.g, species=x.s)


def lineages(spark: SparkSession, d: str) -> DataFrame:
    x = trees(spark, d)
    return x.select("query", "tree_no", lineage_of(x).alias("lineage"))


TREES = """
t AS (SELECT n_name || ' ' || c_mktsegment AS query, o_orderkey AS tree_no,
  CASE WHEN o_orderstatus <> 'P' THEN r_name END AS p,
  CASE WHEN o_orderstatus <> 'P' AND c_acctbal >= 0 THEN n_name END AS c,
  CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS o,
  CASE WHEN o_orderstatus <> 'P' AND o_totalprice >= 50000 THEN 'Tier ' || floor(o_totalprice / 100000)::BIGINT::VARCHAR END AS f,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS g,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ' ' || year(o_orderdate)::VARCHAR END AS s
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_PARTS = [("p", "phylum"), ("c", "class"), ("o", "order"), ("f", "family"), ("g", "genus"), ("s", "species")]


def _prefix(k: int) -> str:
    return "concat_ws('/', " + ", ".join(f"'{lv}:' || {c}" for c, lv in _PARTS[:k]) + ")"


def _depth(k: int) -> str:
    return " + ".join(f"({c} IS NOT NULL)::BIGINT" for c, _ in _PARTS[:k])


PATHS = (
    TREES
    + ",\ne AS ("
    + " UNION ALL ".join(f"SELECT query, tree_no, {_prefix(k)} AS path, {_depth(k)} AS depth, {k} AS r, '{lv}' AS level, {c} AS name FROM t WHERE {c} IS NOT NULL" for k, (c, lv) in enumerate(_PARTS, 1))
    + "),\nn AS (SELECT query, count(*) AS n_trees FROM t GROUP BY query),\nu AS (SELECT query, path, depth, r, level, name, count(*) AS cnt FROM e GROUP BY ALL),\npost AS (SELECT u.*, n_trees, cnt::DOUBLE / n_trees AS prob FROM u JOIN n ON n.query = u.query)"
)
FULL = _prefix(6)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Events as ranked hits: user is the query, event type the species, value the score; in order of score."""
    return table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.col("event_type").alias("species"), F.col("value").alias("score"))


HITS = "h AS (SELECT user_id AS query, event_id AS id, event_type AS species, value AS score FROM events)"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, raw and seq: a document's letters in upper case as bases, spaces as gaps, other marks dropped; whole texts."""
    x = table(spark, d, "documents")
    return x.select("doc_id", "source", S.mapped(F.col("text"), {**_UPPER, " ": " ", "~": "~", ".": "."}).alias("raw"), S.mapped(F.col("text"), {**BASES, " ": "-"}).alias("seq"))


SEQUENCES = f"""
q AS (SELECT doc_id, source, upper(regexp_replace(text, '[^A-Za-z ~.]', '', 'g')) AS raw FROM documents),
z AS (SELECT *, translate(regexp_replace(raw, '[~.]', '', 'g'), '{MAP_FROM} ', '{MAP_TO}-') AS seq FROM q)"""


def benchmark_sequences(spark: SparkSession, d: str) -> DataFrame:
    """item_id and seq of the small table of items."""
    x = table(spark, d, "benchmark")
    return x.select("item_id", F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z ]", "")), MAP_FROM + " ", MAP_TO + "-").alias("seq"))


BENCHMARK = f"z AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '{MAP_FROM} ', '{MAP_TO}-') AS seq FROM benchmark)"
