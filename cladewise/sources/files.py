"""Readers of sequence, table and search-result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladewise.functions import lineage as L
from cladewise.functions import sequence as S

HIT = "Hit_id string, Hit_len int, Hit_hsps struct<Hsp:array<struct<`Hsp_bit-score`:double,Hsp_evalue:double,`Hsp_query-from`:int,`Hsp_query-to`:int,`Hsp_hit-from`:int,`Hsp_hit-to`:int>>>"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, title, sequence. Records may span lines; spaces and line ends go."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^>|\r", "").alias("v"))
    title = F.substring_index("v", "\n", 1)
    rest = F.substring(F.col("v"), F.length(title) + 1, F.length("v"))
    return raw.select("file", F.trim(title).alias("title"), F.regexp_replace(rest, r"\s", "").alias("sequence")).filter("title <> '' or sequence <> ''")


def checked_ids(records: DataFrame, key: str) -> DataFrame:
    """The records; raises when it runs if an id stands twice."""
    n = records.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return records.join(n, key).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("id stands twice: "), F.col(key)))).otherwise(F.col(key))).drop("_n")


def lookup(records: DataFrame, key: str, ids: list[str]) -> DataFrame:
    return records.filter(F.col(key).isin(ids))


def native_records(fasta_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, lineage, organism, sequence) and the rejects, from titles ``id ; level: name, ... ; organism``."""
    parts = F.split("title", r"\s*;\s*")
    all_ = fasta_records.select("title", F.trim(parts[0]).alias("id"), L.parse(F.get(parts, F.lit(1))).alias("lineage"), F.get(parts, F.lit(2)).alias("organism"), S.clean_record(F.col("sequence")).alias("sequence"), F.size(parts).alias("n"))
    good = (F.col("n") == 3) & F.col("lineage").isNotNull() & (F.col("id") != "")
    return all_.filter(good).select("id", "lineage", "organism", "sequence"), all_.filter(~F.coalesce(good, F.lit(False))).select("title")


def taxon_index(records: DataFrame) -> DataFrame:
    """name, level, id: the long form of an inverted index."""
    return records.select("id", F.inline("lineage")).select("name", "level", "id")


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Hits of search XML: the first segment of each, 0-based, with strands.

    The text is cut at the end tags, so that a large file is read by many tasks;
    Spark's XML reader reads a file in one. Such tags count in comments as well.
    """
    raw = spark.read.option("lineSep", "</Hit>").text(path)
    inner = F.regexp_extract("value", r"(?s)<Hit(?:\s[^>]*)?>(.*)$", 1)
    hits = raw.filter(F.col("value").rlike(r"<Hit(\s[^>]*)?>")).select(F.from_xml(F.concat(F.lit("<Hit>"), inner, F.lit("</Hit>")), HIT).alias("h"))
    return hit_rows(hits.select("h.*"))


def hit_rows(hits: DataFrame) -> DataFrame:
    h = F.get(F.col("Hit_hsps.Hsp"), F.lit(0))
    q1, q2, s1, s2 = h["Hsp_query-from"], h["Hsp_query-to"], h["Hsp_hit-from"], h["Hsp_hit-to"]
    return hits.select(F.col("Hit_id").alias("id"), h["Hsp_bit-score"].alias("score"), h["Hsp_evalue"].alias("significance"), (F.least(q1, q2) - 1).alias("q_start"), (F.abs(q2 - q1) + 1).alias("q_len"), F.when(q1 > q2, -1).otherwise(1).alias("q_strand"), (F.least(s1, s2) - 1).alias("s_start"), (F.abs(s2 - s1) + 1).alias("s_len"), F.when(s1 > s2, -1).otherwise(1).alias("s_strand"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, every cell a string. A file that is missing is an empty table without columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([]))
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def key_value_lines(lines: DataFrame) -> DataFrame:
    """Adds key and value of lines ``key=value`` in the column ``value``; other lines go."""
    parts = F.split("value", "=", 2)
    return lines.withColumn("key", parts[0]).withColumn("value", F.get(parts, F.lit(1))).filter("value is not null")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value for lines ``key=value``; pivot where the keys are known."""
    return key_value_lines(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")).select("file", "key", "value")


def nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """file, tree_name, newick for each tree line."""
    line = r"(?i)^\s*tree\s+(\S+)\s*=\s*(?:\[[^\]]*\]\s*)?(.*);\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", line, 1).alias("tree_name"), F.regexp_extract("value", line, 2).alias("newick"))


def nexus_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, name, aligned from the matrix of a Nexus file; interleaved blocks of a name are joined in order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", r"(?is)\bmatrix\b(.*?);", 1).alias("m"))
    rows = raw.select("file", F.posexplode(F.split("m", "\n"))).select("file", "pos", F.trim("col").alias("line")).filter("line <> ''")
    parts = rows.select("file", "pos", F.regexp_extract("line", r"^'?([^'\s]+)'?\s+(.*)$", 1).alias("name"), F.regexp_replace(F.regexp_extract("line", r"^'?([^'\s]+)'?\s+(.*)$", 2), r"\s", "").alias("part"))
    return parts.groupBy("file", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("aligned"))


def phylip(spark: SparkSession, path: str) -> DataFrame:
    """file, name, aligned; the header line of two numbers is left out."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*\d+\s+\d+\s*$") & (F.trim("value") != ""))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.regexp_extract("value", r"^(\S+)\s+(.*)$", 1).alias("name"), F.regexp_replace(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2), r"\s", "").alias("aligned"))


def constraints(spark: SparkSession, path: str) -> DataFrame:
    """left, right from lines ``a b | c d``; lines with fewer than two names on a side are left out."""
    sides = F.split("value", r"\|")
    names = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    out = spark.read.text(path).filter(F.size(sides) == 2).select(names(sides[0]).alias("left"), names(sides[1]).alias("right"))
    return out.filter((F.size("left") >= 2) & (F.size("right") >= 2))


TAXON = "TaxId string, ScientificName string, LineageEx struct<Taxon:array<struct<TaxId:string,ScientificName:string,Rank:string>>>"
#: Ranks that say nothing, and names that are no taxa.
EMPTY_RANKS = ("no rank", "clade")
UNCLASSIFIED = "unclassified|BOLD:"


def _named_taxa() -> DataFrame:
    """The taxa of a record that say something: no empty ranks, unclassified names or varieties."""
    return F.filter("LineageEx.Taxon", lambda t: ~t["Rank"].isin(*EMPTY_RANKS) & ~t["ScientificName"].rlike(UNCLASSIFIED) & (t["Rank"] != "varietas") & L.rank_of(t["Rank"]).isNotNull())


#: Marks that separate names in titles, so no name may hold one.
MARKS = "[:;,]"


def taxonomy_rows(taxa: DataFrame) -> DataFrame:
    """taxid, organism, lineage, complete from parsed taxonomy records; those of ``taxonomy_rejects`` are left out.

    Ranks that say nothing, unclassified names and varieties go; of several
    names of one rank the first stays. A species comes from the organism's
    first two words if none is given. ``complete`` asks for five levels.
    """
    all_ = _named_taxa()
    first = F.filter(all_, lambda t, i: F.size(F.filter(F.slice(all_, F.lit(1), i), lambda u: u["Rank"] == t["Rank"])) == 0)
    made = F.transform(first, lambda t: F.struct(L.rank_of(t["Rank"]).alias("rank"), t["Rank"].alias("level"), t["ScientificName"].alias("name")))
    own = F.when(F.exists(made, lambda e: e["level"] == "species"), made).otherwise(F.concat(made, F.array(L.entry("species", L.two_words(F.col("ScientificName"))))))
    out = taxa.filter(~F.coalesce(_marked(), F.lit(False))).select(F.col("TaxId").alias("taxid"), F.regexp_replace("ScientificName", r"[^\w\s]", "_").alias("organism"), F.array_sort(own).alias("lineage"))
    return out.withColumn("complete", L.minimal(F.col("lineage")))


def _marked() -> DataFrame:
    """Whether a record has a name with a mark; the organism's counts where it has to stand for the species."""
    all_ = _named_taxa()
    stands = ~F.exists(all_, lambda t: t["Rank"] == "species") & L.two_words(F.col("ScientificName")).rlike(MARKS)
    return F.exists(all_, lambda t: t["ScientificName"].rlike(MARKS)) | stands


def taxonomy_rejects(taxa: DataFrame) -> DataFrame:
    """taxid, organism, names: parsed records that have names with separating marks, and these names."""
    names = F.filter(F.transform(_named_taxa(), lambda t: t["ScientificName"]), lambda n: n.rlike(MARKS))
    return taxa.filter(_marked()).select(F.col("TaxId").alias("taxid"), F.col("ScientificName").alias("organism"), F.when(F.size(names) > 0, names).otherwise(F.array(L.two_words(F.col("ScientificName")))).alias("names"))


def with_taxonomy(sequences: DataFrame, taxids: DataFrame, taxonomy_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences with taxid and lineage, and the ids of those without one. sequences: id; taxids: id, taxid; taxonomy: taxid, lineage. Of several taxids or lineages the least taxid and the first lineage in order count."""
    one = taxids.groupBy("id").agg(F.min("taxid").alias("taxid"))
    tree = taxonomy_.groupBy("taxid").agg(F.min("lineage").alias("lineage"))
    all_ = sequences.join(one, "id", "left").join(tree, "taxid", "left")
    return all_.filter("lineage is not null").select(*sequences.columns, "taxid", "lineage"), all_.filter("lineage is null").select("id", "taxid")


SEQUENCE = "GBSeq_sequence string, `GBSeq_other-seqids` struct<GBSeqid:array<string>>, `GBSeq_feature-table` struct<GBFeature:array<struct<GBFeature_quals:struct<GBQualifier:array<struct<GBQualifier_name:string,GBQualifier_value:string>>>>>>"


def sequence_rows(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, taxid, sequence) of parsed sequence records, and those without all three: the last id of the form ``gi|number`` and the first qualifier ``taxon:number``."""
    ids = F.filter("GBSeq_other-seqids.GBSeqid", lambda x: x.rlike(r"^gi\|"))
    quals = F.flatten(F.transform("GBSeq_feature-table.GBFeature", lambda f: F.coalesce(f["GBFeature_quals"]["GBQualifier"], F.array().cast("array<struct<GBQualifier_name:string,GBQualifier_value:string>>"))))
    taxa = F.filter(quals, lambda q: q["GBQualifier_value"].rlike("^taxon:"))
    out = records.select(F.regexp_extract(F.try_element_at(ids, F.lit(-1)), r"^gi\|([^|]+)", 1).alias("id"), F.regexp_extract(F.get(taxa, F.lit(0))["GBQualifier_value"], "^taxon:(.+)$", 1).alias("taxid"), F.upper("GBSeq_sequence").alias("sequence"))
    good = F.coalesce((F.col("id") != "") & (F.col("taxid") != "") & (F.col("sequence") != ""), F.lit(False))
    return out.filter(good), out.filter(~good)


def sequence_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return sequence_rows(spark.read.format("xml").option("rowTag", "GBSeq").schema(SEQUENCE).load(path))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_rows(spark.read.format("xml").option("rowTag", "Taxon").schema(TAXON).load(path))
