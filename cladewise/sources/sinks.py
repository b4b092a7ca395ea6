"""Writers of sequence and report files. Spark writes a folder of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import sequence as S
from cladewise.operators.rollup import bayes_factor


def fasta_text(title: Column, seq: Column, width: int = 100) -> Column:
    """A record; lines of ``width`` characters."""
    return F.concat(F.lit(">"), title, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str, title: str = "title", seq: str = "sequence") -> None:
    df.select(fasta_text(F.col(title), F.col(seq)).alias("value")).write.text(path)


def homologue_fasta(homologues: DataFrame) -> DataFrame:
    """query, text: the query first, then its homologues by significance. homologues: query, query_seq, id, organism, seq, significance."""
    row = F.struct("significance", "id", fasta_text(F.concat_ws("_", "id", S.organism_label(F.col("organism"))), F.col("seq")).alias("t"))
    return homologues.groupBy("query").agg(F.concat_ws("\n", fasta_text(F.first("query"), F.first("query_seq")), F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["t"]), "\n")).alias("text"))


def _one_length() -> Column:
    n = F.length("aligned")
    return F.when(F.min(n) == F.max(n), F.max(n)).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("int"))


def nexus_alignment(aligned: DataFrame) -> DataFrame:
    """query, text. Raises when it runs if sequences differ in length. Names are written whole."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "aligned"))), lambda r: F.concat(F.rpad(r["name"], F.greatest(F.lit(40), F.length(r["name"]) + 1), " "), r["aligned"])), "\n")
    head = F.format_string("#NEXUS\n\nbegin data;\n   dimensions ntax=%d nchar=%d;\n   format datatype=dna interleave=no gap=-;\n   matrix\n", F.count(F.lit(1)), _one_length())
    return aligned.groupBy("query").agg(F.concat(head, body, F.lit("\n;\nend;\n")).alias("text"))


def phylip_alignment(aligned: DataFrame) -> DataFrame:
    """query, text. Raises when it runs if sequences differ in length."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "aligned"))), lambda r: F.concat(r["name"], F.lit("  "), r["aligned"])), "\n")
    return aligned.groupBy("query").agg(F.concat(F.format_string("%d %d\n", F.count(F.lit(1)), _one_length()), body).alias("text"))


def newick(summary: DataFrame) -> DataFrame:
    """query, newick of a summary by path: leaves first, then subtrees; an only child takes its parent's place. One pass for each depth, from below."""
    from cladewise.operators.rollup import parent_path

    depth = summary.agg(F.max("depth")).first()[0] or 0
    now = summary.select("query", "path", "depth", "name").withColumn("sub", F.lit(None).cast("string"))
    for d in range(depth, 0, -1):
        text = F.coalesce("sub", S.safe_name(F.col("name")))
        below = now.filter(F.col("depth") == d).groupBy("query", parent_path(F.col("path")).alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.col("sub").isNotNull().alias("inner"), text.alias("t")))).alias("_c"))
        joined = F.array_join(F.transform("_c", lambda x: x["t"]), ",")
        below = below.select("query", "path", F.when(F.size("_c") == 1, joined).otherwise(F.concat(F.lit("("), joined, F.lit(")"))).alias("_new"))
        if d == 1:
            return below.select("query", F.concat("_new", F.lit(";")).alias("newick"))
        now = now.filter(F.col("depth") < d).join(below, ["query", "path"], "left").withColumn("sub", F.coalesce("_new", "sub")).drop("_new")
    return now.select("query", F.lit(";").alias("newick"))


def ascii_tree(post: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """query, path, line: indented names with their probability, in order of path, and with Bayes factors where priors (query, path, prior) are given."""
    line = F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.lit("+"), F.col("name"), F.lit(" ("), F.col("level"), F.lit(") "), S.percent(F.col("prob")))
    if priors is not None:
        post = post.join(priors, ["query", "path"], "left")
        line = F.concat(line, F.when(F.col("prior").isNotNull(), F.format_string(" bf: %.2f", bayes_factor(F.col("prob"), F.col("prior")))).otherwise(""))
    return post.select("query", "path", line.alias("line"))


def write_table(df: DataFrame, path: str) -> None:
    df.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in df.columns)).write.csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path)


#: Records of an XML file. It is compressed, so one task reads it whole.
PER_FILE = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are files of PER_FILE records for. They stay where they are if no task has more than one and a half times its share; a shuffle would put them on disk once more."""
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    parts = max(1, -(-rows["n"] // PER_FILE))
    even = rows["most"] * min(parts, df.sparkSession.sparkContext.defaultParallelism) <= 1.5 * rows["n"]
    return df if even else df.repartition(parts)


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    """XML files of at most PER_FILE records, one to a line and compressed, as tags are most of their text. Each task writes the rows it has; ``dealt`` shares out those of few large partitions, best before the records are made."""
    df.write.format("xml").options(rootTag=root, rowTag=row, indent="", compression="gzip").option("maxRecordsPerFile", PER_FILE).save(path)
