"""Databases of records: an index by id, batches merged into one table, and a ledger of what is rejected."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.sources.files import MARKS, exists


class RepeatedIdError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_index(records: DataFrame, path: str, buckets: int = 64) -> None:
    """Records by id: a file for each bucket of ids, sorted, with Bloom filters of the ids. Raises if an id stands twice."""
    spark = records.sparkSession
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id").limit(5).collect()
    if twice:
        raise RepeatedIdError(f"ids stand twice: {', '.join(str(r['id']) for r in twice)}")
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # Dealt out as buckets are, so that each is one file.
    dealt = records.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("parquet.bloom.filter.enabled#id", "true").option("path", f"{path}/rows")
    dealt.format("parquet").mode("overwrite").saveAsTable(name)
    said = {"buckets": buckets, "schema": records.schema.simpleString()}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")


def _table(path: str) -> str:
    """A name in the session's catalog: this is where Spark keeps what it knows about buckets."""
    return f"cladewise_index_{zlib.crc32(path.encode()):08x}_{re.sub('[^a-z0-9]+', '_', path.lower())[-40:]}"


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of a written index, in this session or another. Joins by id need no shuffle of them, and filters by id read few row groups of the buckets they fall into."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        said = json.loads(spark.read.text(f"{path}/index").first()[0])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {said['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def lookup(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The records of these ids: a filter that reaches the files."""
    return open_index(spark, path).filter(F.col("id").isin(ids))


#: Why a record is rejected, in the order in which it is asked.
REASONS = ("no id", "no sequence", "no taxid", "no lineage", "mark in a name", "too few levels", "id stands twice")


def checked(batch: DataFrame, taxids: DataFrame, taxonomy: DataFrame, levels: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, taxid, organism, lineage, sequence) of the good records of a batch, and (id, reason) of the others.

    batch: id, organism, sequence, and ``taken`` where the order of equal ids
    counts (the last stays). taxids: id, taxid. taxonomy: taxid, lineage. Of
    several taxids the least counts, of several lineages the first in order.
    """
    one = taxids.groupBy("id").agg(F.min("taxid").alias("taxid"))
    tree = taxonomy.groupBy("taxid").agg(F.min("lineage").alias("lineage"))
    order = [F.col("taken").desc()] if "taken" in batch.columns else []
    x = batch.join(one, "id", "left").join(tree, "taxid", "left")
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order, F.xxhash64("organism", "sequence"))))
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    tests = (empty("id"), empty("sequence"), F.col("taxid").isNull(), F.col("lineage").isNull(), F.exists("lineage", lambda e: e["name"].rlike(MARKS)), ~L.minimal(F.col("lineage"), levels), F.col("nth") > 1)
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    said = x.withColumn("reason", reason)
    return said.filter("reason is null").select("id", "taxid", "organism", "lineage", "sequence"), said.filter("reason is not null").select("id", "reason")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a database, oldest first: those whose writing has ended."""
    root, fs = _fs(spark, f"{path}/records")
    if not fs.exists(root):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(root))
    found = sorted(int(n[2:]) for n in names if re.fullmatch("v=[0-9]+", n))
    return [n for n in found if exists(spark, f"{path}/records/v={n}/_SUCCESS")]


def records(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a compiled database."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no database at {path}")
    return spark.read.parquet(f"{path}/records/v={known[-1]}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, id, reason: what has been rejected, by batch."""
    return spark.read.schema("id string, reason string, batch string").parquet(f"{path}/ledger")


def merge_batch(path: str, name: str, batch: DataFrame, taxids: DataFrame, taxonomy: DataFrame, levels: int = 5) -> None:
    """Merges a batch into the database at the path: records by id, the last batch wins; what is rejected goes into the ledger.

    A new version is written beside the old one and counts once it is whole, so
    readers and a run that dies half way see one or the other. The same batch
    again changes nothing: its records replace themselves, and its part of the
    ledger is written anew. A record that is rejected now leaves what is there.
    """
    spark = batch.sparkSession
    good, bad = checked(batch, taxids, taxonomy, levels)
    good = good.withColumn("batch", F.lit(name))
    known = versions(spark, path)
    if known:
        old = spark.read.parquet(f"{path}/records/v={known[-1]}")
        good = old.join(good.select("id"), "id", "left_anti").unionByName(good)
    bad.select("id", "reason").write.mode("overwrite").parquet(f"{path}/ledger/batch={name}")
    good.write.mode("overwrite").parquet(f"{path}/records/v={(known[-1] if known else 0) + 1}")
