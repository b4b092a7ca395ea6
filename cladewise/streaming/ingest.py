"""Streams of sequence records, an extension: first copies only, and summaries that grow by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions import sequence as S
from cladewise.operators import rollup as R


def records(spark: SparkSession, path: str, schema: str = "id string, sequence string, seen timestamp") -> DataFrame:
    """A folder of Parquet files as a stream of cleaned records."""
    return spark.readStream.schema(schema).parquet(path).withColumn("sequence", S.clean_query(F.col("sequence"))).filter("sequence <> ''")


def first_copies(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first record of each sequence; what is remembered goes once it is older than ``delay``."""
    return stream.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["sequence"])


def grow_summary(trees: DataFrame, path: str, checkpoint: str):
    """Writes each batch's summary under its number; a batch that is run again overwrites its own part. ``read_summary`` adds the parts up."""

    def add(batch: DataFrame, number: int) -> None:
        R.summarise(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return trees.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return R.merge_summaries(spark.read.parquet(path).drop("batch"))
