"""Tables written to the folder that all executors share, to cut lineage.

The folder is what the session names in ``spark.checkpoint.dir``. Only where
that is unset and everything runs on one machine (tests, a laptop) a temporary
folder is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a new temporary one takes its place on a single machine that has none."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cladewise-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one run: ``save`` writes one and reads it back, ``drop`` removes one.

    A lost executor costs no more than the tasks that were running on it: what
    has been saved is read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.number = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.number:03d}"
        self.number += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
