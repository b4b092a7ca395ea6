"""Assignments that go on where an earlier run has ended, or died."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.plans.assignment import AssignConfig, assign
from cladewise.sources.files import exists

TABLES = ("selected", "posterior", "failed")


def fingerprint(records: DataFrame) -> str:
    """An order-free checksum of the records, from counts and sums of their hashes."""
    h = F.xxhash64("id", F.col("seq"), "organism", L.path(F.col("lineage")))
    r = records.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit((1 << 31) - 1))), F.bit_xor(h)).first()
    return ":".join(map(str, r))


def assign_more(path: str, queries: DataFrame, records: DataFrame, config: AssignConfig = AssignConfig()) -> dict[str, DataFrame]:
    """``assign`` of those queries that the ledger at the path does not know yet; returns selected, posterior and failed of all that are asked for, with run, the run that made each row.

    A query is known by the hash of its id and sequence, the options and the
    records: where one of these changes it is run again. Tables of a run are
    written first and its queries entered into the ledger last, so those of a
    run that died are not known, and its rows are never read.
    """
    spark = queries.sparkSession
    about = f"{config!r}|{fingerprint(records)}"
    keyed = queries.select("id", "seq", F.sha2(F.concat_ws("\x1f", "id", F.coalesce("seq", F.lit("")), F.lit(about)), 256).alias("key")).distinct()
    known = spark.read.schema("key string, run string").parquet(f"{path}/ledger") if exists(spark, f"{path}/ledger") else None
    todo = keyed if known is None else keyed.join(known, "key", "left_anti")
    if not todo.isEmpty():
        run = uuid.uuid4().hex
        out = assign(todo.select("id", "seq"), records, config)
        for name in TABLES:
            out[name].write.parquet(f"{path}/{name}/run={run}")
        todo.select("key", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/ledger")
    # Rows count by the run that the ledger names for their query.
    of_run = spark.read.schema("key string, run string").parquet(f"{path}/ledger").join(keyed.select("key", "id"), "key").select("run", "id").distinct()

    def rows(name: str) -> DataFrame:
        own = "id" if name == "failed" else "query"
        found = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        return found.join(of_run.withColumnRenamed("id", own), ["run", own], "left_semi")

    return {name: rows(name) for name in TABLES}
