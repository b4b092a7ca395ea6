"""Tables as sets of rows: duplicates, names, unions, positional joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators.lineage_cut import cut


def first_of_equal(df: DataFrame, key: str, order: list[str], ident: str) -> DataFrame:
    """Each row with its representative: the first row, in order, with an equal key.

    An aggregate and a join on the key's hash, not a window: a key that very many rows share is combined before the shuffle.
    """
    h = F.xxhash64(key)
    rep = df.groupBy(h.alias("_h"), F.col(key).alias("_k")).agg(F.min_by(ident, F.struct(*order)).alias("representative"))
    keyed = df.withColumn("_h", h)
    return keyed.join(rep.withColumnRenamed("_h", "_g"), (F.col("_h") == F.col("_g")) & (F.col(key) == F.col("_k"))).drop("_h", "_g", "_k")


def unique_names(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Later ones of names that differ in case only get ``_1``, ``_2`` and so on, passing over names that stand in the group already."""
    fold, suffix = F.lower(name), r"^(.*)_([0-9]{1,9})$"
    own = df.select(*by, fold.alias("_f")).distinct()
    # Numbers that are taken under each name: those of names that end in one.
    taken = own.select(*by, F.regexp_extract("_f", suffix, 1).alias("_f"), F.regexp_extract("_f", suffix, 2).alias("_t")).filter("_t <> ''")
    taken = taken.filter(F.col("_t") == F.col("_t").cast("int").cast("string")).groupBy(*by, "_f").agg(F.sort_array(F.collect_set(F.col("_t").cast("int"))).alias("_taken"))
    n = F.row_number().over(Window.partitionBy(*by, "_f").orderBy(*order)) - 1
    rows = df.withColumn("_f", fold).withColumn("_n", n).join(taken, [*by, "_f"], "left")
    # The n-th number that is free: each taken one at or below moves it up.
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda k, t: k + F.when((t > 0) & (t <= k), 1).otherwise(0))
    return rows.withColumn("unique_name", F.when(F.col("_n") > 0, F.concat(F.col(name), F.lit("_"), free.cast("string"))).otherwise(F.col(name))).drop("_f", "_n", "_taken")


def union_filled(*tables: DataFrame, fill: str = "NULL") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.select(*(F.col(c).cast("string") for c in t.columns)) for t in tables)).na.fill(fill)


def append_row(table: DataFrame, row: dict[str, str]) -> DataFrame:
    return union_filled(table, table.sparkSession.range(1).select(*(F.lit(str(v)).alias(k) for k, v in row.items())))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's position in order, from 1.

    Rows are dealt out by ranges and numbered within them; to these come the
    sizes of the ranges before, a table of one row for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def zip_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows side by side by position; columns of the left win. Both tables must have as many rows, else it raises when it runs."""
    a, b = numbered(left, left_order, "_i"), numbered(right, right_order, "_i").drop(*left.columns)
    out = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "_i", "full")
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    return out.withColumn("_i", F.when(wrong, F.raise_error(F.lit("tables differ in length"))).otherwise(F.col("_i"))).filter("_i > 0").drop("_i", "_a", "_b")


def with_membership(rows: DataFrame, table: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Adds ``found``: whether the table has a row whose columns (values of keys) equal the row's (keys), as stripped text."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    known = table.select(*(text(c).alias(f"_{i}") for i, c in enumerate(keys.values()))).distinct().withColumn("found", F.lit(True))
    on = reduce(lambda a, b: a & b, (text(k) == F.col(f"_{i}") for i, k in enumerate(keys)))
    return rows.join(known, on, "left").withColumn("found", F.coalesce("found", F.lit(False))).drop(*(f"_{i}" for i in range(len(keys))))


def has_row(table: DataFrame, row: dict[str, str]) -> bool:
    """Whether some row has all these values, as stripped text. An unknown column is in no row."""
    if not set(row) <= set(table.columns):
        return False
    one = table.sparkSession.createDataFrame([tuple(str(v) for v in row.values())], ", ".join(f"`{k}` string" for k in row))
    return with_membership(one, table, {k: k for k in row}).first()["found"]


def chunks(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """A number of chunk for each row, in order, ``size`` rows a chunk."""
    return numbered(df, order, "_i").withColumn("chunk", F.floor((F.col("_i") - 1) / size)).drop("_i")


def neighbours(df: DataFrame, by: list[str], order: list[str], *pass_on: str) -> DataFrame:
    """by, order and the columns of pass_on with those of the row before (``previous_``) and after it (``next_``) in its group.

    Rows are dealt out by ranges of group and order, so a large group is spread
    over tasks; the rows at the ends of ranges meet in a table of at most two
    rows for each range and group. Pass ids here and join wide columns by them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.select(*by, *order, *(c for c in pass_on if c not in (*by, *order))).repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))
    inside, across, row = Window.partitionBy("_p", *by).orderBy(*order), Window.partitionBy(*by).orderBy("_p"), F.struct(*pass_on)
    ends = dealt.groupBy("_p", *by).agg(F.min_by(row, F.struct(*order)).alias("_first"), F.max_by(row, F.struct(*order)).alias("_last"))
    ends = ends.select("_p", *by, F.lead("_first").over(across).alias("_after"), F.lag("_last").over(across).alias("_before"))
    same = [F.col("_p") == F.col("_q"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)]
    out = dealt.withColumn("_n", F.lead(row).over(inside)).withColumn("_l", F.lag(row).over(inside)).join(ends.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_{c}") for c in by), "_after", "_before"), same, "left")
    out = out.withColumn("_n", F.coalesce("_n", "_after")).withColumn("_l", F.coalesce("_l", "_before"))
    return out.select(*dict.fromkeys([*by, *order, *pass_on]), *(F.col(f"_l.{c}").alias(f"previous_{c}") for c in pass_on), *(F.col(f"_n.{c}").alias(f"next_{c}") for c in pass_on))
