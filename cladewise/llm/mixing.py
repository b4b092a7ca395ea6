"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on; their
shares of all words stop at ``most`` times the source's own size, and what is
over goes to the others by weight. This is one level L with
``target = min(L * weight, most * size)``, found from running sums over the
sources in order of ``size / weight``.

Each document gets the exponential key ``-ln(u) / w``: u is a hash of its id, w
its quality weight. A source is taken whole as often as its target allows;
the rest of the budget goes down its documents in order of key, and the last
one of these is taken in part, so a source's words meet its target.

No task sorts a whole source. Keys fall into bins, sqrt(n) for each doubling of
the key of a source of n documents: whatever the weights, a bin holds about a
quarter of sqrt(n). Sums of bins find the one bin in which the budget ends, and
only that bin's documents are sorted, alike ones (of one key, id and size) as
one with a count. The tables of sources and bins are small and are written out;
Spark broadcasts them if they are below its threshold.

Defined results: a null text has size 0 and takes 0; null ids share one draw;
repeated rows are taken as separate documents that happen to have one key (tied
keys go by id, then size, then alike rows in order of the table); an empty
table gives no rows; other columns, whatever their names, are kept by
``mixed_documents`` and do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D; of null, 0."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda x: x != "")), F.lit(0)).cast("long")


def quality_weight(size: Column, text: Column) -> Column:
    """0.5 to 1.5: the nearer the characters of a word, its space included, to 6, the higher."""
    each = F.length(F.coalesce(text, F.lit(""))).cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.lit(0.5) + F.lit(1.0) / (F.lit(1.0) + F.abs(each - F.lit(6.0)))


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform in (0, 1), from the id alone: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", quality_col: str | None = None, whole: bool = False) -> DataFrame:
    """rid, _id, _source, _size and _key of each row, and row, all of its columns, if ``whole``. quality_col: weights instead of those from the length of words; null and NaN count as 1, others as 0.001 at least."""
    given = F.lit(None).cast("double") if quality_col is None else F.col(quality_col).cast("double")
    rows = docs.select(*([F.struct("*").alias("row")] if whole else []), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).cast("string").alias("_text"), given.alias("_given"))
    rows = rows.withColumn("_size", word_count(F.col("_text")))
    weight = quality_weight(F.col("_size"), F.col("_text")) if quality_col is None else F.greatest(F.coalesce(F.nanvl("_given", F.lit(1.0)), F.lit(1.0)), F.lit(0.001))
    return rows.select(F.monotonically_increasing_id().alias("rid"), *(["row"] if whole else []), "_id", "_source", "_size", (-F.log(draw(F.col("_id"), seed)) / weight).alias("_key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """_source, source_size, docs, target, epochs (whole passes), budget (words after these), bins."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_level = Window.orderBy(F.col("level"), F.col("place"))
    all_ = Window.partitionBy()
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = per.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("double"))
    full = F.lit(most) * F.col("source_size")
    ranked = (
        place.withColumn("level", full / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_))
        .withColumn("filled", F.sum(full).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("others", F.sum("weight").over(all_) - F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("stops", F.col("filled") + F.col("level") * F.col("others") <= F.col("total"))
    )
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), full)).over(all_), F.lit(0))
    share = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(all_)
    out = ranked.withColumn("_left", left).withColumn("_share", share)
    out = out.withColumn("target", F.when(F.col("stops"), full.cast("double")).otherwise(F.col("_left") / F.col("_share") * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).select("_source", "source_size", "docs", "target", "epochs", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("budget"), F.ceil(F.sqrt("docs")).alias("bins"))


def _bin(key: Column, bins: Column) -> Column:
    """Ascends with the key; the logarithm of an exponential draw has a density of at most 0.26 for each doubling, and a weight only shifts it."""
    return F.floor(F.log2(key) * bins)


def plan(sizes: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``targets`` with the bin in which each source's budget ends, and the words before it."""
    per = scratch.save(targets(sizes, **options))
    same = per.select(F.col("_source").alias("_s"), "bins", "budget")
    binned = sizes.join(same, F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_s", "budget", _bin(F.col("_key"), F.col("bins")).alias("last_bin")).agg(F.sum("_size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("_s").orderBy("last_bin").rowsBetween(Window.unboundedPreceding, 0))
    ends = binned.withColumn("before", running - F.col("words")).filter((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words"))).select("_s", "last_bin", "before")
    return scratch.save(per.join(scratch.save(ends), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("_source", "_of"))


def apply_plan(keyed: DataFrame, per_source: DataFrame) -> DataFrame:
    """The rows of ``with_keys``, a written table, with source_size, target, epochs, part (words of the last, partial pass) and taken."""
    own = ["rid", *(["row"] if "row" in keyed.columns else []), "_id", "_size", "source_size", "target", "epochs"]
    at = keyed.join(per_source, F.col("_source").eqNullSafe(F.col("_of")), "inner").withColumn("_bin", _bin(F.col("_key"), F.col("bins")))
    ends = F.coalesce(F.col("_bin") == F.col("last_bin"), F.lit(False))
    whole = at.filter(~ends).select(*own, F.when(F.col("_bin") < F.col("last_bin"), F.col("_size")).otherwise(0).cast("long").alias("part"))
    last, alike = at.filter(ends), ["_of", "_key", "_id", "_size"]
    order = Window.partitionBy("_of").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_size") * F.col("_n")
    sums = last.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.sum(words).over(order) - words)
    sums = sums.select(*(F.col(c).alias(f"{c}2") for c in alike), "_ahead")
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("rid")) - 1
    numbered = last.select("rid", *alike, "budget", "before").withColumn("_nth", nth).join(sums, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in alike])
    left = F.col("budget") - F.col("before") - F.col("_ahead") - F.col("_nth") * F.col("_size")
    parts = numbered.select(F.col("rid").alias("_rid"), F.greatest(F.lit(0), F.least(F.col("_size"), left)).cast("long").alias("part"))
    last = last.join(parts, F.col("rid") == F.col("_rid")).select(*own, "part")
    return whole.unionByName(last).withColumn("taken", F.col("epochs") * F.col("_size") + F.col("part"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = scratch.save(with_keys(docs, **options))
    out = apply_plan(keyed, plan(keyed, scratch))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")


PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole pass, and one with its first words for the partial pass.

    Rows are written once with their keys; a row is one column until the end, so no name of its columns matters.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    keyed = scratch.save(with_keys(docs, text_col=text_col, whole=True, **options))
    taken = apply_plan(keyed, plan(keyed, scratch))
    passes = F.concat(F.array_repeat("_size", F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = taken.select("row", "_size", F.explode(passes).alias("_words"))
    text = F.col("row").getField(text_col)
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") < F.col("_size"), head).otherwise(text)
    return rows.select(*((cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(coalesce(text, ''))::DOUBLE AS chars,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
d AS (SELECT *, -ln(u) / (0.5 + 1.0::DOUBLE / (1.0::DOUBLE + abs(chars / greatest(size, 1)::DOUBLE - 6.0::DOUBLE))) AS key FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
r AS (SELECT *, 3 * source_size / weight AS level, sum(source_size) OVER ()::DOUBLE AS total,
             sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS UNBOUNDED PRECEDING)::DOUBLE AS filled,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS UNBOUNDED PRECEDING) AS others FROM w),
c AS (SELECT *, filled + level * others <= total AS stops FROM r),
t AS (SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (total - coalesce(sum(CASE WHEN stops THEN 3 * source_size END) OVER (), 0)::DOUBLE) / sum(CASE WHEN NOT stops THEN weight END) OVER () * weight END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS budget FROM e),
x AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM x
"""
