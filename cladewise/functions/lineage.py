"""Column functions on lineages: arrays of struct<rank, level, name>, ordered by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The levels in order, the first is rank 1.
LEVELS = (
    "superkingdom", "kingdom", "subkingdom", "superphylum", "phylum", "subphylum", "superclass", "class", "subclass", "infraclass",
    "supercohort", "cohort", "subcohort", "infracohort", "superorder", "order", "suborder", "infraorder", "parvorder", "superfamily",
    "family", "subfamily", "supertribe", "tribe", "subtribe", "supergenus", "genus", "subgenus", "species group", "species subgroup",
    "species", "subspecies", "varietas", "otu",
)
MAIN = ("phylum", "class", "order", "family", "genus", "species")
ENTRY = "struct<rank:int,level:string,name:string>"
ENTRY_ARRAY = f"array<{ENTRY}>"


def rank_of(level: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def ranks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(LEVELS, 1)], "level string, rank int")


def entry(level: str, name: Column) -> Column:
    return F.struct(F.lit(LEVELS.index(level) + 1).alias("rank"), F.lit(level).alias("level"), name.alias("name"))


def from_columns(**names: Column) -> Column:
    """A lineage from a column for each level; null names are left out."""
    return F.array_sort(F.filter(F.array(*(entry(k, v) for k, v in names.items())), lambda e: e["name"].isNotNull()))


def parse(text: Column) -> Column:
    """From ``level: name, level: name``; null unless every part has exactly one colon and a known level."""
    parts = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.split(p, r"\s*:\s*"))
    good = F.forall(parts, lambda p: (F.size(p) == 2) & rank_of(p[0]).isNotNull())
    made = F.transform(parts, lambda p: F.struct(rank_of(p[0]).alias("rank"), p[0].alias("level"), F.get(p, F.lit(1)).alias("name")))
    return F.when(good, F.array_sort(made))


def render(lineage: Column) -> Column:
    return F.array_join(F.transform(lineage, lambda e: F.concat(e["level"], F.lit(": "), e["name"])), ", ")


def name_at(lineage: Column, level: str) -> Column:
    return F.get(F.transform(F.filter(lineage, lambda e: e["level"] == level), lambda e: e["name"]), F.lit(0))


def level_of(lineage: Column, name: Column) -> Column:
    return F.get(F.transform(F.filter(lineage, lambda e: e["name"] == name), lambda e: e["level"]), F.lit(0))


def contains(lineage: Column, name: Column) -> Column:
    return F.exists(lineage, lambda e: e["name"] == name)


def without(lineage: Column, level: str) -> Column:
    return F.filter(lineage, lambda e: e["level"] != level)


def merge(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def common(a: Column, b: Column) -> Column:
    """Entries that both have: same level and same name. A missing level is no match."""
    return F.array_sort(F.array_intersect(a, b))


def more_specific(a: Column, b: Column) -> Column:
    """The longer of two lineages; of two as long, what they have in common."""
    return F.when(F.size(a) > F.size(b), a).when(F.size(b) > F.size(a), b).otherwise(common(a, b))


def escaped(name: Column) -> Column:
    """A name as part of a path: its slashes do not count as steps."""
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def path(lineage: Column) -> Column:
    """``level:name`` joined by slashes, those of names escaped; of a prefix, a key that sorts parents before children."""
    return F.array_join(F.transform(lineage, lambda e: F.concat(e["level"], F.lit(":"), escaped(e["name"]))), "/")


def prefixes(lineage: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(lineage)), lambda i: F.slice(lineage, F.lit(1), i))


def minimal(lineage: Column, least: int = 5) -> Column:
    return F.size(lineage) >= least


def two_words(s: Column) -> Column:
    return F.substring_index(s, " ", 2)


def same_species(a: Column, b: Column) -> Column:
    return two_words(a) == two_words(b)


def subspecies_rule(lineage: Column, subspecies_level: bool) -> Column:
    """Without subspecies where these do not count; where they do, a human without one gets the usual one."""
    if not subspecies_level:
        return without(lineage, "subspecies")
    bare = (name_at(lineage, "species") == "Homo sapiens") & name_at(lineage, "subspecies").isNull()
    return F.when(F.coalesce(bare, F.lit(False)), F.array_sort(F.concat(lineage, F.array(entry("subspecies", F.lit("Homo sapiens sapiens")))))).otherwise(lineage)


def species_tag(species: Column, subspecies: Column, subspecies_level: bool) -> Column:
    """Subspecies where these count and there is one; a human is always the species."""
    if not subspecies_level:
        return species
    return F.when(species == "Homo sapiens", species).otherwise(F.coalesce(subspecies, species))
