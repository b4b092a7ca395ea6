"""The whole assignment: from query sequences and a database to probabilities for every rank."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions import lineage as L
from cladewise.functions import sequence as S
from cladewise.operators import alignment as A
from cladewise.operators import homology as H
from cladewise.operators import rollup as R
from cladewise.operators import selection as X
from cladewise.operators import tables as T
from cladewise.operators import tree_sets as M
from cladewise.operators import trees as N
from cladewise.operators.lineage_cut import cut
from cladewise.plans.adapters import BASES, MAP_FROM, MAP_TO
from cladewise.plans.registry import PluginNotFoundError, Plugins, query, table
from cladewise.sources import files


@dataclass(frozen=True)
class AssignConfig:
    """Options, with their usual values. Cut-offs are put in order, each once."""

    quotas: X.Quotas = field(default_factory=lambda: X.Quotas(minidentity=0.95))
    most_hits: int = 200
    kmer: int = 8
    word: int | None = None
    stride: int = 4
    minsignificance: float = 10.0
    common: int | None = None
    flanks: int = 0
    truncate: bool = True
    replicates: int = 1000
    prune_level: float = 0.0
    cutoffs: tuple[int, ...] = (95,)
    levels: tuple[str, ...] = L.MAIN
    minimaltaxonomy: int = 5
    subspecieslevel: bool = False
    exclude: tuple[str, ...] = ()
    force_include: tuple[str, ...] = ()
    force_exclude: tuple[str, ...] = ()
    forceidentity: float = 0.9
    database: str = "seeds"
    alignment: str = "to-query"
    assignment: str = "neighbour-joining"
    constrained: bool = True
    seed: int = 1

    def __post_init__(self) -> None:
        if any(c < 50 for c in self.cutoffs):
            raise ValueError("cutoffs are 50 or more")
        if self.quotas.fill_in not in ("balanced", "all", "none"):
            raise ValueError("fill_in is balanced, all or none")
        if not 0 <= self.prune_level <= 1 or self.replicates < 1 or self.kmer < 1 or self.stride < 1 or self.flanks < 0:
            raise ValueError("prune_level is a share; replicates, kmer and stride are at least 1, flanks at least 0")
        if self.word is not None and not 4 <= self.word <= H.MOST_K:
            raise ValueError(f"word is 4 to {H.MOST_K} bases")
        object.__setattr__(self, "cutoffs", tuple(sorted(set(self.cutoffs))))
        object.__setattr__(self, "force_include", tuple(x for x in dict.fromkeys(self.force_include) if x not in self.force_exclude))


def _prealigned(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("aligned", F.col("seq"))


def _by_kmers(queries: DataFrame, records: DataFrame, config: AssignConfig) -> DataFrame:
    return X.kmer_search(queries, records, config.kmer, config.most_hits).withColumn("significance", F.lit(0.0))


def _by_seeds(queries: DataFrame, records: DataFrame, config: AssignConfig) -> DataFrame:
    """The index is built once; its records are those of this run."""
    index = H.build_index(records, k=config.word, stride=config.stride)
    return H.search(queries, index, most_evalue=config.minsignificance, common=config.common)


_by_seeds.every_hit = True

#: A database gives query, id, score, significance and ord, the first hits of every query, for queries (id, seq, left_out) and records (id, seq, names): no records that bear a name that the query leaves out. One that has the attribute ``every_hit`` is asked once and gives all hits up to its E-value; where it also gives places and strands, records are cut to the part beside the query.
PLUGINS = Plugins()
PLUGINS.add("database", "kmer", _by_kmers)
PLUGINS.add("database", "seeds", _by_seeds)
PLUGINS.add("alignment", "to-query", A.align_to_query)
PLUGINS.add("alignment", "star", A.star_alignment)
PLUGINS.add("alignment", "map", A.map_to_aligned)
PLUGINS.add("alignment", "prealigned", _prealigned)
PLUGINS.add("assignment", "neighbour-joining", lambda aligned, sets, config: N.bootstrap_splits(aligned, config.replicates, sets, config.seed))


def database_records(spark: SparkSession, name: str) -> DataFrame:
    """id, lineage, organism, seq: of a registered database of records by name, or of a database FASTA at a path; else it raises."""
    try:
        return PLUGINS.find("records", name)(spark)
    except PluginNotFoundError:
        if not files.exists(spark, name):
            raise
    good, _ = files.native_records(files.fasta(spark, name))
    return good.withColumnRenamed("sequence", "seq")


def _identities(pairs: DataFrame) -> DataFrame:
    """Adds ``identity``: the similarity of query_seq and seq as they are aligned."""
    return A.align_to_query(pairs).withColumn("identity", S.similarity(F.col("aligned"), F.col("query_seq"))).drop("aligned")


def assign(queries: DataFrame, records: DataFrame, config: AssignConfig = AssignConfig(), constraints: DataFrame | None = None) -> dict[str, DataFrame]:
    """queries: id, seq. records: id, seq, organism, lineage. Returns duplicates, selected, clades, sisters, summary, posterior, counters, failed.

    constraints: left, right, ids of records that stand on two sides of a split,
    as ``files.constraints`` reads them: a list from the options. They hold in
    every query's trees, beside the groups of the taxonomy.

    Each stage is a DataFrame; queries run in parallel all the way, and
    replicates of one query as well. Records with fewer levels than
    ``minimaltaxonomy`` or with an excluded name take no part.
    """
    clean = queries.select("id", S.clean_query(F.col("seq")).alias("seq")).filter("seq <> ''")
    all_ = T.first_of_equal(clean, "seq", ["id"], "id")
    unique = all_.filter("id = representative").select("id", S.ungapped(F.col("seq")).alias("seq"))
    by_id = unique.select(F.col("id").alias("query"), F.col("seq").alias("query_seq"))
    records = records.filter(L.minimal(F.col("lineage"), config.minimaltaxonomy)).withColumn("lineage", L.subspecies_rule(F.col("lineage"), config.subspecieslevel))
    if config.exclude:
        records = records.filter(~F.arrays_overlap(F.transform("lineage", lambda e: e["name"]), F.array(*map(F.lit, config.exclude))))
    records = cut(records)  # read again by each step below
    level = {k: L.name_at(F.col("lineage"), k) for k in L.MAIN}
    ranked = records.select("id", "seq", F.coalesce(L.species_tag(level["species"], L.name_at(F.col("lineage"), "subspecies"), config.subspecieslevel), F.col("organism")).alias("species"), *(level[k].alias(k) for k in ("genus", "family", "order", "class", "phylum")))
    names = F.array_compact(F.array("species", *(r for r, _ in X.RANKS)))
    searched = ranked.select("id", "seq", names.alias("names"))
    excluded = records.filter(F.col("id").isin(*config.force_exclude)).select("id") if config.force_exclude else None

    find = PLUGINS.find("database", config.database)

    def first_identities(found: DataFrame) -> DataFrame:
        """Hits with the identity of each query's first, which decides whether there is anything like it."""
        if not config.quotas.minidentity > 0:
            return found.withColumn("identity", F.lit(None).cast("double"))
        others = found.filter("id <> query") if excluded is None else X.include_minus_exclude(found.filter("id <> query"), excluded, "id")
        first = X.top(others, ["query"], [F.col("ord"), F.col("id")], 1).select("query", "id", "seq").join(by_id, "query")
        return found.join(_identities(first).select("query", "id", "identity"), ["query", "id"], "left")

    def search(going: DataFrame | None) -> DataFrame:
        asked = unique.withColumn("left_out", F.array().cast("array<string>")) if going is None else unique.join(going.select(F.col("query").alias("id"), F.col("names").alias("left_out")), "id")
        found = find(asked, searched, config).join(ranked, "id").withColumn("score", F.col("score").cast("double"))
        return first_identities(cut(found)) if going is None else found.withColumn("identity", F.lit(None).cast("double"))

    def every_hit() -> DataFrame:
        found = find(unique, searched, config).join(ranked, "id").withColumn("score", F.col("score").cast("double"))
        if "q_start" in found.columns and config.truncate and config.alignment not in ("prealigned", "map"):
            found = H.windowed(found.join(by_id.select("query", F.length("query_seq").alias("m")), "query"), config.flanks)
        return first_identities(cut(found))

    forced = None
    if config.force_include:  # a list of the options, so a handful of records
        pairs = ranked.filter(F.col("id").isin(*config.force_include)).crossJoin(by_id).filter("id <> query")
        forced = _identities(pairs).filter(F.col("identity") >= config.forceidentity).withColumn("ord", F.lit(0)).withColumn("significance", F.lit(0.0))
    hits = every_hit() if getattr(find, "every_hit", False) else search
    selected = cut(X.select_homologues(hits, config.quotas, config.most_hits, forced=forced, excluded=excluded))
    chosen = selected.filter("status = 'ok'")
    pairs = chosen.join(records.select("id", "lineage"), "id").join(by_id, "query")
    aligned = PLUGINS.find("alignment", config.alignment)(pairs)
    aligned = cut(aligned.select("query", "query_seq", "id", "aligned", "lineage"))
    rows = aligned.select("query", F.col("id").alias("name"), "aligned", "lineage").unionByName(aligned.select("query", F.col("query").alias("name"), F.col("query_seq").alias("aligned"), F.array().cast(L.ENTRY_ARRAY).alias("lineage")).distinct())
    groups = rows.select("query", F.col("name").alias("leaf"), F.inline("lineage")).filter(F.col("level") != "species")
    sets = groups.groupBy("query", "level", "name").agg(F.sort_array(F.collect_set("leaf")).alias("members")).filter(F.size("members") > 1).select("query", "members") if config.constrained else None
    if constraints is not None:
        asked = rows.select("query").distinct().crossJoin(constraints.select(F.col("left").alias("members"), F.col("right").alias("others")))  # a list from the options for each query
        sets = asked if sets is None else sets.withColumn("others", F.lit(None).cast("array<string>")).unionByName(asked)
    clades = cut(PLUGINS.find("assignment", config.assignment)(A.drop_empty_columns(rows.select("query", "name", "aligned")), sets, config))
    sides = cut(sister_lineages(clades, rows))
    trees = cut(tree_lineages(clades, sides))
    summary = R.summarise(R.consolidate(trees, config.levels, config.prune_level))
    return {
        "duplicates": all_.filter("id <> representative"),
        "selected": selected.drop("seq"),
        "clades": N.split_names(clades, N.leaf_names(rows)) if "clades" in clades.columns else clades,
        "sisters": chosen_sisters(sides),
        "summary": summary,
        "posterior": R.posteriors(summary, R.tree_counts(trees)),
        "counters": R.summarise(trees.join(defining(sides, trees, clades, rows), ["query", "rep"]), "monophyletic", "ingroup") if "clades" in clades.columns else None,
        "failed": X.failed(queries.select("id"), chosen.select(F.col("query").alias("id")), all_.filter("id <> representative").select("id"), "id"),
    }


def reports(out: dict[str, DataFrame], names: DataFrame, config: AssignConfig = AssignConfig()) -> dict[str, DataFrame]:
    """The report tables of an assignment: assignments, taxon_probabilities and querylist. names: file, query, orig."""
    cuts = names.sparkSession.createDataFrame([(c,) for c in config.cutoffs], "cutoff int")
    post = out["posterior"]
    significant = out["selected"].groupBy("query").agg(F.count_if(F.col("status") == "ok").alias("nr_signif"))
    trees = post.groupBy("query").agg(F.max("n_trees").alias("n_trees"))
    homologue = N.lowest_share(N.occurrence_share(N.sister_occurrence(out["sisters"]), trees)).withColumnRenamed("lowest", "min_homol")
    taxon = R.leaves(post).groupBy("query").agg(F.min("prob").alias("min_taxon"))
    table_ = R.assignment_table(R.significant_ranks(post, cuts)).join(significant, "query", "left").join(homologue, "query", "left").join(taxon, "query", "left")
    probabilities = post.filter(F.col("level").isin(*L.MAIN)).groupBy("query", "level", "name").agg(F.sum("cnt").alias("cnt"), F.max("n_trees").alias("n")).select("query", "level", "name", (F.col("cnt").cast("double") / F.col("n")).alias("prob"))
    return {
        "assignments": names.join(table_, "query").select("file", "cutoff", "query", "orig", *L.MAIN, "nr_signif", "min_homol", "min_taxon"),
        "taxon_probabilities": names.join(probabilities, "query").select("file", "orig", "level", "name", "prob"),
        "querylist": names.select("file", "query", "orig"),
    }


def set_lineages(sets: DataFrame, leaves: DataFrame, rows: DataFrame) -> DataFrame:
    """query, sister, lineage: what the leaves of each distinct bit set have in common. Replicates share most sets, so each is looked at once."""
    each = sets.select("query", "sister").distinct().join(leaves, "query").select("query", "sister", F.explode(N.named(F.col("sister"), F.col("names"))).alias("name"))
    return R.consensus(each.join(rows.select("query", "name", "lineage"), ["query", "name"]), ["query", "sister"])


def sister_lineages(clades: DataFrame, rows: DataFrame) -> DataFrame:
    """query, rep, side, sister (bits), names, lineage: what the query's sister group has in common, for either rooting of each tree. clades: by name, or as bit sets."""
    leaves = N.leaf_names(rows).withColumn("leaf", F.col("query"))
    splits = clades if "clades" in clades.columns else N.as_splits(clades, leaves)
    sides = cut(N.sister_sets(splits, leaves))
    common = cut(set_lineages(sides, leaves, rows))
    return sides.join(common, ["query", "sister"], "left").join(leaves, "query").select("query", "rep", "side", "sister", N.named(F.col("sister"), F.col("names")).alias("names"), F.coalesce("lineage", F.array().cast(L.ENTRY_ARRAY)).alias("lineage"))


def _both(sides: DataFrame) -> DataFrame:
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return sides.groupBy("query", "rep").agg(of(0, "lineage").alias("a"), of(1, "lineage").alias("b"), of(0, "names").alias("names_a"), of(1, "names").alias("names_b"))


def tree_lineages(clades: DataFrame, sides: DataFrame) -> DataFrame:
    """query, rep, lineage: of each tree the more specific lineage of the two rootings; trees without one have an empty lineage."""
    none = F.array().cast(L.ENTRY_ARRAY)
    found = _both(sides).select("query", "rep", L.more_specific(F.coalesce("a", none), F.coalesce("b", none)).alias("lineage"))
    every = clades.select("query", "rep").distinct()
    return every.join(found, ["query", "rep"], "left").select("query", "rep", F.coalesce("lineage", none).alias("lineage"))


def defining(sides: DataFrame, trees: DataFrame, clades: DataFrame, rows: DataFrame) -> DataFrame:
    """query, rep, monophyletic, ingroup of every tree with a sister group: whether the lowest group that defines its lineage is, with the query, one side of a split, and holds more than the sister group."""
    size = F.size(F.coalesce("lineage", F.array().cast(L.ENTRY_ARRAY)))
    one = sides.groupBy("query", "rep").agg(F.min_by("sister", F.struct(-size, "side")).alias("sister"))
    low = F.try_element_at("lineage", F.lit(-1))
    chosen = one.join(trees.select("query", "rep", low["level"].alias("level"), low["name"].alias("name")), ["query", "rep"])
    groups = rows.select("query", F.col("name").alias("leaf"), F.inline("lineage")).select("query", "level", "name", "leaf")
    return M.defining_groups(chosen, clades, groups, N.leaf_names(rows).withColumn("leaf", F.col("query")))


def chosen_sisters(sides: DataFrame) -> DataFrame:
    """query, rep, sister: the names of the more specific rooting's sister group, of both where they are as specific."""
    a, b = F.size("a"), F.size("b")
    both = F.array_union(F.coalesce("names_a", F.array().cast("array<string>")), F.coalesce("names_b", F.array().cast("array<string>")))
    return _both(sides).select("query", "rep", F.when(a > b, F.col("names_a")).when(b > a, F.col("names_b")).otherwise(both).alias("sister"))


#: The odd factors of xxhash64.
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5 + 4)]


def _hashed(i: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a column of which ``seed`` is the hash, and an int."""
    h = (seed.view(np.uint64) + _P[3]) ^ (i.astype(np.uint64) * _P[0])
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P[1] + _P[2]
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return (h ^ h >> np.uint64(32)).view(np.int64)


_ACGT = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 4, np.uint8)
_CODE[_ACGT] = range(4)


def _changed(seq, share: float, *key):
    """A sequence with about this share of its bases replaced, by a hash of key and place. All of a batch's bases at a time."""

    def run(x: pd.Series, seed: pd.Series) -> pd.Series:
        texts = [v or "" for v in x]
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        h = _hashed(at, np.repeat(seed.to_numpy(np.int64), size)) % 3000
        other = (h % 3).astype(np.uint8)
        text = np.where(h < 3000 * share, _ACGT[other + (other >= _CODE[flat])], flat).tobytes().decode()
        end = np.cumsum(size).tolist()
        return pd.Series([None if v is None else text[e - n : e] for v, e, n in zip(x, end, size.tolist(), strict=True)], dtype=object)

    run.__annotations__ = {"x": pd.Series, "seed": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(seq, F.xxhash64(F.concat_ws(":", *(k.cast("string") for k in key))))


def _families(spark, d):
    """Queries (id, seq) and records (id, seq, organism, lineage): each item stands for a family, whose customers are individuals of its genera and species. Every third record is stored turned, every fifth between other bases."""
    items = table(spark, d, "benchmark").select("item_id", _letters("text").alias("base")).filter(F.length("base") >= 60)
    items = items.withColumn("i", F.row_number().over(Window.orderBy("item_id")) - 1)  # the items, a small table
    items = cut(items)
    n = max(1, items.count())
    g, s = F.col("g"), F.col("s")
    each = items.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4))))
    kinds = cut(each.select("item_id", "i", "g", "s", _changed(_changed(F.col("base"), 0.04, F.lit("g"), F.col("i"), g), 0.015, F.lit("s"), F.col("i"), g, s).alias("base")))  # 30 of each item, so customers need not work them out
    own = kinds.filter((g == F.col("i") % 6) & (s == F.col("i") % 5))
    queries = own.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), _changed(F.col("base"), 0.01, F.lit("q"), F.col("i")).alias("seq"))
    key, turn = F.col("c_custkey"), F.floor(F.col("c_custkey") / n)
    c = table(spark, d, "customer").select(key, (key % n).alias("_i"), (turn % 6).alias("_g"), (F.floor(turn / 6) % 5).alias("_s"))
    x = A.spread(c, "c_custkey").join(F.broadcast(kinds), (F.col("_i") == F.col("i")) & (F.col("_g") == g) & (F.col("_s") == s))
    seq = _changed(F.col("base"), 0.005, F.lit("c"), key)
    seq = F.when(key % 3 == 0, S.reverse_complement(seq)).otherwise(seq)
    around = F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    seq = F.when(key % 5 == 0, F.concat(around, seq, F.reverse(around))).otherwise(seq)
    name = lambda kind, *parts: F.concat(F.lit(f"{kind} "), F.concat_ws(".", *(F.floor(p).cast("string") for p in parts)))
    i = F.col("i")
    lineage = L.from_columns(phylum=F.lit("Texts"), **{"class": name("Class", i / 16)}, order=name("Order", i / 4), family=name("Family", i), genus=name("Genus", i, g), species=name("Genus", i, g, s))
    return queries, x.select(F.concat(F.lit("r"), key.cast("string")).alias("id"), seq.alias("seq"), name("Genus", i, g, s).alias("organism"), lineage.alias("lineage"))


@query()
def assign_end_to_end(spark, d):
    """All items as queries through every stage, with the usual options, against records that Spark derives from items and customers. Tests compare with planted trees and a plain run of each step."""
    return assign(*_families(spark, d))["posterior"].select("query", "path", "cnt", "n_trees", "prob")


def _letters(column: str):
    return S.mapped(F.col(column), BASES)


_SEQ = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{MAP_FROM}', '{MAP_TO}')"
SEED_SQL = f"""WITH r AS (SELECT doc_id AS id, {_SEQ} AS seq FROM documents),
q0 AS (SELECT item_id AS query, {_SEQ} AS seq FROM benchmark),
q AS (SELECT query, 1 AS strand, seq FROM q0 UNION ALL SELECT query, -1, translate(reverse(seq), 'AGTC', 'TCAG') FROM q0),
n AS (SELECT sum(length(seq))::BIGINT AS n FROM r),
w AS (SELECT min(k) AS k FROM (SELECT unnest(range(11, 32)) AS k), n WHERE k = 31 OR pow(4, k) >= 16 * n),
rs AS (SELECT id, a AS pos, substr(seq, a::INT + 1, k::INT) AS seed FROM (SELECT id, seq, k, unnest(range(0, length(seq) - k + 1, 4)) AS a FROM r, w)),
qs AS (SELECT query, strand, a AS pos, substr(seq, a::INT + 1, k::INT) AS seed FROM (SELECT query, strand, seq, k, unnest(range(0, length(seq) - k + 1)) AS a FROM q, w)),
qg AS (SELECT * FROM qs WHERE substr(seed, 2) <> substr(seed, 1, length(seed) - 1) AND substr(seed, 3) <> substr(seed, 1, length(seed) - 2) AND substr(seed, 4) <> substr(seed, 1, length(seed) - 3)),
p AS (SELECT query, strand, id, rs.pos - qg.pos AS diagonal, qg.pos AS pos FROM qg JOIN rs ON rs.seed = qg.seed),
g AS (SELECT *, coalesce(pos - lag(pos) OVER d > 40, true)::INT AS new FROM p WINDOW d AS (PARTITION BY query, strand, id, diagonal ORDER BY pos)),
g2 AS (SELECT *, sum(new) OVER (PARTITION BY query, strand, id, diagonal ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g),
i AS (SELECT query, strand, id, diagonal, island, min(pos) AS a, max(pos) + (SELECT k FROM w) AS b FROM g2 GROUP BY ALL),
s AS (SELECT i.*, length(q.seq) AS m, unnest(range(greatest(0, -diagonal), least(length(q.seq), length(r.seq) - diagonal))) AS x, q.seq AS qq, r.seq AS rr FROM i JOIN q ON q.query = i.query AND q.strand = i.strand JOIN r ON r.id = i.id),
e AS (SELECT query, strand, id, diagonal, island, a, b, m, x, CASE WHEN substr(qq, x::INT + 1, 1) = substr(rr, (x + diagonal)::INT + 1, 1) THEN 1 ELSE -2 END AS v FROM s),
c AS (SELECT query, strand, id, diagonal, island, a, b, m, sum(v) AS core FROM e WHERE x >= a AND x < b GROUP BY ALL),
side AS (SELECT *, x >= b AS onward, CASE WHEN x >= b THEN x ELSE -x END AS far FROM e WHERE x >= b OR x < a),
run AS (SELECT *, sum(v) OVER (PARTITION BY query, strand, id, diagonal, island, onward ORDER BY far ROWS UNBOUNDED PRECEDING) AS total FROM side),
top AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY query, strand, id, diagonal, island, onward ORDER BY far ROWS UNBOUNDED PRECEDING)) AS best FROM run),
fall AS (SELECT *, max((best - total > 20)::INT) OVER (PARTITION BY query, strand, id, diagonal, island, onward ORDER BY far ROWS UNBOUNDED PRECEDING) AS fallen FROM top),
o AS (SELECT query, strand, id, diagonal, island, onward, max(total) AS gain, min_by(far, (-total, far)) AS far FROM fall WHERE fallen = 0 GROUP BY ALL HAVING max(total) > 0),
h AS (SELECT DISTINCT c.query, c.strand, c.id, c.diagonal, c.m, coalesce(-l.far, c.a) AS a, coalesce(r2.far + 1, c.b) AS b, core + coalesce(l.gain, 0) + coalesce(r2.gain, 0) AS raw
  FROM c LEFT JOIN o l ON l.query = c.query AND l.strand = c.strand AND l.id = c.id AND l.diagonal = c.diagonal AND l.island = c.island AND NOT l.onward
  LEFT JOIN o r2 ON r2.query = c.query AND r2.strand = c.strand AND r2.id = c.id AND r2.diagonal = c.diagonal AND r2.island = c.island AND r2.onward),
f AS (SELECT *, CASE WHEN strand = 1 THEN a ELSE m - b END AS q_start, a + diagonal AS s_start, b - a AS len FROM h, n WHERE 0.620991 * m * n * exp(-1.33271 * raw) <= 10),
z AS (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY raw DESC, strand DESC, q_start, s_start) AS i, count(*) OVER (PARTITION BY query, id) AS segments FROM f)
SELECT query, id, strand::BIGINT AS strand, q_start::BIGINT AS q_start, s_start::BIGINT AS s_start, len::BIGINT AS length, raw::BIGINT AS raw, segments::BIGINT AS segments, row_number() OVER (PARTITION BY query ORDER BY raw DESC, id)::BIGINT AS ord FROM z WHERE i = 1"""


@query(SEED_SQL)
def seed_extend_hits(spark, d):
    """All items searched in all documents on both strands: the best segment of every pair up to the E-value."""
    records = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(_letters("text"), F.lit("")).alias("seq"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.coalesce(_letters("text"), F.lit("")).alias("seq"))
    found = H.search(queries, H.build_index(records))
    whole = lambda c: F.col(c).cast("long")
    return found.select("query", "id", whole("s_strand").alias("strand"), whole("q_start").alias("q_start"), whole("s_start").alias("s_start"), whole("q_len").alias("length"), whole("raw").alias("raw"), "segments", whole("ord").alias("ord"))
