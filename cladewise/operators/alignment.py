"""Alignments: sites, patterns, pairwise global alignment to a query, distances."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions import sequence as S
from cladewise.operators.lineage_cut import cut


def sites(aligned: DataFrame) -> DataFrame:
    """query, name, site, base."""
    return aligned.select("query", "name", F.posexplode(F.split("aligned", ""))).toDF("query", "name", "site", "base").filter("base <> ''")


def drop_empty_columns(aligned: DataFrame) -> DataFrame:
    """Without the sites at which every sequence of the query's alignment has a gap.

    Which sites are used is one bit string for each sequence, combined by an
    aggregate; no table of sites is shuffled but the distinct used ones.
    """
    used = sites(aligned).filter("base <> '-'").select("query", "site").distinct()
    kept = used.groupBy("query").agg(F.sort_array(F.collect_list("site")).alias("kept"))
    return aligned.join(kept, "query").withColumn("aligned", F.array_join(F.transform("kept", lambda i: F.substring("aligned", i + 1, F.lit(1))), "")).drop("kept")


def site_patterns(aligned: DataFrame) -> DataFrame:
    """query, pattern (a site's bases in order of name), cnt."""
    columns = sites(aligned).groupBy("query", "site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "base"))), lambda x: x["base"]), "").alias("pattern"))
    return columns.groupBy("query", "pattern").agg(F.count(F.lit(1)).alias("cnt"))


def align_pair(a: str, b: str, match: float = 1.0, mismatch: float = 0.0, gap_open: float = -10.0, gap_extend: float = -0.5, straight: bool = True) -> tuple[str, str, float]:
    """Global alignment with affine gaps, a row of the matrix at a time. One byte a cell is kept for the way back.

    Sequences of one length that differ in few places need no matrix: a gap in
    one asks for a gap in the other, and both cost more than all that differs.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    if straight and n == m:
        differ = int((x != y).sum())
        if differ * (match - mismatch) < -2 * gap_open:
            return a, b, match * (n - differ) + mismatch * differ
    low = -1e18
    best, gap_a = np.full(m + 1, low), np.full(m + 1, low)
    steps = np.arange(m + 1)
    best[0], best[1:] = 0.0, gap_open + gap_extend * steps[:-1]
    way = np.zeros((n + 1, m + 1), np.uint8)  # 0 both, 1 a alone, 2 b alone; 4: the gap in b goes on, 8: the gap in a does
    way[0, 1:] = 2 | 8
    for i in range(1, n + 1):
        opened = best + gap_open
        longer = gap_a + gap_extend > opened
        gap_a = np.where(longer, gap_a + gap_extend, opened)
        diagonal = np.full(m + 1, low)
        diagonal[1:] = best[:-1] + np.where(x[i - 1] == y, match, mismatch)
        row = np.maximum(diagonal, gap_a)
        # b alone: the best start of a gap that ends here, by a running maximum
        lead = np.concatenate(([low], row[:-1] + gap_open - gap_extend * steps[:-1]))
        run = np.maximum.accumulate(lead)
        where = np.maximum.accumulate(np.where(lead >= run, steps, 0))
        gap_b = run + gap_extend * (steps - 1)
        way[i] = np.where(gap_b > row, 2, np.where(gap_a > diagonal, 1, 0)) | 4 * longer | 8 * (where != steps)
        best = np.maximum(row, gap_b)
    out_a, out_b, i, j = [], [], n, m
    while i or j:
        if i == 0 or (j and way[i, j] & 3 == 2):
            going = True
            while going and j:
                going = i == 0 or bool(way[i, j] & 8)
                out_a.append("-")
                out_b.append(b[j - 1])
                j -= 1
        elif j == 0 or way[i, j] & 3 == 1:
            while i > 1 and way[i, j] & 4 and j:
                out_a.append(a[i - 1])
                out_b.append("-")
                i -= 1
            out_a.append(a[i - 1])
            out_b.append("-")
            i -= 1
        else:
            out_a.append(a[i - 1])
            out_b.append(b[j - 1])
            i, j = i - 1, j - 1
    return "".join(out_a)[::-1], "".join(out_b)[::-1], float(best[m])


def align_to_query(pairs: DataFrame) -> DataFrame:
    """Adds ``aligned``: the record aligned to the query, columns that are gaps in the query removed. pairs: query_seq, seq."""

    def one(q: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(q, s, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            x, y, _ = align_pair(a, b)
            out.append("".join(d for c, d in zip(x, y, strict=True) if c != "-"))
        return pd.Series(out, dtype=object)

    return spread(pairs, "query_seq", "seq").withColumn("aligned", F.pandas_udf(one, "string")("query_seq", "seq"))


def insertions(pairs: DataFrame) -> DataFrame:
    """Adds letters, a record's site for each of the query's, and ins, what the record has before each of these and behind the last. pairs: query_seq, seq."""
    kind = "struct<letters:string,ins:array<string>>"

    def one(q: pd.Series, s: pd.Series) -> pd.DataFrame:
        letters, ins = [], []
        for a, b in zip(q, s, strict=True):
            x, y, _ = align_pair(a or "", b or "")
            own, before = [], [[]]
            for c, d in zip(x, y, strict=True):
                if c == "-":
                    before[-1].append(d)
                else:
                    own.append(d)
                    before.append([])
            letters.append("".join(own))
            ins.append(["".join(part) for part in before])
        return pd.DataFrame({"letters": letters, "ins": ins})

    return spread(pairs, "query_seq", "seq").withColumn("_p", F.pandas_udf(one, kind)("query_seq", "seq")).withColumn("letters", F.col("_p.letters")).withColumn("ins", F.col("_p.ins")).drop("_p")


def gap_profile(parts: DataFrame, truncate: bool = True) -> DataFrame:
    """query, room: the longest insertion before each site of the query and behind the last, over all of its records; 0 at both ends where the alignment is cut to the query. One aggregate over the insertions there are. parts: query, letters, ins."""
    n = parts.groupBy("query").agg(F.max(F.length("letters")).alias("n"))
    long = parts.select("query", F.posexplode(F.transform("ins", F.length)).alias("at", "size")).filter("size > 0").groupBy("query", "at").agg(F.max("size").alias("size"))
    some = long.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("m"))  # at most a query's sites
    ends = lambda i: (i == 0) | (i == F.col("n")) if truncate else F.lit(False)
    room = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(ends(i), 0).otherwise(F.coalesce(F.try_element_at("m", i), F.lit(0))))
    return n.join(some, "query", "left").select("query", room.alias("room"))


def spliced(letters: Column, ins: Column, room: Column) -> Column:
    """A row with its insertions and gaps for those of others. An insertion before the first site stands beside it; others stand behind the site before."""
    def cell(size: Column, i: Column) -> Column:
        own = F.when(size > 0, F.coalesce(F.get(ins, i), F.lit(""))).otherwise("")
        gap = F.repeat(F.lit("-"), size - F.length(own))
        return F.concat(F.when(i == 0, F.concat(gap, own)).otherwise(F.concat(own, gap)), F.substring(letters, i + 1, F.lit(1)))

    return F.array_join(F.transform(room, cell), "")


def star_alignment(pairs: DataFrame, truncate: bool = True) -> DataFrame:
    """Multiple alignment around each query: ``aligned`` of every record and ``query_seq`` with the gaps that records' insertions make. All rows of a query are of one length, and without gaps they are what they were, up to what is cut beyond the query's ends. pairs: query, query_seq, seq."""
    parts = cut(insertions(pairs))
    both = parts.join(gap_profile(parts, truncate), "query")
    none = F.array().cast("array<string>")
    return both.withColumn("aligned", spliced(F.col("letters"), F.col("ins"), F.col("room"))).withColumn("query_seq", spliced(F.col("query_seq"), none, F.col("room"))).drop("letters", "ins", "room")


def map_to_aligned(pairs: DataFrame) -> DataFrame:
    """The query put into an alignment of its records: it is aligned to the best of them (least ``place``), the gaps that this makes are spliced into all, and what lies beyond the query is cut. pairs: query, query_seq, seq (aligned with each other), place."""
    best = pairs.groupBy("query").agg(F.min_by("query_seq", "place").alias("q"), F.min_by("seq", "place").alias("b"))
    kind = "struct<row:string,room:array<int>>"

    def one(q: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows, rooms = [], []
        for a, s in zip(q, b, strict=True):
            x, y, _ = align_pair(a, s.replace("-", ""))
            row, room, at, new = [], [], 0, 0
            for c, d in zip(x, y, strict=True):
                if d == "-":  # a gap that the query brings
                    row.append(c)
                    new += 1
                    continue
                while s[at] == "-":
                    row.append("-")
                    room.append(new)
                    at, new = at + 1, 0
                row.append(c)
                room.append(new)
                at, new = at + 1, 0
            for _ in s[at:]:
                row.append("-")
                room.append(new)
                new = 0
            rows.append("".join(row))
            rooms.append([*room, new])
        return pd.DataFrame({"row": rows, "room": rooms})

    made = spread(best, "query").select("query", F.pandas_udf(one, kind)("q", "b").alias("m")).select("query", "m.*")
    none = F.array().cast("array<string>")
    whole = pairs.join(made, "query").withColumn("aligned", spliced(F.col("seq"), none, F.col("room")))
    return whole.withColumn("aligned", S.cut_to(F.col("aligned"), F.col("row"))).withColumn("query_seq", S.cut_to(F.col("row"), F.col("row"))).drop("row", "room")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are few and small but take long each, over all that can work on them; Spark would put them together by their bytes."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def distances(aligned: DataFrame) -> DataFrame:
    """query, i, j, d: Kimura distances of the pairs i < j of one query's alignment, which holds at most a few dozen sequences."""
    a = aligned.select("query", F.col("name").alias("i"), F.col("aligned").alias("_a"))
    b = aligned.select("query", F.col("name").alias("j"), F.col("aligned").alias("_b"))
    x = a.join(b, "query").filter("i < j").withColumn("s", S.substitutions(F.col("_a"), F.col("_b")))
    return x.select("query", "i", "j", S.k2p(F.col("s.aligned"), F.col("s.transitions"), F.col("s.transversions")).alias("d"))


def mean_difference_with_self(counts: DataFrame, by: list[str]) -> DataFrame:
    """Like ``mean_difference_within``, with each member paired with itself as well, which adds pairs and no difference."""
    differing = F.sum(F.col("ones") * (F.col("n") - F.col("ones")))
    pairs = F.sum((F.col("n") * (F.col("n") + 1) / 2).cast("long"))
    return counts.groupBy(*by).agg((differing.cast("double") / pairs).alias("difference"), F.max((F.col("n") * (F.col("n") + 1) / 2).cast("long")).alias("pairs"))


#: Members whose states at a site make one row of bits, and places of a group that are compared at once.
RUN = 4096


def _runs(vectors: DataFrame, group: str, member: str) -> DataFrame:
    """group, site, part, run, n and bits: for each run of members, in order, those that have the site, as a bit each for true and for false."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, owner = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            x = pa.concat_arrays(held)
            size = x.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            state = np.full((int(size.max(initial=0)), len(size)), 3, np.uint8)  # 0, 1, 2 for null, 3 where there is no such site
            state[column, row] = pc.fill_null(x.flatten().cast(pa.uint8()), 2).to_numpy()
            rows = [(site, own.size, np.packbits(own == 1).tobytes() + np.packbits(own == 0).tobytes()) for site, own in enumerate(r[r < 3] for r in state)]
            site, n, bits = zip(*rows, strict=True) if rows else ((), (), ())
            same = lambda v, t: pa.array([v] * len(rows), t)
            return pa.RecordBatch.from_arrays([same(owner, kind), pa.array(site, pa.int32()), same(part, pa.int32()), same(number, pa.int32()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], [group, "site", "part", "run", "n", "bits"])

        for batch in batches:
            kind, groups, at = batch.schema.field(0).type, batch.column(0).to_pylist(), 0
            while at < len(groups):
                if held and (groups[at] != owner or sum(map(len, held)) == RUN):
                    yield flush()
                    held, number = [], number + 1
                owner, end = groups[at], bisect_right(groups, groups[at], at, min(len(groups), at + RUN - sum(map(len, held))))
                held.append(batch.column(1).slice(at, end - at))
                at = end
        if held:
            yield flush()

    dealt = vectors.filter(F.col(group).isNotNull() & F.col("states").isNotNull()).repartitionByRange(parts, group, member).sortWithinPartitions(group, member)
    return dealt.select(group, "states").mapInArrow(task, f"{group} {dict(vectors.dtypes)[group]}, site int, part int, run int, n long, bits binary")


def mean_difference_triangular(vectors: DataFrame, group: str, member: str) -> DataFrame:
    """a, b, difference over the pairs of the i-th member of group a and the j-th of group b that have a site, i <= j, a < b, members in order of ``member``. vectors: group, member, states (array of boolean). A pair with an unknown state counts and does not differ.

    No pair is formed. Members are dealt out by ranges and become rows of bits by
    site; a group's places are cut into blocks. Within a block all groups meet as
    matrices; across blocks a block's counts meet those of all places behind it.
    """
    kind = dict(vectors.dtypes)[group]
    runs = cut(_runs(vectors, group, member))
    start = F.sum("n").over(Window.partitionBy(group, "site").orderBy("part", "run")) - F.col("n")
    placed = runs.filter("n > 0").withColumn("start", start)
    placed = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {RUN}"), F.expr(f"(start + n - 1) div {RUN}"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf[group]))
        at, first = {g: i for i, g in enumerate(names)}, int(pdf["block"].iloc[0]) * RUN
        state, size = np.zeros((2, len(names), RUN)), np.zeros(len(names), np.int64)
        for g, n, bits, begin in zip(pdf[group], pdf["n"], pdf["bits"], pdf["start"], strict=True):
            both = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(2, -1), axis=1, count=n)
            x, y = max(0, first - begin), min(n, first + RUN - begin)
            state[:, at[g], begin + x - first : begin + y - first] = both[:, x:y]
            size[at[g]] += y - x
        behind = np.cumsum(state[:, :, ::-1], axis=2)[:, :, ::-1]
        differing = state[0] @ behind[1].T + state[1] @ behind[0].T
        less = np.minimum(size[:, None], size)
        pairs = less * size - less * (less - 1) // 2  # of i < size a: size b - i, while that is not below 0
        own = pd.DataFrame({"a": names, "b": None, "differing": state[0].sum(axis=1), "n": size, "zeros": state[1].sum(axis=1)})
        i, j = np.triu_indices(len(names), 1)
        met = pd.DataFrame({"a": [names[k] for k in i], "b": [names[k] for k in j], "differing": differing[i, j], "n": pairs[i, j], "zeros": 0})
        out = pd.concat([own.astype({"b": object}), met.astype({"b": object})], ignore_index=True)
        return out.astype({"differing": np.int64, "zeros": np.int64}).assign(site=pdf["site"].iloc[0], block=pdf["block"].iloc[0])

    # A row without b holds a block's own counts: ones, zeros and members.
    met = cut(placed.groupBy("site", "block").applyInPandas(compare, f"a {kind}, b {kind}, differing long, n long, zeros long, site int, block long"))
    later = Window.partitionBy("site", "a").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = met.filter("b is null").drop("b").withColumnRenamed("differing", "ones")
    behind = own.select("site", "block", F.col("a").alias("b"), *(F.sum(c).over(later).alias(f"{c}_behind") for c in ("ones", "zeros", "n"))).filter("n_behind > 0")
    across = own.join(behind, ["site", "block"]).filter("a < b").select("a", "b", F.expr("ones * zeros_behind + zeros * ones_behind").alias("differing"), F.expr("n * n_behind").alias("n"))
    every = met.filter("b is not null").select("a", "b", "differing", "n").unionByName(across)
    return every.groupBy("a", "b").agg((F.sum("differing").cast("double") / F.sum("n")).alias("difference"))


def allele_counts(states: DataFrame, by: list[str]) -> DataFrame:
    """by, site, ones, n: how many of a group have a site's state. states: by, site, state (boolean)."""
    return states.groupBy(*by, "site").agg(F.count_if("state").alias("ones"), F.count(F.lit(1)).alias("n"))


def mean_difference_within(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean share of sites that differ over all pairs of a group's members, from counts by site: no pair is formed. Sums are of whole numbers."""
    differing = F.sum(F.col("ones") * (F.col("n") - F.col("ones")))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return counts.groupBy(*by).agg(F.try_divide(differing.cast("double"), pairs).alias("difference"), (F.max("n") * (F.max("n") - 1) / 2).cast("long").alias("pairs"))


def mean_difference_between(counts: DataFrame, group: str) -> DataFrame:
    """a, b, difference over all pairs of one member of each of two groups, a < b, from counts by site."""
    a, b = (counts.select("site", F.col(group).alias(s), F.col("ones").alias(f"ones_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    x = a.join(b, "site").filter("a < b")
    differing = F.sum(F.col("ones_a") * (F.col("n_b") - F.col("ones_b")) + F.col("ones_b") * (F.col("n_a") - F.col("ones_a")))
    return x.groupBy("a", "b").agg((differing.cast("double") / F.sum(F.col("n_a") * F.col("n_b"))).alias("difference"))


#: Rows of one range for which a further one is made, up to the session's number of shuffle partitions.
PER_RANGE = 1024


def neighbours_in_order(df: DataFrame, by: list[str], ident: str, seq: str) -> DataFrame:
    """Each row with the sequence that follows it in its group, in order of a unique id, nulls last; rows that no sequence follows go.

    Where ranges of a group begin comes from these columns alone, one id a range,
    and is broadcast. Each row goes to its range, and the first of a range to the
    one before as well, so windows of single ranges see all neighbours: sequences
    are made once and shuffled once.
    """
    ids = df.select(*by, ident).filter(F.col(ident).isNotNull())
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + ids.count() // PER_RANGE)
    firsts = ids.repartitionByRange(parts, *by, ident).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*by, ident)).alias("_k")).select("_k.*")
    begins = firsts.groupBy(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by))).agg(F.collect_list(ident).alias("_begins"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    own = F.when(F.col(ident).isNull(), F.size("_begins")).otherwise(F.size(F.filter("_begins", lambda b: b <= F.col(ident))))
    both = F.array_contains("_begins", F.col(ident))
    dealt = df.join(F.broadcast(begins), same, "left").withColumn("_own", F.when(F.col("_begins").isNull(), 0).otherwise(own))
    dealt = dealt.select(*df.columns, "_own", F.explode(F.when(both, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))).alias("_range"))
    after = F.lead(seq).over(Window.partitionBy(*by, "_range").orderBy(F.col(ident).asc_nulls_last()))
    return dealt.withColumn(f"next_{seq}", after).filter((F.col("_range") == F.col("_own")) & F.col(f"next_{seq}").isNotNull()).drop("_own", "_range")
