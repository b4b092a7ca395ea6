"""Choosing comparable records for each query: joins, quotas, caps and the sequential scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators.lineage_cut import cut


def with_status(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Left join; status ``(l)`` where a record was found, else ``(l!?)``."""
    return ids.join(records.withColumn("_hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_hit"), "(l)").otherwise("(l!?)")).drop("_hit")


def without_taxa(records: DataFrame, lineages: DataFrame, taxa: DataFrame, key: str) -> DataFrame:
    """Records none of whose names, at any level, is excluded. lineages: key, name."""
    return records.join(lineages.join(taxa, "name", "left_semi").select(key), key, "left_anti")


def top(hits: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def running_best(hits: DataFrame, by: list[str], order: list[Column], score: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("best", F.max(score).over(w))


def round_robin(hits: DataFrame, query: str, group: str, order: list[Column], limit: int) -> DataFrame:
    """Takes one more of each group in every round until the limit; groups in the order of their best hit."""
    turn = Window.partitionBy(query, group).orderBy(*order)
    ranked = hits.withColumn("round", F.row_number().over(turn))
    place = Window.partitionBy(query).orderBy("round", *order)
    return ranked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)


def _held(rows: DataFrame, others: DataFrame, by: list[str], k: int, apart: bool) -> DataFrame:
    """by, id, s of rows whose s is part of some other's; of another id, if ``apart``. Both: by, id, s.

    A row of k letters or more looks up the one of its words that fewest others
    of its group have, and only these are compared letter by letter; a row with
    a word that none has is in none. Shorter rows are compared with their group.
    """
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    if apart:
        same = [*same, ~F.col("id").eqNullSafe(F.col("_id"))]
    words = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k))))
    long, short = rows.filter(F.length("s") >= k), rows.filter(F.length("s") < k)
    own = [F.col(c).alias(f"_{c}") for c in (*by, "id", "s")]
    held = cut(others.filter(F.length("s") >= k).select(*own, F.explode(words(F.col("s"))).alias("_w")))
    often = held.groupBy(*(f"_{c}" for c in by), "_w").agg(F.count(F.lit(1)).alias("_n"))
    asked = long.select(*by, "id", "s", F.explode(words(F.col("s"))).alias("w"))
    rare = asked.join(often, [F.col("w") == F.col("_w"), *same[: len(by)]], "left").groupBy(*by, "id", "s").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "w")).alias("r")).filter("r.n > 0")
    found = rare.select(*by, "id", "s", F.col("r.w").alias("w")).join(held, [F.col("w") == F.col("_w"), *same, F.contains(F.col("_s"), F.col("s"))], "left_semi").select(*by, "id", "s")
    few = short.join(others.select(*own), [*same, F.contains(F.col("_s"), F.col("s"))], "left_semi").select(*by, "id", "s")
    return found.unionByName(few)


def contained(candidates: DataFrame, accepted: DataFrame, by: list[str], seq: str = "seq", k: int = 12) -> DataFrame:
    """Candidates whose sequence is part of an accepted one of the same group; case does not count."""
    shape = lambda x: x.select(*by, F.lit(0).alias("id"), F.upper(seq).alias("s")).distinct()
    found = _held(shape(candidates), shape(accepted), by, k, False).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("s").alias("_s"))
    return candidates.join(found, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.upper(seq) == F.col("_s")], "left_semi")


def include_minus_exclude(included: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the excluded ones."""
    return included.join(excluded.select(key).distinct(), key, "left_anti")


def failed(queries: DataFrame, assigned: DataFrame, aside: DataFrame | None, key: str) -> DataFrame:
    """Queries that no later stage knows and that are not set aside, as duplicates are."""
    known = assigned.select(key) if aside is None else assigned.select(key).union(aside.select(key))
    return include_minus_exclude(queries, known, key)


def not_contained(rows: DataFrame, others: DataFrame, by: list[str], ident: str = "id", seq: str = "seq", k: int = 12) -> DataFrame:
    """Rows whose sequence is not part of another one's (by id) in the same group; case does not count."""
    shape = lambda x: x.select(*by, F.col(ident).alias("id"), F.upper(seq).alias("s")).distinct()
    found = _held(shape(rows), shape(others), by, k, True).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("id").alias("_id"), F.col("s").alias("_s"))
    return rows.join(found, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col(ident).eqNullSafe(F.col("_id")), F.upper(seq) == F.col("_s")], "left_anti")


def diversity(hits: DataFrame, by: str, *names: str) -> DataFrame:
    """by, hits, and for each column of names how many different ones."""
    return hits.groupBy(by).agg(*(F.count_distinct(n).alias(n) for n in names), F.count(F.lit(1)).alias("hits"))


def set_status(hits: DataFrame, by: str, significant: Column, least: int, name: str, names: int) -> DataFrame:
    """by, significant, status: whether a finished set has hits enough that are significant, and names enough."""
    x = hits.groupBy(by).agg(F.count_if(significant).alias("significant"), F.count_distinct(name).alias("_d"))
    return x.select(by, "significant", F.when(F.col("significant") < least, "too few").when(F.col("_d") < names, "too alike").otherwise("ok").alias("status"))


def capped(hits: DataFrame, query: str, group: str, order: list[Column], soft: int, hard: int) -> DataFrame:
    """The first ``hard`` hits in order; beyond ``soft`` only the first of each group. Adds place and turn, the place in its group."""
    x = hits.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).withColumn("turn", F.row_number().over(Window.partitionBy(query, group).orderBy(*order)))
    return x.filter((F.col("place") <= hard) & ((F.col("place") <= soft) | (F.col("turn") == 1)))


def until_low(hits: DataFrame, query: str, order: list[Column], score: str, share: float, least: int) -> DataFrame:
    """In order, up to and with the first hit behind the first ``least`` whose score is under this share of the best so far."""
    w = Window.partitionBy(query).orderBy(*order)
    x = running_best(hits, [query], order, score).withColumn("_i", F.row_number().over(w))
    low = (F.col(score) < F.col("best") * share) & (F.col("_i") > least)
    before = F.coalesce(F.sum(low.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_b", before).filter("_b = 0").drop("_b", "_i", "best")


def novel(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Adds ``novel``: whether a row is the first of its name in its group. A null name always is."""
    i = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return df.withColumn("novel", F.col(name).isNull() | (i == 1))


def exhaustion(known: DataFrame, seen: DataFrame, ident: str, by: str) -> DataFrame:
    """by, known, seen, not_reached: how many of a group's known ids have been seen, and whether some have not."""
    x = known.join(seen.select(ident).distinct().withColumn("_seen", F.lit(1)), ident, "left")
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("known"), F.count("_seen").alias("seen")).withColumn("not_reached", F.col("seen") < F.col("known"))


def display_order(homologues: DataFrame) -> DataFrame:
    """Adds ``place``: a query's homologues by identity, then by sequence, both from the highest."""
    w = Window.partitionBy("query").orderBy(F.col("identity").desc(), F.col("seq").desc(), "id")
    return homologues.withColumn("place", F.row_number().over(w))


@dataclass(frozen=True)
class Quotas:
    """Limits of the sequential scan, with the usual values. fill_in: 'balanced', 'all' or 'none'. harddiversity: whether a query that misses a rank's quota is set aside."""

    significance: float = 0.1
    nrsignificant: int = 5
    relbitscore: float = 0.5
    besthits: int = 30
    alignmentlimit: int = 50
    individuals: int = 1
    phyla: int = 2
    classes: int = 3
    orders: int = 5
    families: int = 6
    genera: int = 10
    minidentity: float = 0.0
    fill_in: str = "balanced"
    harddiversity: bool = False


RANKS = (("genus", "genera"), ("family", "families"), ("order", "orders"), ("class", "classes"), ("phylum", "phyla"))
NAMED = ("species", *(rank for rank, _ in RANKS))
HIT = "struct<id:string,ord:int,round:int,significance:double,seq:string,species:string,genus:string,family:string,`order`:string,class:string,phylum:string>"
STATE = f"query string, taken array<{HIT}>, spare array<{HIT}>, best double, names array<string>, reason string"
SELECTED = "query string, ord int, id string, place int, round int, status string, reason string, seq string"
#: Hits of one query that a task holds while it goes through them again and again; queries that need more go round by round.
HELD = 100_000
_FIELDS = ("id", "ord", "round", "significance", "seq", "species", "genus", "family", "order", "class", "phylum")


def _inside(hit: dict, taken: list[dict]) -> bool:
    """Whether a hit's sequence is part of one of its species that has been taken."""
    return any(t["species"] == hit["species"] and hit["seq"].upper() in t["seq"].upper() for t in taken)


def _next_names(taken: list[dict], seen: dict[str, set], q: Quotas) -> list[str]:
    """What the next search leaves out: the species so far while there are too few hits, then the names of the lowest rank with too few, at last the phyla."""
    species = {h["species"] for h in taken} - {None}
    if species and len(taken) < q.besthits:
        return sorted(species)
    for rank, quota in RANKS:
        if 0 < len(seen[rank]) < getattr(q, quota):
            return sorted(seen[rank])
    return sorted(seen["phylum"])


def scan_round(state: dict, hits: list[dict], q: Quotas) -> dict:
    """One search's hits, in order, on top of what a query has. Each depends on what was accepted before, so this is a scan."""
    taken, spare, best = list(state["taken"]), list(state["spare"]), state["best"]
    have = {h["id"] for h in taken}
    seen = {rank: {h[rank] for h in taken} - {None} for rank, _ in RANKS}
    count = Counter(h["species"] for h in taken)
    significant = sum(h["significance"] <= q.significance for h in taken)
    reason, last_one = "" if hits else "no more hits", False
    for h in hits:
        tag = h["species"]
        if h["id"] in have or h["id"] == state["query"]:
            continue
        best = max(best, h["score"])
        last_one = last_one or (h["score"] < best * q.relbitscore and len(taken) >= max(3, q.nrsignificant))
        if len(taken) >= q.alignmentlimit:
            reason = "limit"
            break
        if not taken and h.get("identity") is not None and h["identity"] < q.minidentity:
            reason = "identity"
            break
        if tag is not None and count[tag] >= q.individuals:
            own = [i for i, x in enumerate(spare) if x["species"] == tag]
            # With several individuals the worst match of a species stays the last one.
            spare.insert(own[-1] if own and count[tag] > 1 else len(spare), h)
            continue
        if len(taken) >= q.besthits and all(h[rank] in seen[rank] for rank, _ in RANKS):
            continue
        if _inside(h, taken):
            continue
        taken.append(h)
        have.add(h["id"])
        count[tag] += 1
        for rank, _ in RANKS:
            seen[rank] |= {h[rank]} - {None}
        if h["significance"] <= q.significance:
            significant += 1
        elif significant < q.nrsignificant:
            reason = "not significant"
            break
        if last_one:
            break
    names = _next_names(taken, seen, q)
    if not reason:
        reason = "exhausted" if last_one else "no news" if not names or names == list(state["names"]) else ""
    return {"query": state["query"], "taken": taken, "spare": spare, "best": best, "names": names, "reason": reason}


def finish(state: dict, forced: list[dict], q: Quotas) -> list[tuple]:
    """Forced ones replace those of their species that are part of them; then spare ones fill in, one more of each species a round."""
    taken, spare = list(state["taken"]), list(state["spare"])
    for f in forced:
        if f["id"] not in {t["id"] for t in taken} and not _inside(f, taken):
            taken = [t for t in taken if not _inside(t, [f])] + [f]
    if state["reason"] != "limit" and q.fill_in != "none":
        while spare:
            add = []
            for tag in dict.fromkeys(h["species"] for h in spare):
                while tag is not None and (own := next((h for h in spare if h["species"] == tag), None)):
                    spare.remove(own)
                    if own["id"] not in {t["id"] for t in taken} and not _inside(own, taken):
                        add.append(own)
                        break
            every = len({t["species"] for t in taken} - {None})
            if not add or len(taken) + len(add) >= q.alignmentlimit or (q.fill_in == "balanced" and len(add) != every):
                break
            taken += add
    enough = sum(t["significance"] <= q.significance for t in taken) >= q.nrsignificant and len(taken) >= 3
    alike = q.harddiversity and any(len({t[rank] for t in taken} - {None}) < getattr(q, quota) for rank, quota in RANKS)
    status = "identity" if state["reason"] == "identity" else "too few" if not enough else "too alike" if alike else "ok"
    return [(state["query"], t["ord"], t["id"], i, t["round"], status, state["reason"], t["seq"]) for i, t in enumerate(taken, 1)]


def all_rounds(query: str, feed: Iterator[dict], q: Quotas, most_hits: int, held: int) -> dict | None:
    """Every search of one query over its hits, which come in order and are read only as far as they are asked for; None if more than ``held`` are."""
    seen: list[dict] = []
    state = {"query": query, "taken": [], "spare": [], "best": 0.0, "names": [], "reason": ""}
    number = 0
    while not state["reason"]:
        out, found, at = set(state["names"]), [], 0
        while len(found) < most_hits:
            if at == len(seen):
                more = next(feed, None)
                if more is None:
                    break
                seen.append(more)
                if len(seen) > held:
                    return None
            h = seen[at]
            at += 1
            if not out or out.isdisjoint(h[rank] for rank in NAMED):
                found.append(h)
        state = scan_round(state, [h | {"round": number} for h in found], q)
        number += 1
    return state


def _plain(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).to_dict("records")


def _hits_in(rows) -> list[dict]:
    return [{k: x[k] for k in _FIELDS} for x in rows] if rows is not None else []


def select_homologues(hits: DataFrame | Callable[[DataFrame | None], DataFrame], quotas: Quotas = Quotas(), most_hits: int = 200, *, forced: DataFrame | None = None, excluded: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """Accepted hits of every query: query, ord, id, place, round, status, reason, seq.

    hits: query, ord, id, score, significance, seq, species and the five ranks,
    and identity where ``minidentity`` is to be asked for. Either a table of all
    hits, or a search: a function that gives the first ``most_hits`` hits of all
    queries, or, for a table of query and names, of these queries without
    records that bear one of the names. forced: the same for what is forced in.
    excluded: ids never taken. Each round is a search without the names that a
    query has enough of.

    A table is dealt out by query and sorted once; a task goes through a query's
    hits as a stream, all of its rounds over what it has read so far, and stops
    reading when the quotas are met. Queries that need more than ``held`` hits,
    and searches, go round by round, with a query's state as one row of bounded
    size.
    """
    without_excluded = lambda x: x if excluded is None else include_minus_exclude(x, excluded, "id")
    if callable(hits):
        return _by_rounds(lambda going: cut(without_excluded(hits(going))), quotas, most_hits, forced)
    kept = without_excluded(hits)
    columns = ["query", "ord", "id", "score", "significance", "seq", *NAMED, "identity"]
    shape = lambda x, first: x.select(*(F.col(c) if c in x.columns else F.lit(None).cast("double").alias(c) for c in columns), F.lit(first).alias("first"))
    rows = shape(kept, 1) if forced is None else shape(kept, 1).unionByName(shape(forced, 0))
    typed = {"query": "string", "ord": "int", "id": "string", "score": "double", "significance": "double", "identity": "double"}
    rows = rows.select(*(F.col(c).cast(typed.get(c, "string")).alias(c) for c in columns), "first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    yield from batch.slice(start, 512).to_pylist()

        out = []
        for name, own in groupby(each(), key=lambda h: h["query"]):
            more, first = [], None
            for h in own:
                if h["first"]:
                    first = h
                    break
                more.append(h | {"round": -1})
            if first is None:  # forced ones alone are no hits
                continue
            state = all_rounds(name, chain([first], own), quotas, most_hits, held)
            if state is None:
                out.append((name, None, None, None, None, "open", None, None))
            else:
                out += finish(state, more, quotas)
            if len(out) >= 4096:
                yield _selected(out)
                out = []
        yield _selected(out)

    done = cut(rows.repartition("query").sortWithinPartitions("query", "first", "ord", "id").mapInArrow(task, SELECTED))
    open_ = done.filter("status = 'open'").select("query")
    if open_.isEmpty():
        return done
    left = cut(kept.join(open_, "query", "left_semi"))

    def search(going: DataFrame | None) -> DataFrame:
        now = left
        if going is not None:
            now = left.join(going, "query").filter(~F.arrays_overlap(F.array_compact(F.array(*NAMED)), "names")).drop("names")
        return top(now, ["query"], [F.col("ord"), F.col("id")], most_hits)

    more = None if forced is None else forced.join(open_, "query", "left_semi")
    return done.filter("status <> 'open'").unionByName(_by_rounds(search, quotas, most_hits, more))


def _selected(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SELECTED.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in SELECTED.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _by_rounds(search: Callable[[DataFrame | None], DataFrame], quotas: Quotas, most_hits: int, forced: DataFrame | None) -> DataFrame:
    """One search of all open queries after the other."""
    ranks = [rank for rank, _ in RANKS]
    number, first = 0, search(None)
    none = [F.array().cast(f"array<{HIT}>").alias("taken"), F.array().cast(f"array<{HIT}>").alias("spare"), F.lit(0.0).alias("best"), F.array().cast("array<string>").alias("names"), F.lit("").alias("reason")]
    state = first.select("query").distinct().select("query", *none)
    while True:
        going = state.filter("reason = ''")
        if number:
            first = search(going.select("query", "names"))
        at = number

        def step(key: tuple, now: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(now):
                return pd.DataFrame(columns=["query", "taken", "spare", "best", "names", "reason"])
            row = now.iloc[0]
            old = {"query": row["query"], "taken": _hits_in(row["taken"]), "spare": _hits_in(row["spare"]), "best": row["best"], "names": list(row["names"])}
            rows = [h | {"round": at} for h in _plain(found.sort_values(["ord", "id"]))]
            new = scan_round(old, rows, quotas)
            return pd.DataFrame([new | {"taken": _hits_in(new["taken"]), "spare": _hits_in(new["spare"])}], columns=["query", "taken", "spare", "best", "names", "reason"])

        stepped = going.groupBy("query").cogroup(first.groupBy("query")).applyInPandas(step, STATE)
        state = cut(stepped.unionByName(state.filter("reason <> ''")) if number else stepped)
        number += 1
        if state.filter("reason = ''").isEmpty():
            break

    def end(key: tuple, now: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in now.to_dict("records"):
            extra = [{**h, "round": -1} for h in _plain(more.sort_values(["ord", "id"]))]
            out += finish(row | {"taken": _hits_in(row["taken"]), "spare": _hits_in(row["spare"])}, _hits_in(extra), quotas)
        return pd.DataFrame(out, columns=["query", "ord", "id", "place", "round", "status", "reason", "seq"])

    more = first.limit(0) if forced is None else forced
    return state.groupBy("query").cogroup(more.select("query", "ord", "id", "significance", "seq", "species", *ranks).groupBy("query")).applyInPandas(end, SELECTED)


def _kmers(df: DataFrame, k: int, *more: str) -> DataFrame:
    """id, kmers, more: the distinct k-mers of a sequence as hashes, ascending; of a shorter one the whole. Null sequences go."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - k + 1, F.lit(1)))
    words = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("seq"), i, F.lit(k)))))
    return df.filter("seq is not null").select("id", F.sort_array(words).alias("kmers"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in more))


#: Pairs of a query and a record that one task forms.
PAIRS = 1 << 20
#: The first look at a query's rarest k-mers stops before so many times ``most`` records.
FIRST_LOOK = 4


def _sharing(words: DataFrame, held: DataFrame) -> DataFrame:
    """query, id of all pairs that share one of the words, each once. words: query, kmer, n (records that have it); held: id, kmers.

    Pairs are far more than the rows they come from, so the work is dealt out by
    their number: a k-mer of many pairs goes to several tasks.
    """
    load = cut(words.groupBy("kmer").agg((F.count(F.lit(1)) * F.first("n")).alias("pairs")))
    parts = max(1, -(-(load.agg(F.sum("pairs")).first()[0] or 0) // PAIRS))
    deals = load.select("kmer", F.ceil(F.col("pairs") / PAIRS).cast("int").alias("deals"))
    asked = words.join(deals, "kmer").select("query", "kmer", F.pmod(F.xxhash64("query"), F.col("deals")).cast("int").alias("deal"))
    known = held.select("id", F.explode("kmers").alias("kmer")).join(deals, "kmer").select("id", "kmer", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    return asked.repartition(parts, "kmer", "deal").join(known.repartition(parts, "kmer", "deal"), ["kmer", "deal"]).select("query", "id").distinct()


def kmer_search(queries: DataFrame, records: DataFrame, k: int = 8, most: int = 200, *, common: int = 1000, block: int = 4096) -> DataFrame:
    """query, id, score (distinct k-mers in common), ord: the best ``most`` records of each query. Both: id, seq.

    Where queries have ``left_out`` and records have ``names``, both arrays, a
    query does not see records that bear a name that it leaves out.

    Queries of the same k-mers have the same result and are searched once. Of
    records of the same k-mers (and names) only the first ``most`` can be in a
    result; the others are behind them for every query.

    A query's k-mers are looked up from the rarest on. The first look gives a
    score that ``most`` records reach. A record that reaches it too misses few
    of the query's k-mers, so it has one of the rarest that are more than these;
    only they are looked up then. K-mers of more than ``common`` records would
    join nearly everything with everything: a record that shares no rarer one
    with a query scores at most the number of the query's common k-mers, so a
    query whose last place scores more than that is done. The rest meets all
    records in blocks, and only the best of each block leave it.
    """
    bans = "left_out" in queries.columns and "names" in records.columns
    mine, theirs = [c for c in ("left_out",) if bans], [c for c in ("names",) if bans]
    q = cut(_kmers(queries, k, *mine))
    copies = Window.partitionBy("kmers", *theirs).orderBy("id")
    r = cut(_kmers(records, k, *theirs).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= most).drop("copy"))
    sets = cut(q.groupBy("kmers", *mine).agg(F.min("id").alias("query")))
    known = r.select(F.explode("kmers").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("query").orderBy("n", "kmer")
    each = sets.select("query", F.explode("kmers").alias("kmer")).join(known, "kmer")
    each = each.withColumn("at", F.row_number().over(rarest)).withColumn("upto", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
    each = cut(each.withColumn("early", (F.col("n") <= common) & ((F.col("at") == 1) | (F.col("upto") <= FIRST_LOOK * most))))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")

    def scored(words: DataFrame) -> DataFrame:
        whole = _sharing(words.select("query", "kmer", "n"), r).join(sets.withColumnRenamed("kmers", "_q"), "query").join(r.withColumnRenamed("kmers", "_r"), "id")
        if bans:
            whole = whole.filter(~F.coalesce(F.arrays_overlap("names", "left_out"), F.lit(False)))
        return whole.select("query", "id", F.size(F.array_intersect("_q", "_r")).cast("long").alias("score"))

    last = lambda df: df.filter(F.col("ord") == most).select("query", F.col("score").alias("last"))
    found = cut(_ranked(scored(each.filter("early")), w, most))
    # Who has none of the query's m rarest k-mers scores at most its number of k-mers less m.
    upto = each.groupBy("query").agg(F.max("at").alias("size")).join(last(found), "query", "left").select("query", (F.col("size") - F.coalesce("last", F.lit(1)) + 1).alias("upto_at"))
    rest = cut(each.filter((F.col("n") <= common) & ~F.col("early")).join(upto, "query").filter("at <= upto_at").select("query", "kmer", "n"))
    if not rest.isEmpty():
        found = cut(_ranked(found.select("query", "id", "score").unionByName(scored(rest)).distinct(), w, most))
    crowded = each.filter(F.col("n") > common).groupBy("query").agg(F.count(F.lit(1)).alias("bound"))
    open_ = cut(crowded.join(last(found), "query", "left").filter(F.coalesce(F.col("last") <= F.col("bound"), F.lit(True))).select("query"))
    n = open_.count()
    if n:
        left = sets.join(open_, "query", "left_semi").withColumnRenamed("query", "id")
        found = found.join(open_, "query", "left_anti").unionByName(_ranked(_in_blocks(left, r, n, most, block), w, most))
    return found.join(q.join(sets, ["kmers", *mine]).select("query", F.col("id").alias("_member")), "query").select(F.col("_member").alias("query"), "id", "score", "ord")


def _in_blocks(left: DataFrame, r: DataFrame, n: int, most: int, block: int) -> DataFrame:
    """query, id, score: of every block of records the best ``most`` for each of the n queries. left: id, kmers, maybe left_out; r: id, kmers, maybe names."""
    m, bans = r.count(), "left_out" in left.columns
    deal = lambda df, rows, name: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows // block)))).cast("int"))
    over = lambda rows, name: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-rows // block)) - 1))).alias(name)
    a = deal(left, n, "i").select(*left.columns, "i", over(m, "j"))
    b = deal(r, m, "j").select(*r.columns, "j", over(n, "i"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values("id", ignore_index=True)
            known, at = np.unique(np.concatenate(y["kmers"].to_list()), return_inverse=True)
            owner = np.repeat(np.arange(len(y)), y["kmers"].map(len))
            order = np.argsort(at, kind="stable")
            owner, start = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(known)))))
            bearers: dict[str, list[int]] = {}
            for i, names in enumerate(y["names"] if bans else ()):
                for name in names:
                    bearers.setdefault(name, []).append(i)
            for place, (ident, kmers) in enumerate(zip(x["id"], x["kmers"], strict=True)):
                p = np.searchsorted(known, kmers)
                p = p[(p < len(known)) & (known[np.minimum(p, len(known) - 1)] == kmers)]
                score = np.bincount(np.concatenate([owner[start[i] : start[i + 1]] for i in p]), minlength=len(y)) if len(p) else np.zeros(len(y), int)
                for name in x["left_out"].iloc[place] if bans else ():
                    score[bearers.get(name, [])] = 0
                first = np.lexsort((np.arange(len(y)), -score))[:most]
                out += [(ident, y["id"][i], int(score[i])) for i in first if score[i]]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    kind = dict(left.dtypes)["id"], dict(r.dtypes)["id"]
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(best, f"query {kind[0]}, id {kind[1]}, score long")


def _ranked(scored: DataFrame, w, most: int) -> DataFrame:
    out = scored.select("query", "id", F.col("score").cast("long").alias("score")).withColumn("ord", F.row_number().over(w))
    return out.filter(F.col("ord") <= most)
