"""Near-duplicate documents by MinHash, banding, verification and components.

1. Each text becomes its set of word-shingle hashes (64 bits). Sets that are
   equal form a class; one member stands for it from here on.
2. ``bands * rows`` universal hashes give minima. Each band of minima is a
   bucket key. With 32 bands of 5 rows two sets with a similarity of 0.8 miss
   every bucket with a probability of (1 - 0.8**5)**32, about 3 in a million.
3. Classes are compared on one byte of each minimum: pairs whose estimate is
   far below the threshold go, what stays joins classes into groups. First
   every class of a bucket is compared with the bucket's least class. Then, in
   buckets whose classes are not in one group yet, those that are not joined to
   the least are compared with every class of the bucket that is not in their
   own group. Only spanning links leave a task.
4. In each group links are confirmed on the full sets, exactly, in blocks of at
   most ``block`` classes: first within each block and with the group's least
   class, which stands in every block. Classes that are not linked to the
   largest part of their group by then meet all others, block by block. A group
   that hangs together costs as much as it has classes, not the square of it.
   Within a task a search from class to class compares only with what has not
   been reached yet, and yields a spanning forest, not all links.
5. Components of the confirmed links, by large-star and small-star.

Defined results: a null or empty text, or one without words, has no shingles
and stays alone; with fewer words than a shingle the whole sequence is one
shingle; rows of one id, whatever their texts, are one document for linking and
each keep a row; rows without id are not linked, have no component and are
kept; an empty table gives no rows. Columns of other names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import forget_tokenizers, slices
from .components import _parts, components_counted
from .scratch import Scratch
from .wordhash import mix, shingles, word_hashes

#: Estimates may be as far below the threshold as this; with 160 minima that is over 9 standard deviations.
SLACK = 0.35
SIGNED = "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>"


def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of n multiply-add-shift hashes."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minima(items: np.ndarray, factors: np.ndarray, addends: np.ndarray, step: int = 1024) -> np.ndarray:
    """The least of each hash over a set, 32 bits each."""
    out = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for i in range(0, len(items), step):
        h = np.multiply.outer(factors, items[i : i + step])
        h += addends[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _set_id(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    for _, group in word_hashes(texts):
        for words in group:
            yield shingles(words, k)


def sign_documents(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_id, signature (a byte a minimum) and band keys of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        factors, addends = universal(bands * rows)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in slices(batches):
            n, ids, signs, keys, seen = [], [], [], [], {}
            for s in _sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                if not len(s):
                    ids.append(None)
                    signs.append(None)
                    keys.append(None)
                    continue
                ids.append(set_id := _set_id(s))
                if set_id not in seen:
                    m = minima(s, factors, addends)
                    h = salt.copy()
                    for part in m.reshape(bands, rows).T:
                        h = mix(h ^ part)
                    seen[set_id] = (m.astype(np.uint8).tobytes(), h.view(np.int64))
                signs.append(seen[set_id][0])
                keys.append(seen[set_id][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "signature", "bands"])

    return docs.mapInArrow(task, SIGNED)


def _agreement(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Estimated similarity by rows of signature bytes, less the chance of equal bytes."""
    return ((p == q).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _near(a: str, b: str, at_least: float) -> F.Column:
    """Whether two signatures agree on enough bytes. Runs in Python on Arrow batches."""

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        q = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        return pd.Series(_agreement(p, q) >= at_least)

    return F.pandas_udf(agree, "boolean")(F.col(a), F.col(b))


def near_forest(signs: np.ndarray, known: np.ndarray, at_least: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that agree and, with rows of equal ``known`` taken as joined, span the components of all such pairs.

    side: with two blocks, 0 or 1 for each row; only pairs between the blocks count then.
    """
    links = []
    _, known = np.unique(known, return_inverse=True)
    by_known = np.split(np.argsort(known, kind="stable"), np.cumsum(np.bincount(known))[:-1])
    open_ = np.ones(len(known), bool)
    for first in by_known:
        if not open_[first[0]]:
            continue
        open_[first] = False
        queue = first.tolist()
        while queue:
            at = queue.pop()
            left = np.flatnonzero(open_ if side is None else open_ & (side != side[at]))
            if not len(left):
                continue
            for j in left[_agreement(signs[left], signs[at]) >= at_least].tolist():
                if open_[j]:
                    links.append((at, j))
                    own = by_known[known[j]]
                    open_[own] = False
                    queue.extend(own.tolist())
    return links


def dealt(rows: DataFrame, by: str, block: int, scratch: Scratch) -> DataFrame:
    """rows (by, node, open and others) for tasks (by, i, j), with side 0 or 1: every row stands in a block i of its group, every open one in a block j of the open ones as well, and each i meets each j.

    rows must be a written table.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_if("open").alias("_m"))
    # Written, so that the join reads both sides from shuffles of their own and Spark may split a large group's rows.
    blocks = scratch.save(sizes.select(by, F.ceil(F.col("_n") / block).cast("int").alias("_n"), F.ceil(F.col("_m") / block).cast("int").alias("_m")))
    x = rows.hint("merge").join(blocks, by).withColumn("_h", F.xxhash64("node"))
    place, every = lambda n: F.pmod(F.col("_h"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    zero = x.withColumn("i", place("_n")).withColumn("j", every("_m")).withColumn("side", F.lit(0))
    one = x.filter("open").withColumn("j", place("_m")).withColumn("i", every("_n")).withColumn("side", F.lit(1))
    return zero.unionByName(one.select(zero.columns)).drop("_n", "_m", "_h", "open")


def bucket_links(shared: DataFrame, sign: DataFrame, joined: DataFrame, at_least: float, block: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) that span what all pairs of each bucket's classes would join; None if there is nothing left to compare. shared: band, node, least; sign: node, signature; joined: node, component of what has been joined before."""
    known = joined.select("node", F.col("component").alias("_c"))
    rows = shared.hint("merge").join(known.hint("merge"), "node", "left").select("band", "node", "least", F.coalesce("_c", "node").alias("known"))
    rows = rows.hint("merge").join(known.withColumnRenamed("node", "least").withColumnRenamed("_c", "_l").hint("merge"), "least", "left")
    rows = scratch.save(rows.select("band", "node", "known", (F.col("known") != F.coalesce("_l", "least")).alias("open")))
    # Two classes have been compared already, as one of them is the least.
    apart = scratch.save(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("some")).filter("n > 2 and some").select("band"))
    if apart.isEmpty():
        return None
    rows = scratch.save(rows.hint("merge").join(apart, "band", "left_semi"))
    pairs = dealt(rows, "band", block, scratch).hint("merge").join(sign, "node")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
        nodes = pdf["node"].to_numpy()
        found = near_forest(signs, pdf["known"].to_numpy(), at_least, pdf["side"].to_numpy())
        return pd.DataFrame([(int(nodes[a]), int(nodes[b])) for a, b in found], columns=["a", "b"], dtype="int64")

    return pairs.groupBy("band", "i", "j").applyInPandas(link, "a long, b long")


def forest(items: list[np.ndarray], nodes: np.ndarray, percent: int, known: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that, with rows of equal ``known`` taken as joined, span the components of the sets under ``100 * both >= percent * either``.

    side: with two blocks, 0 or 1 for each set; only links between the blocks count then.
    """
    n, links = len(items), []
    sizes = np.array([len(x) for x in items], np.int64)
    every = np.concatenate(items) if n else np.zeros(0, np.uint64)
    start = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(n), sizes)
    words, every_id = np.unique(every, return_inverse=True)
    _, known = np.unique(np.arange(n) if known is None else known, return_inverse=True)
    together = np.split(np.argsort(known, kind="stable"), np.cumsum(np.bincount(known))[:-1]) if n else []
    open_ = np.ones(n, bool)
    live, live_owner, gone = every_id, owner, 0
    mark = np.zeros(len(words), bool)
    for first in np.argsort(sizes, kind="stable"):
        if not open_[first]:
            continue
        queue = together[known[first]].tolist()
        open_[queue] = False
        gone += len(queue)
        while queue:
            at = queue.pop()
            if 4 * gone > n:  # what has been reached need not be looked at again
                stay = open_[live_owner]
                live, live_owner, gone = live[stay], live_owner[stay], 0
            if not len(live):
                break
            mine = every_id[start[at] : start[at + 1]]
            mark[mine] = True
            both = np.bincount(live_owner[mark[live]], minlength=n)
            mark[mine] = False
            hit = open_ & (100 * both >= percent * (sizes + sizes[at] - both))
            if side is not None:
                hit &= side != side[at]
            for j in np.flatnonzero(hit):
                if open_[j]:
                    links.append((int(nodes[at]), int(nodes[j])))
                    own = together[known[j]]
                    open_[own] = False
                    queue.extend(own.tolist())
                    gone += len(own)
    return links


def full_sets(docs: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """node, grp, items of every class of groups. groups: node, least (a document id of the class), set_id, grp."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for start, group in word_hashes(batch.column("text").to_pylist()):
                made = [shingles(w, k) for w in group]
                part = batch.slice(start, len(made))
                same = [i for i, (s, want) in enumerate(zip(made, part.column("set_id").to_pylist(), strict=True)) if len(s) and _set_id(s) == want]
                part = part.take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("grp"), pa.array([made[i].tobytes() for i in same], pa.binary())], ["node", "grp", "items"])

    # Both sides grow with the input, so neither is ever broadcast.
    texts = docs.hint("merge").join(groups.select("node", "least", "set_id", "grp"), docs["doc_id"] == groups["least"]).select("node", "set_id", "grp", "text")
    return texts.mapInArrow(sets, "node long, grp long, items binary")


def _stars(nodes: np.ndarray, links: list[tuple[int, int]], centre: int) -> list[tuple[int, int]]:
    """The components of links as stars (label, node): around the centre where it belongs to one, else around its least node."""
    root = {int(x): int(x) for x in nodes}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)), key=lambda x: (x != centre, x))
        root[q] = p
    return [(find(x), x) for x in root if find(x) != x]


def confirmed_links(sets: DataFrame, percent: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Stars (a, b) around the least node of each component within a block, and links (a, b) between such components; None where these are the true components already. sets: node, grp, items, a written table; an equal row may stand twice."""

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        nodes = pdf["node"].to_numpy()
        links = forest([np.frombuffer(x, np.uint64) for x in pdf["items"]], nodes, percent)
        return pd.DataFrame(_stars(nodes, links, int(pdf["least"].iloc[0])), columns=["a", "b"], dtype="int64")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "side"]).drop_duplicates(["node", "side"])
        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        return pd.DataFrame(forest(items, pdf["node"].to_numpy(), percent, pdf["known"].to_numpy(), pdf["side"].to_numpy()), columns=["a", "b"], dtype="int64")

    sizes = scratch.save(sets.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("node").alias("least")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    place = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    blocks = sets.hint("merge").join(sizes, "grp").select("grp", "least", F.explode(place).alias("i"), "node", "items")
    # Dealt out anew: by the join's key alone all blocks of a group would be in one task.
    links = scratch.save(blocks.repartition("grp", "i").groupBy("grp", "i").applyInPandas(in_block, "a long, b long"))

    # Groups of one block are done. Blocks share no other class than the least, so stars of blocks are components.
    large = scratch.save(sets.hint("merge").join(sizes.filter("blocks > 1").select("grp"), "grp", "left_semi").select("grp", "node").distinct())
    if large.isEmpty():
        return links, None
    parts = large.hint("merge").join(links.select(F.col("b").alias("node"), "a").hint("merge"), "node", "left").select("grp", "node", F.coalesce("a", "node").alias("known"))
    parts = scratch.save(parts)
    most = parts.groupBy("grp", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count(F.lit(1)).alias("parts"))
    most = scratch.save(most.filter("parts > 1").select("grp", "main"))
    if most.isEmpty():
        return links, None
    rows = scratch.save(parts.join(most, "grp").select("grp", "node", "known", (F.col("known") != F.col("main")).alias("open")))
    again = dealt(rows, "grp", block, scratch).hint("merge").join(sets.select("node", "items"), "node")
    return links, again.groupBy("grp", "i", "j").applyInPandas(between, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(sign_documents(docs, k, bands, rows))
    classes = signed.filter("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    # A number of its own, fixed as it is written: one id may stand for several classes.
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))

    rows_ = classes.select("node", F.explode("bands").alias("band"))
    buckets = scratch.save(rows_.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "least"))
    shared = scratch.save(rows_.hint("merge").join(buckets, "band"))
    pairs = scratch.save(shared.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    sign = classes.select("node", "signature")
    at_least = percent / 100 - SLACK
    near = (
        pairs.hint("merge").join(sign.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        .hint("merge").join(sign.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        .filter(_near("sa", "sb", at_least))
        .select("a", "b")
    )
    joined, most = components_counted(near, scratch)
    few = lambda df, rows: scratch.save(df.coalesce(_parts(scratch, rows)))  # noqa: E731  tables of so many rows at most
    joined = few(joined, most)
    more = bucket_links(shared, sign, joined, at_least, block, scratch)
    more = None if more is None else scratch.save(more)
    if more is None or more.isEmpty():
        grouped = joined
    else:
        grouped, most = components_counted(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), scratch)
        grouped = few(grouped, most)
    groups = few(grouped.select("node", F.col("component").alias("grp")).join(classes.select("node", "least", "set_id"), "node"), most)
    sets = scratch.save(full_sets(docs, groups, k))
    stars, between = confirmed_links(sets, percent, block, scratch)

    # Rows of one id are one document: the classes of its rows are linked. Few ids have more than one row.
    repeated = scratch.save(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    texts = None
    if not repeated.isEmpty():
        texts = scratch.save(signed.select("doc_id", "set_id").join(repeated, "doc_id").distinct())
        ones = texts.groupBy("doc_id").agg(F.min("set_id").alias("one"))
        number = lambda c: classes.select(F.col("set_id").alias(c), F.col("node").alias(f"{c}_node"))
        same = texts.join(ones, "doc_id").filter("set_id <> one").join(number("one"), "one").join(number("set_id"), "set_id").select(F.col("one_node").alias("a"), F.col("set_id_node").alias("b"))
        between = same if between is None else between.unionByName(same)
    if between is not None:
        found, most = components_counted(stars.unionByName(between), scratch)
        found = few(found, most)
    else:  # stars of different groups share no class
        found = stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    scratch.drop(sets)

    ids = found.hint("merge").join(classes.select("node", "least"), "node")
    lowest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = few(found.hint("merge").join(lowest.hint("merge"), "component").select("node", "component_id"), most)
    label = classes.select("node", "set_id", "least").hint("merge").join(named.hint("merge"), "node", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    label = scratch.save(label)
    out = signed.select("doc_id", "n_shingles", "set_id").hint("merge").join(label.hint("merge"), "set_id", "left")
    if texts is None:
        out = out.withColumn("_of_id", F.lit(None).cast("long"))
    else:  # a row without words goes with the other rows of its id
        bare = scratch.save(texts.join(label, "set_id").groupBy("doc_id").agg(F.min("component_id").alias("_of_id")))
        out = out.join(bare, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "_of_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that are not kept, and with one row for each id that is: of several the one whose columns hash least, so reruns agree. Rows without id stay."""
    scratch = Scratch(docs.sparkSession, "dedup")
    gone = scratch.save(near_duplicates(docs, id_col, text_col, **options).filter("not kept").select(F.col("doc_id").alias("id")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    kept = rows.join(gone, "id", "left_anti")
    several = scratch.save(docs.select(F.col(id_col).alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    if not several.isEmpty():  # only these rows are dealt out by id and sorted
        order = Window.partitionBy("id").orderBy(F.xxhash64("row"))
        one = kept.join(several, "id", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        kept = kept.join(several, "id", "left_anti").unionByName(one)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:least(i + 3, len(words))], ' ') AS s FROM x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
