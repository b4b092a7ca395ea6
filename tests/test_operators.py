"""Operators against plain Python, closed forms and fixed cases."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pandas as pd
import pytest
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
from cladewise.plans import adapters, assignment
from cladewise.plans.registry import PluginNotFoundError, Plugins
from cladewise.sources import database, fasta_source, files, newick, sinks
from cladewise.streaming import ingest


def lineage(**names):
    return [(L.LEVELS.index(k) + 1, k, v) for k, v in names.items()]


def test_levels():
    assert len(L.LEVELS) == 34 and L.LEVELS.index("species") + 1 == 31


def test_lineage_functions(spark):
    df = spark.createDataFrame([("genus: A, species: A b",), ("species: A b, phylum: P",), ("bad",), ("nolevel: x",), (None,)], "t string")
    got = [r.p for r in df.select(L.path(L.parse(F.col("t"))).alias("p")).collect()]
    assert got == ["genus:A/species:A b", "phylum:P/species:A b", None, None, None]


def brute_similarity(a, b):
    bound = lambda s: (len(s) - len(s.lstrip("-")), len(s.rstrip("-")))
    lo, hi = max(bound(a)[0], bound(b)[0]), min(bound(a)[1], bound(b)[1])
    w = list(zip(a[lo:hi], b[lo:hi])) if hi > lo else []
    some = sum((x, y) != ("-", "-") for x, y in w)
    return (sum(x == y != "-" for x, y in w) / some if some else None), (sum(x == y for x, y in w) / len(w) if w else None)


def test_similarity(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choices("ACGT--", k=30)), "".join(rng.choices("ACGT--", k=30))) for _ in range(60)] + [("-" * 30, "A" * 30), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("s"), S.identity(F.col("a"), F.col("b")).alias("i"))
    for r in df.collect():
        assert (r.s, r.i) == brute_similarity(r.a, r.b)


def test_k2p(spark):
    a, b = "A" * 20 + "C" * 20, "A" * 18 + "GT" + "C" * 19 + "T"
    df = spark.createDataFrame([(a, b), ("A" * 30, "T" * 30), ("ACGT", "ACGT"), ("A" * 25 + "N", "A" * 25 + "A")], "a string, b string")
    got = [r.d for r in df.select(S.substitutions(F.col("a"), F.col("b")).alias("s")).select(S.k2p(F.col("s.aligned"), F.col("s.transitions"), F.col("s.transversions")).alias("d")).collect()]
    p, q = 2 / 40, 1 / 40
    assert got[0] == pytest.approx(-0.5 * log(1 - 2 * p - q) - 0.25 * log(1 - 2 * q)) and got[1:] == [S.SATURATED, None, 0.0]
    code = lambda s: [("ACGT".find(c) + 1) for c in s]
    assert N.k2p_matrix(N.indicators(np.array([code(a), code(b)], np.uint8)), np.ones(40, int))[0, 1] == pytest.approx(got[0])
    rng = np.random.default_rng(3)
    rows = np.where(rng.random((6, 90)) < 0.2, rng.integers(0, 5, (6, 90)), rng.integers(1, 5, 90)).astype(np.uint8)
    times = np.bincount(rng.integers(90, size=90), minlength=90)
    letters = ["".join("NACGT"[c] for c in np.repeat(r, times)) for r in rows]
    df = spark.createDataFrame([(i, j, letters[i], letters[j]) for i in range(6) for j in range(6) if i != j], "i int, j int, a string, b string")
    want = {(r.i, r.j): r.d for r in df.select("i", "j", S.substitutions(F.col("a"), F.col("b")).alias("s")).select("i", "j", S.k2p(F.col("s.aligned"), F.col("s.transitions"), F.col("s.transversions")).alias("d")).collect()}
    d = N.k2p_matrix(N.indicators(rows), times)
    assert all(d[x] == pytest.approx(want[x]) for x in want) and not d.diagonal().any()
    assert N.k2p_matrix(N.indicators(rows[:, :10]), np.ones(10, int)) is None


def brute_align(a, b):
    """Score of the best global alignment with affine gaps."""
    low, n, m = -1e18, len(a), len(b)
    M, X_, Y = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    M[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                X_[i][j] = max(max(M[i - 1][j], Y[i - 1][j]) - 10, X_[i - 1][j] - 0.5)
            if j:
                Y[i][j] = max(max(M[i][j - 1], X_[i][j - 1]) - 10, Y[i][j - 1] - 0.5)
            if i and j:
                M[i][j] = max(M[i - 1][j - 1], X_[i - 1][j - 1], Y[i - 1][j - 1]) + (a[i - 1] == b[j - 1])
    return max(M[n][m], X_[n][m], Y[n][m])


def score_of(x, y):
    s, gap = 0.0, None
    for c, d in zip(x, y):
        kind = "a" if d == "-" else "b" if c == "-" else None
        s += (c == d) if kind is None else (-0.5 if kind == gap else -10.0)
        gap = kind
    return s


def test_align_pair():
    rng = random.Random(1)
    for _ in range(80):
        a, b = ("".join(rng.choices("ACGT", k=rng.randrange(1, 40))) for _ in range(2))
        x, y, s = A.align_pair(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        assert s == pytest.approx(brute_align(a, b)) and score_of(x, y) == pytest.approx(s)


def test_align_pair_of_alike_sequences():
    """Without gaps where fewer than 20 sites differ: what the whole matrix gives."""
    rng = random.Random(6)
    for n in (0, 1, 60):
        a = "".join(rng.choices("ACGT", k=n))
        for share in (0.0, 0.1, 0.3):
            b = "".join(rng.choice("ACGT") if rng.random() < share else c for c in a)
            assert A.align_pair(a, b)[2] == pytest.approx(brute_align(a, b)) and A.align_pair(a, b) == A.align_pair(a, b, straight=False)


def test_star_alignment(spark):
    """Rows of one length that are what they were without their gaps; letters that align to a site of the query stand under it."""
    rng = random.Random(17)
    change = lambda s: "".join(rng.choice(["", "A", c + "G", c + "TTTTTTTTTTTTTTT"]) if rng.random() < 0.04 else c for c in s)
    rows = []
    for q in range(3):
        base = "".join(rng.choices("ACGT", k=90))
        rows += [(f"q{q}", base, f"r{i}", i, change(base) if i else "GATTACA" * 3 + base + "CCAT") for i in range(6)]
    rows.append(("alone", "ACGTAC", "same", 0, "ACGTAC"))
    df = spark.createDataFrame(rows, "query string, query_seq string, id string, place int, seq string")
    for truncate in (False, True):
        got = {(r.query, r.id): r for r in A.star_alignment(df, truncate).collect()}
        assert len(got) == len(rows)
        for q, base, i, _, seq in rows:
            r = got[q, i]
            assert len(r.aligned) == len(r.query_seq) == len(got[q, [x[2] for x in rows if x[0] == q][0]].aligned)
            assert r.query_seq.replace("-", "") == base and (truncate or r.aligned.replace("-", "") == seq) and r.aligned.replace("-", "") in seq
            x, y, _ = A.align_pair(base, seq)
            assert "".join(d for c, d in zip(x, y) if c != "-") == "".join(d for c, d in zip(r.query_seq, r.aligned) if c != "-")
            assert got[q, i].query_seq == next(v.query_seq for k, v in got.items() if k[0] == q)


def test_map_to_aligned(spark):
    """The query beside its best record in an alignment that stands: others get the same gaps and are cut alike."""
    base = "ACGTTGCAAC" * 4
    stored = ["TT--" + base[:20] + "--" + base[20:] + "GG", "TTAA" + base[:20] + "CC" + base[20:] + "GG", "----" + base[:18] + "----" + base[20:] + "--"]
    query_ = base[:30] + "TTTTTTTTTTTTTTTTTTTTTTTTTTTT" + base[30:]
    df = spark.createDataFrame([("q", query_, f"r{i}", i, x) for i, x in enumerate(stored)], "query string, query_seq string, id string, place int, seq string")
    got = {r.id: r for r in A.map_to_aligned(df).collect()}
    q = got["r0"].query_seq
    assert {len(r.aligned) for r in got.values()} == {len(q)} and q.replace("-", "") == query_ and q[0] != "-" != q[-1]
    # Gaps apart, rows are parts of what they were, and columns stand together as before.
    old = [i for i in range(len(q)) if any(r.aligned[i] != "-" for r in got.values())]
    assert len(q) - len(old) >= 20
    for i, r in got.items():
        kept = "".join(r.aligned[k] for k in old)
        assert kept in stored[int(i[1])] or kept.replace("-", "") in stored[int(i[1])].replace("-", "")
    assert "AACCCACG" in got["r1"].aligned and sum(a == b != "-" for a, b in zip(q, got["r0"].aligned)) >= 32


def additive():
    """Distances of the tree ((a,b),(c,(d,e)))."""
    d = np.array([[0, 3, 7, 8, 9], [3, 0, 8, 9, 10], [7, 8, 0, 7, 8], [8, 9, 7, 0, 5], [9, 10, 8, 5, 0]], float)
    return d, list("abcde")


def test_neighbour_joining():
    d, names = additive()
    assert N.four_points(d)
    clades = N.neighbour_joining(d, names, [], np.random.default_rng(0))
    full = frozenset(names)
    splits = {frozenset([c, full - c]) for c in clades}
    assert splits == {frozenset([frozenset("ab"), frozenset("cde")]), frozenset([frozenset("de"), frozenset("abc")])}
    forced = N.neighbour_joining(d, names, [frozenset("ac"), frozenset("bde")], np.random.default_rng(0))
    assert any(c in (frozenset("ac"), frozenset("bde")) for c in forced)


def plain_joining(d, names, groups):
    """Neighbour joining by sets of names; a pair may join if no group is broken, leaves in no group aside."""
    nodes, dist, clades = [frozenset([x]) for x in names], {(i, j): d[i][j] for i in range(len(d)) for j in range(len(d))}, []
    free, live = set(names) - set().union(*groups), list(range(len(d)))
    while len(live) > 3:
        r = {i: sum(dist[i, j] for j in live) for i in live}
        ok = []
        for i in live:
            for j in live:
                u = (nodes[i] | nodes[j]) - free
                if i < j and all(not u & c or u <= c or c <= u for c in groups):
                    ok.append(((len(live) - 2) * dist[i, j] - r[i] - r[j], i, j))
        if not ok:
            break
        _, i, j = min(ok)
        k = len(nodes)
        live = [x for x in live if x not in (i, j)]
        for x in live:
            dist[k, x] = dist[x, k] = (dist[i, x] + dist[j, x] - dist[i, j]) / 2
        dist[k, k] = 0.0
        nodes.append(nodes[i] | nodes[j])
        clades.append(nodes[k])
        live.append(k)
    return clades


def test_joining_under_constraints():
    """Against a plain run; groups that are nested hold in every tree, the leaf in no group stands anywhere."""
    rng = np.random.default_rng(4)
    names = [f"n{i:02}" for i in range(14)]
    splits = lambda clades: {frozenset([c, frozenset(names) - c]) for c in clades}  # noqa: E731  of the last four nodes either two may be joined
    groups = [frozenset(names[1:5]), frozenset(names[1:3]), frozenset(names[5:13]), frozenset(names[9:13]), frozenset(names[1:14])]
    for _ in range(20):
        x = rng.normal(size=(14, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        got = N.neighbour_joining(d, names, groups, np.random.default_rng(0))
        assert splits(got) == splits(plain_joining(d.tolist(), names, groups))
        own = [c - {names[0]} for c in got]
        assert all(not c & g or c <= g or g <= c for c in own for g in groups)
        assert splits(N.neighbour_joining(d, names, [], np.random.default_rng(0))) == splits(plain_joining(d.tolist(), names, []))


def test_joining_under_splits():
    """Splits of some leaves from some others hold in a tree without root; leaves in neither stand anywhere."""
    rng = np.random.default_rng(5)
    names = [f"n{i:02}" for i in range(12)]
    left, right = set(names[:4]), set(names[4:9])
    sets = [{"members": sorted(left), "others": sorted(right)}, {"members": names[9:11], "others": names[0:2]}]
    fixed = N._constraints(names, sets)
    assert N._constraints(names, None) is None and N._constraints(names, [{"members": ["n00"], "others": None}]) is None
    for k in range(20):
        x = rng.normal(size=(12, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        found = N.joined_trees(np.stack([d, d.T]), fixed, [np.random.default_rng(k)] * 2)
        for rows in found:
            clades = [{names[i] for i in np.flatnonzero(r)} for r in rows]
            assert len(clades) == 9
            for a, b in ((left, right), (set(names[9:11]), set(names[:2]))):
                for c in clades:
                    parts = (c & a, a - c, c & b, b - c)
                    assert not all(parts), (k, c)  # a split of the tree that crosses the asked one


def random_newick(rng, names):
    """A random tree as text, with the clades of its inner nodes."""
    clades = []

    def build(own):
        if len(own) == 1:
            return f"{rng.choice([own[0], repr(own[0])])}:{rng.random():.3f}", set(own)
        parts, own = rng.choice([2, 2, 3]), list(own)
        rng.shuffle(own)
        cuts = sorted(rng.sample(range(1, len(own)), min(parts, len(own)) - 1))
        made = [build(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
        clades.append(frozenset().union(*(m[1] for m in made)))
        return f"({' , '.join(m[0] for m in made)}){rng.choice(['', ':1e-3', '87:0.5', '[x,(y)]'])}", set(own)

    text, _ = build(names)
    return text + ";", set(clades[:-1])


def test_newick():
    rng = random.Random(8)
    for n in (2, 3, 9, 70):
        names = [f"t{i}_X" for i in range(n)]
        for _ in range(10):
            text, want = random_newick(rng, names)
            leaves, clades, lengths, labels, degree = newick.parse(text)
            assert leaves == sorted(names) and len(clades) == len(lengths) == len(labels) and degree in (2, 3)
            assert {frozenset(x for i, x in enumerate(leaves) if c >> i & 1) for c in clades} == want
    assert newick.parse("(1,(2,3)0.9:2);", {"1": "a b", "2": "c"}) == (["3", "a b", "c"], [5], [2.0], ["0.9"], 2)
    assert newick.parse("('it''s',b)")[0] == ["b", "it's"] and newick.parse("a;")[0] == ["a"]
    for bad in ("((a,b);", "(a,b));", "(a,a);", "(a,,b);", "(a:x,b);", "a,b;", "", "(a,b)(c,d);"):
        with pytest.raises(newick.NewickError):
            newick.parse(bad)


def plain_consensus(trees_, names):
    """Majority clades joined by recursion, children in order of their first leaf."""
    n, count = len(trees_), {}
    for t in trees_:
        for c in t:
            count[c] = count.get(c, 0) + 1
    major = {c: k for c, k in count.items() if 2 * k > n}

    def text(own):
        inner = [c for c in major if c < own and not any(c < d < own for d in major)]
        loose = own - frozenset().union(*inner)
        parts = sorted([(min(c), text(c) + str(int(100 * major[c] / n + 1e-9))) for c in inner] + [(x, x) for x in loose])
        return "(" + ",".join(p for _, p in parts) + ")"

    return text(frozenset(names)) + ";"


def test_trees_of_files(spark, tmp_path):
    """Nexus files, some split by Spark, against a plain run: clades, consensus, monophyly, rooting; faults are told."""
    rng = random.Random(9)
    names = [f"id{i}_Org" for i in range(8)]
    base = [random_newick(rng, names) for _ in range(3)]
    want = {}
    for f in range(2):
        picked = [base[0]] * (6 if f else 3) + [base[rng.randrange(3)] for _ in range(5)]
        want[f"f{f}.nex"] = [c for _, c in picked]
        keys = {x: str(i + 1) for i, x in enumerate(names)}
        body = "".join(f"  tree r{i} = [&R] {re.sub('id[0-9]+_Org', lambda m: keys[m[0]], t)}\n" for i, (t, _) in enumerate(picked))
        (tmp_path / f"f{f}.nex").write_text("#NEXUS\n[! a note; with marks]\nBEGIN TREES;\n  TRANSLATE " + ",\n ".join(f"{v} '{k}'" for k, v in keys.items()) + ";\n" + body + "END;\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = newick.nexus_trees(spark, str(tmp_path)).withColumn("query", F.element_at(F.split("query", "/"), -1)).cache()
        assert found.filter("problem is not null").count() == 0 and found.select("rep").distinct().count() == sum(map(len, want.values()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    leaves = M.tree_leaves(found)
    got = {}
    for r in found.withColumn("c", F.transform("clades", lambda c: N.named(c, F.col("leaves")))).collect():
        got.setdefault(r.query, []).append(frozenset(map(frozenset, r.c)))
    assert {q: Counter(x) for q, x in got.items()} == {q: Counter(map(frozenset, x)) for q, x in want.items()}
    assert {r.query: r.newick for r in M.consensus_newick(found, leaves).collect()} == {q: plain_consensus(x, names) for q, x in want.items()}
    groups = [("f0.nex", "g", f"g{i}", x) for i in range(30) for x in rng.sample(names, rng.randrange(1, 8))] + [("f0.nex", "c", f"c{i}", x) for i, c in enumerate(base[0][1]) for x in c] + [("f0.nex", "h", "gone", "zz")]
    members = {}
    for _, lv, g, x in groups:
        members.setdefault((lv, g), set()).add(x)
    df = spark.createDataFrame(groups, "query string, level string, name string, leaf string")
    for rooted in (True, False):
        for r in M.monophyly(found, df, leaves, rooted).collect():
            own = members[r.level, r["name"]]
            good = lambda t: len(own) in (1, 8) or own in t or (not rooted and (set(names) - own in t or len(own) == 7))  # noqa: E731, B023
            assert (r.size, r.n, r.n_trees) == (len(own), sum(map(good, want["f0.nex"])), len(want["f0.nex"]))
    side = min(base[0][1], key=len)
    out = M.rooted_by(found, leaves, spark.createDataFrame([("f1.nex", x) for x in side], "query string, name string"))
    for r in out.join(leaves, "query").withColumn("c", F.transform("clades", lambda c: N.named(c, F.col("names")))).collect():
        t = got["f1.nex"]
        if r.c is not None:
            c = set(map(frozenset, r.c))
            assert frozenset(side) in c and frozenset(names) - side in c and all(x <= side or not x & side for x in c)
            assert any({frozenset([x, frozenset(names) - x]) for x in tree} <= {frozenset([x, frozenset(names) - x]) for x in c} for tree in t)
    up = {(r.query, tuple(r.c)): r.p for r in M.nested(M.majority(found), leaves).join(leaves, "query").select("query", N.named(F.col("clade"), F.col("names")).alias("c"), N.named(F.col("parent"), F.col("names")).alias("p")).collect()}
    for (q, c), p in up.items():
        larger = [set(x) for k, x in up if k == q and set(c) < set(x)]
        assert (set(p or ()) or None) == (min(larger, key=len) if larger else None)
    bad = spark.createDataFrame([("q", 1, "t", "((a,b);", None), ("q", 2, "t", None, None)], "query string, rep long, tree_name string, newick string, names map<string,string>")
    assert {r.rep: r.problem is not None for r in newick.trees(bad).collect()} == {1: True, 2: True}
    ids = spark.createDataFrame([("ab_X y",), ("NC_12_X",), ("zz_X",)], "n string").select(newick.leaf_id(F.col("n"), F.array(F.lit("ab"), F.lit("NC_12"))).alias("i")).collect()
    assert [r.i for r in ids] == ["ab", "NC_12", None]
    with pytest.raises(Exception, match="trees differ in leaves"):
        M.tree_leaves(newick.trees(spark.createDataFrame([("q", 1, "t", "(a,b);", None), ("q", 2, "t", "(a,c);", None)], "query string, rep long, tree_name string, newick string, names map<string,string>"))).collect()


def test_bit_sets(spark):
    """Sets of leaves as words, beyond one word, against sets of names."""
    rng = random.Random(3)
    names = [f"n{i:03}" for i in range(150)]
    sets = [sorted(rng.sample(names, rng.choice([1, 2, 70, 149]))) for _ in range(30)]
    sets += [sets[2][: len(sets[2]) // 2 + 1], sorted(set(names) - set(sets[0])), names]
    df = spark.createDataFrame([(i, j, a, b, names) for i, a in enumerate(sets) for j, b in enumerate(sets)], "i int, j int, a array<string>, b array<string>, names array<string>")
    df = df.withColumn("x", N.bits_of(F.col("a"), F.col("names"))).withColumn("y", N.bits_of(F.col("b"), F.col("names")))
    for r in df.select("*", N.size_of(F.col("x")).alias("n"), N.within(F.col("x"), F.col("y")).alias("w"), N.apart(F.col("x"), F.col("y")).alias("p"), N.compatible(F.col("x"), F.col("y")).alias("c"), N.named(N.minus(F.col("x"), F.col("y")), F.col("names")).alias("m"), N.named(F.col("x"), F.col("names")).alias("back")).collect():
        a, b = set(r.a), set(r.b)
        assert (r.n, r.w, r.p, r.c, set(r.m), r.back) == (len(a), a <= b, not a & b, not a & b or a <= b or b <= a, a - b, r.a)
    member = np.array([[n in s for n in names] for s in sets])
    assert [list(w) for w in N.words_of(member)] == [r.x for r in df.filter("j = 0").orderBy("i").select("x").collect()]

def test_bootstrap_and_sister_groups(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("ACGT", k=400))
    change = lambda s, n: "".join(rng.choice("ACGT") if i in set(rng.sample(range(len(s)), n)) else c for i, c in enumerate(s))
    left, right = change(base, 60), change(base, 60)
    rows = [("q", "q", change(left, 4)), ("q", "l1", change(left, 4)), ("q", "l2", change(left, 12)), ("q", "r1", change(right, 5)), ("q", "r2", change(right, 5))]
    aligned = spark.createDataFrame(rows, "query string, name string, aligned string")
    clades = N.bootstrap_clades(aligned, 20).cache()
    assert sorted(clades.collect()) == sorted(N.bootstrap_clades(aligned.repartition(3), 20).collect())
    support = {r.clade: r.support for r in N.clade_support(clades, 20).collect()}
    assert max(support.get("r1,r2", 0), support.get("l1,l2,q", 0)) > 0.9
    tags = {"l1": lineage(genus="L", species="L a"), "l2": lineage(genus="L", species="L b"), "r1": lineage(genus="R", species="R a"), "r2": lineage(genus="R", species="R b"), "q": []}
    members = spark.createDataFrame([("q", n, tags[n]) for n in tags], f"query string, name string, lineage {L.ENTRY_ARRAY}")
    trees = assignment.tree_lineages(clades, assignment.sister_lineages(clades, members))
    post = R.posteriors(R.summarise(trees), R.tree_counts(trees))
    prob = {r.path: r.prob for r in post.collect()}  # where l1 and l2 join first, both rootings are as good and agree on nothing
    assert prob["genus:L"] > 0.6 and prob["genus:L"] > 5 * prob.get("genus:R", 0)


def test_rollup_demo(spark):
    """Lineages that miss ranks: fillers, pruning, collapse, counts that add up."""
    full = lineage(phylum="P", **{"class": "C"}, order="O")
    rows = [("q", full)] * 3 + [("q", lineage(phylum="P", order="O"))] + [("q", [])]
    trees = spark.createDataFrame(rows, f"query string, lineage {L.ENTRY_ARRAY}")
    levels = ("phylum", "class", "order")
    path = lambda df: sorted((L_, r.cnt) for r in df.collect() for L_ in ["/".join(f"{e.level}:{e.name}" for e in r.lineage)])
    assert path(R.consolidate(trees, levels, 0.5)) == [("", 1), ("phylum:P", 1), ("phylum:P/class:C/order:O", 3)]
    assert path(R.consolidate(trees, levels, 0.0)) == [("", 1), ("phylum:P/order:O", 4)]
    post = {r.path: r.prob for r in R.posteriors(R.summarise(trees), R.tree_counts(trees)).collect()}
    assert post["phylum:P"] == 0.8 and post["phylum:P/class:C"] == 0.6
    short = spark.createDataFrame([("q", "a:A", 1, 1, "a", "A", 2), ("q", "a:A/b:B", 2, 2, "b", "B", 3)], "query string, path string, depth int, rank int, level string, name string, cnt long")
    assert {r.path: r.cnt for r in R.repair(short).collect()} == {"a:A": 3, "a:A/b:B": 3}


def plain_selection(hits, q, most, forced=(), excluded=()):
    """The greedy compilation of one query, as stated: search, scan, search again without what there is enough of."""
    got, kept, best, prev, why = [], {}, 0.0, None, None
    names = lambda rank: {h[rank] for h in got if h[rank] is not None}
    same = lambda h: [g["seq"].upper() for g in got if g["species"] == h["species"]]
    quota = [("genus", q.genera), ("family", q.families), ("order", q.orders), ("class", q.classes), ("phylum", q.phyla)]
    out_of = []
    while why is None:
        ranks = ("species", "genus", "family", "order", "class", "phylum")
        found = [h for h in sorted(hits, key=lambda h: (h["ord"], h["id"])) if h["id"] not in excluded and not {h[r] for r in ranks} & set(out_of)][:most]
        if not found:
            why = "no more hits"
            break
        stop = False
        for h in found:
            if h["id"] in [g["id"] for g in got] or h["id"] == h["query"]:
                continue
            best = max(best, h["score"])
            if h["score"] < best * q.relbitscore and len(got) >= 3 and len(got) >= q.nrsignificant:
                stop = True
            if len(got) >= q.alignmentlimit:
                why = "limit"
                break
            if h["species"] is not None and sum(g["species"] == h["species"] for g in got) >= q.individuals:
                line = kept.setdefault(h["species"], [])
                line.insert(max(0, len(line) - 1) if sum(g["species"] == h["species"] for g in got) > 1 and line else len(line), h)
                continue
            if len(got) >= q.besthits and not any(h[r] is None or h[r] not in names(r) for r, _ in quota):
                continue
            if any(h["seq"].upper() in x for x in same(h)):
                continue
            sig = sum(g["significance"] <= q.significance for g in got)
            got.append(h)
            if h["significance"] > q.significance and sig < q.nrsignificant:
                why = "not significant"
                break
            if stop:
                break
        if why is None and stop:
            why = "exhausted"
        low = [r for r, n in quota if 0 < len(names(r)) < n]
        out_of = sorted(names("species")) if names("species") and len(got) < q.besthits else sorted(names(low[0])) if low else sorted(names("phylum"))
        if why is None and (not out_of or out_of == prev):
            why = "no news"
        prev = out_of
    for f in forced:
        if f["id"] not in [g["id"] for g in got] and not any(f["seq"].upper() in x for x in same(f)):
            got = [g for g in got if not (g["species"] == f["species"] and g["seq"].upper() in f["seq"].upper())] + [f]
    while why != "limit" and q.fill_in != "none" and any(kept.values()):
        add = []
        for line in kept.values():
            while line:
                h = line.pop(0)
                if h["id"] not in [g["id"] for g in got] and not any(h["seq"].upper() in x for x in same(h)):
                    add.append(h)
                    break
        if not add or len(got) + len(add) >= q.alignmentlimit or q.fill_in == "balanced" and len(add) != len(names("species")):
            break
        got += add
    ok = sum(g["significance"] <= q.significance for g in got) >= q.nrsignificant and len(got) >= 3
    return [g["id"] for g in got], "ok" if ok else "too few", why


@pytest.mark.parametrize("quotas", [X.Quotas(), X.Quotas(individuals=3, alignmentlimit=12, besthits=6), X.Quotas(besthits=4, relbitscore=0.0, genera=4, families=3), X.Quotas(significance=0.02, nrsignificant=2, fill_in="all"), X.Quotas(individuals=2, relbitscore=0.0, fill_in="balanced", alignmentlimit=60)])
def test_select_homologues(spark, quotas):
    rng = random.Random(quotas.individuals * 100 + quotas.besthits)
    hits = []
    for i in range(360):
        k = rng.randrange(40)
        species = None if rng.random() < 0.05 else f"s{k}"
        hits.append({"query": f"q{i % 4}", "ord": i // 4, "id": f"h{i // 4}", "score": 100.0 - i / 5, "significance": 0.001 * (i % 50) * (i % 4), "seq": "".join(rng.choices("ACGT", k=rng.choice([2, 4, 8]))), "species": species, "genus": rng.choice([None, f"g{k % 12}"]), "family": f"f{k % 6}", "order": f"o{k % 4}", "class": f"c{k % 3}", "phylum": f"p{k % 2}"})
    hits.append({**hits[0], "id": "q0", "ord": 0})
    forced = [{**h, "id": f"x{i}", "seq": h["seq"] * 2, "significance": 0.0} for i, h in enumerate(hits[:16])]
    df = spark.createDataFrame(pd.DataFrame(hits)).withColumn("ord", F.col("ord").cast("int"))
    ff = spark.createDataFrame(pd.DataFrame(forced)).withColumn("ord", F.col("ord").cast("int"))
    gone = spark.createDataFrame([("h1",), ("h5",)], "id string")
    for most, more, less in ((200, None, None), (9, ff, gone)):
        got = {}
        for r in sorted(X.select_homologues(df, quotas, most, forced=more, excluded=less).collect(), key=lambda r: (r.query, r.place)):
            got.setdefault(r.query, ([], r.status, r.reason))[0].append(r.id)
        for query in ("q0", "q1", "q2", "q3"):
            own = lambda rows: [h for h in rows if h["query"] == query]  # noqa: E731, B023
            want = plain_selection(own(hits), quotas, most, sorted(own(forced) if more is not None else [], key=lambda h: (h["ord"], h["id"])), ("h1", "h5") if less is not None else ())
            assert got[query] == want, (query, most)


def test_identity_stops_a_search(spark):
    base = {"score": 9.0, "significance": 0.0, "species": "s", "genus": "g", "family": "f", "order": "o", "class": "c", "phylum": "p"}
    rows = [{**base, "query": q, "ord": i, "id": f"h{i}", "seq": "ACGT"[i] * 9, "species": f"s{i}", "identity": 0.5 if i == 0 and q == "a" else None} for q in "ab" for i in range(4)]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("ord", F.col("ord").cast("int")).withColumn("identity", F.nanvl("identity", F.lit(None).cast("double")))
    got = X.select_homologues(df, X.Quotas(minidentity=0.9, nrsignificant=1)).collect()
    assert {r.query for r in got} == {"b"} and {r.status for r in got} == {"ok"}


def test_hard_diversity(spark):
    rows = [{"query": q, "ord": i, "id": f"h{i}", "seq": "ACGT"[i] * 9, "species": f"s{i}", "score": 9.0, "significance": 0.0, "genus": f"g{i}", "family": "f", "order": "o", "class": "c", "phylum": f"p{i if q == 'a' else 0}"} for q in "ab" for i in range(4)]
    df = spark.createDataFrame(pd.DataFrame(rows)).withColumn("ord", F.col("ord").cast("int"))
    quotas = X.Quotas(nrsignificant=1, phyla=2, classes=1, orders=1, families=1, genera=3, harddiversity=True)
    assert {(r.query, r.status) for r in X.select_homologues(df, quotas).collect()} == {("a", "ok"), ("b", "too alike")}


def test_subspecies(spark):
    rows = [lineage(genus="Homo", species="Homo sapiens"), lineage(species="A b", subspecies="A b c"), lineage(species="A b"), []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, lineage {L.ENTRY_ARRAY}")
    names = lambda level: {r.i: [e["name"] for e in r.l] for r in df.select("i", L.subspecies_rule(F.col("lineage"), level).alias("l")).collect()}
    assert names(False) == {0: ["Homo", "Homo sapiens"], 1: ["A b"], 2: ["A b"], 3: []}
    assert names(True) == {0: ["Homo", "Homo sapiens", "Homo sapiens sapiens"], 1: ["A b", "A b c"], 2: ["A b"], 3: []}


def test_kmer_search(spark):
    rng = random.Random(12)
    texts = [("COMMONPREFIX" if i % 3 else "") + "".join(rng.choices("ACGT", k=rng.choice([3, 9, 30]))) for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    sets = [{t[j : j + 6] for j in range(max(1, len(t) - 5))} for t in texts]
    scores = {(a, b): len(x & y) for a, x in enumerate(sets) for b, y in enumerate(sets) if x & y}
    for most, common, block in ((7, 10, 40), (7, 1000, 4096), (150, 10, 33), (3, 2, 64)):
        got = {(r.query, r.id): (r.score, r.ord) for r in X.kmer_search(rows, rows, 6, most, common=common, block=block).collect()}
        want = {}
        for a in range(150):
            best = sorted((-n, b) for (x, b), n in scores.items() if x == a)[:most]
            want |= {(a, b): (-n, i) for i, (n, b) in enumerate(best, 1)}
        assert got == want
    banned = rows.select("id", "seq", F.array(F.concat(F.lit("n"), (F.col("id") % 5).cast("string")), F.lit("n1")).alias("left_out"))
    named = rows.select("id", "seq", F.array(F.concat(F.lit("n"), (F.col("id") % 7).cast("string"))).alias("names"))
    for common in (3, 1000):
        got = {(r.query, r.id): (r.score, r.ord) for r in X.kmer_search(banned, named, 6, 4, common=common, block=50).collect()}
        want = {}
        for a in range(150):
            best = sorted((-n, b) for (x, b), n in scores.items() if x == a and b % 7 not in (a % 5, 1))[:4]
            want |= {(a, b): (-n, i) for i, (n, b) in enumerate(best, 1)}
        assert got == want


def test_kmer_search_forms_few_pairs(spark, monkeypatch):
    """Copies are searched once, null sequences meet nothing, and tasks hold a bounded number of pairs."""
    texts = ["ACGTACCA", "ACGTACGG", "TTTTACGTA", None]
    rows = spark.createDataFrame([(i, texts[i % 4]) for i in range(400)], "id long, seq string")
    formed, sharing = [], X._sharing
    monkeypatch.setattr(X, "_sharing", lambda words, held: formed.append(sharing(words, held).count()) or sharing(words, held))
    got = {(r.query, r.id): (r.score, r.ord) for r in X.kmer_search(rows, rows, 4, 3, common=10**6).collect()}
    sets = [{t[j : j + 4] for j in range(len(t) - 3)} for t in texts[:3]]
    want = {}
    for a in (i for i in range(400) if i % 4 < 3):
        best = sorted((-len(sets[a % 4] & sets[b % 4]), b) for b in range(400) if b % 4 < 3)[:3]
        want |= {(a, b): (-n, i) for i, (n, b) in enumerate(best, 1)}
    assert got == want
    assert sum(formed) <= 3 * 9  # of 300 * 300
    monkeypatch.setattr(X, "PAIRS", 500)
    words = spark.createDataFrame([(i, 7, 40) for i in range(100)], "query long, kmer long, n long")
    held = spark.createDataFrame([(i, [7]) for i in range(40)], "id long, kmers array<long>")
    assert sharing(words, held).count() == 4000
    sizes = []
    real = type(words).repartition
    monkeypatch.setattr(type(words), "repartition", lambda df, n, *c: sizes.append(n) or real(df, n, *c))
    sharing(words, held)
    assert sizes == [8, 8]


def planted(rng, leaves_):
    """Sequences evolved on a tree of three levels with their lineages."""
    mutate = lambda seq, n: "".join(rng.choice("ACGT") if rng.random() < n else c for c in seq)
    root, out = "".join(rng.choices("ACGT", k=300)), []
    for o in range(3):
        order = mutate(root, 0.15)
        for f in range(2):
            family = mutate(order, 0.08)
            for g in range(2):
                genus = mutate(family, 0.04)
                for s_ in range(leaves_):
                    out.append((f"r{o}{f}{g}{s_}", mutate(genus, 0.01), f"G{o}{f}{g} s{s_}", lineage(phylum="P/Q", **{"class": "C"}, order=f"O{o}", family=f"F{o}{f}", genus=f"G{o}{f}{g}", species=f"G{o}{f}{g} s{s_}")))
    return out, mutate


def test_assign_on_a_planted_tree(spark):
    """Queries that are new individuals of known genera are placed in these; one far from all is left out; a copy follows its original."""
    rng = random.Random(13)
    records, mutate = planted(rng, 2)
    queries = [(f"q{i}", mutate(records[i][1], 0.01)) for i in (0, 7, 13)]
    queries += [("copy", queries[0][1]), ("far", "".join(rng.choices("ACGT", k=300)))]
    rec = spark.createDataFrame(records, f"id string, seq string, organism string, lineage {L.ENTRY_ARRAY}")
    qs = spark.createDataFrame(queries, "id string, seq string")
    config = assignment.AssignConfig(quotas=X.Quotas(minidentity=0.8, relbitscore=0.0, genera=6, individuals=2), replicates=20, cutoffs=(95, 60, 95), force_include=("r2111", "none"), force_exclude=("r0001",))
    assert config.cutoffs == (60, 95)
    out = assignment.assign(qs, rec, config)
    post = {(r.query, r.level, r["name"]): r.prob for r in out["posterior"].collect()}
    assert {q for q, _, _ in post} <= {"q0", "q7", "q13"} | {"copy"} and ("q0" if ("q0", "order", "O0") in post else "copy", "order", "O0") in post
    first = "copy"  # of equal sequences the least id stands for both
    for query, i in ((first, 0), ("q7", 7), ("q13", 13)):
        genus = records[i][3][4][2]
        assert post[query, "phylum", "P/Q"] == 1.0 and post.get((query, "genus", genus), 0) > 0.6, (query, genus)
    selected = out["selected"].collect()
    assert "r0001" not in {r.id for r in selected} and {r.id for r in out["failed"].collect()} == {"far"}
    n = {r.query: r.n_trees for r in out["posterior"].select("query", "n_trees").distinct().collect()}
    assert set(n.values()) == {20}
    names = spark.createDataFrame([("f.fasta", q, q.upper()) for q, _ in queries], "file string, query string, orig string")
    tables = assignment.reports(out, names, config)
    rows = tables["assignments"].collect()
    assert {(r.query, r.cutoff) for r in rows} >= {(first, 60), ("q7", 60)} and all(r.phylum == "P/Q" and r.nr_signif >= 5 and 0 < r.min_homol <= 1 and 0 < r.min_taxon <= 1 for r in rows)
    probs = {(r.orig, r.level, r["name"]): r.prob for r in tables["taxon_probabilities"].collect()}
    assert probs[first.upper(), "phylum", "P/Q"] == 1.0 and tables["querylist"].count() == len(queries)


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_assign_finds_turned_and_shifted_records(spark):
    """Records that are stored turned, or between other bases, are cut and turned back: the result is that of the plain ones, whatever strand; unrelated records take no part."""
    rng = random.Random(14)
    records, mutate = planted(rng, 2)
    noise = lambda n: "".join(rng.choices("ACGT", k=n))
    odd = [(i, [x, turned(x), noise(70) + x + noise(90), turned(noise(40) + x + noise(130))][k % 4], o, t) for k, (i, x, o, t) in enumerate(records)]
    odd += [(f"z{i}", noise(300), f"Z{i} z", lineage(phylum="Z", **{"class": "Z"}, order="Z", family="Z", genus=f"Z{i}", species=f"Z{i} z")) for i in range(5)]
    queries = [(f"q{i}", mutate(records[i][1], 0.01)) for i in (2, 9, 20)]
    qs = spark.createDataFrame(queries, "id string, seq string")
    config = assignment.AssignConfig(quotas=X.Quotas(minidentity=0.8, relbitscore=0.0, genera=6, individuals=2), replicates=10)
    post = []
    for rows in (records, odd):
        rec = spark.createDataFrame(rows, f"id string, seq string, organism string, lineage {L.ENTRY_ARRAY}")
        out = assignment.assign(qs, rec, config)
        selected = {(r.query, r.id) for r in out["selected"].collect()}
        post.append({(r.query, r.level, r["name"]): r.prob for r in out["posterior"].collect()})
        assert not any(i.startswith("z") for _, i in selected)
    for query, i in (("q2", 2), ("q9", 9), ("q20", 20)):
        for p in post:
            assert p[query, "phylum", "P/Q"] == 1.0 and p.get((query, "genus", records[i][3][4][2]), 0) > 0.5, (query, p)


def plain_segments(q, r, places, k, x=20, gap=40):
    """Islands of one diagonal extended letter by letter. q and r are aligned from their first letters on."""
    score = [1 if a == b and a in "ACGT" else -2 for a, b in zip(q, r)]
    islands = []
    for p in sorted(places):
        if islands and p - islands[-1][1] <= gap:
            islands[-1][1] = p
        else:
            islands.append([p, p])
    out = set()
    for a, b in islands:
        b += k
        best = [0, 0]
        for side, steps in ((1, range(b, len(score))), (0, range(a - 1, -1, -1))):
            run = top = reach = 0
            for n, i in enumerate(steps, 1):
                run += score[i]
                if max(top, 0) - run > x:
                    break
                if run > top:
                    top, reach = run, n
            best[side] = (top, reach)
        out.add((a - best[0][1], b + best[1][1] - a + best[0][1], sum(score[a:b]) + best[0][0] + best[1][0]))
    return out


def test_seed_search(spark):
    """Every segment, E-value and hit against a plain search; turned, shifted, masked and insignificant records."""
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choices("ACGT", k=n))
    base = noise(200)
    change = lambda s, n: "".join(rng.choice("ACGT") if rng.random() < n else c for c in s)
    records = [("same", base), ("turned", turned(base)), ("far", noise(50) + change(base, 0.05) + noise(60)), ("half", base[:90]), ("two", base[:80] + noise(120) + base[110:]), ("none", noise(400)), ("short", base[100:112]), ("low", "AC" * 60), ("n", base[:60] + "N" * 30 + base[90:]), ("", ""), ("tiny", "ACG")]
    records += [(f"x{i}", noise(300)) for i in range(20)]
    queries = [("q", base), ("r", turned(change(base, 0.03))), ("low", "AC" * 60), ("e", ""), ("lower", base.lower())]
    rec, qs = (spark.createDataFrame(x, "id string, seq string") for x in (records, queries))
    index = H.build_index(rec, k=11, stride=3)
    assert index.bases == sum(len(x) for _, x in records) and H.word_size(1 << 20) == 12 and H.word_size(10) == 11 and H.word_size(1 << 62) == 31
    simple = lambda w: any(w[p:] == w[:-p] for p in (1, 2, 3))
    want = {}
    for name, q0 in queries:
        for strand in (1, -1):
            q = q0.upper() if strand == 1 else turned(q0.upper())
            for ident, r in records:
                diagonals = {}
                for j in range(0, len(r) - 10, 3):
                    w = r[j : j + 11]
                    if not set(w) - set("ACGT") and not simple(w):
                        for i in range(len(q) - 10):
                            if q[i : i + 11] == w:
                                diagonals.setdefault(j - i, []).append(i)
                for d, places in diagonals.items():
                    off = max(0, -d)
                    for start, length, raw in plain_segments(q[off:], r[max(0, d) :], [p - off for p in places], 11):
                        want.setdefault((name, ident), []).append((-raw, -strand, (start + off) if strand == 1 else len(q) - start - off - length, start + off + d, length))
    e = lambda m, raw: 0.620991 * m * index.bases * np.exp(-1.33271 * raw)
    size = {n: len(s) for n, s in queries}
    got = {}
    for r in H.search(qs, index).collect():
        got[r.query, r.id] = (-r.raw, -r.s_strand, r.q_start, r.s_start, r.q_len, r.segments)
        assert r.significance == pytest.approx(e(size[r.query], r.raw)) and r.score == pytest.approx((1.33271 * r.raw - np.log(0.620991)) / np.log(2)) and r.s_len == r.q_len
    good = {k: [x for x in v if e(size[k[0]], -x[0]) <= 10] for k, v in want.items()}
    assert got == {k: (*min(v), len(v)) for k, v in good.items() if v}
    assert got["q", "same"][:5] == (-200, -1, 0, 0, 200) and got["q", "turned"][1] == 1 and ("r", "same") in got and ("low", "low") not in got
    orders = {}
    for r in H.search(qs, index).collect():
        orders.setdefault(r.query, []).append((r.ord, -r.raw, r.id))
    assert all(sorted(x) == [(i, *y) for i, y in enumerate(sorted(z[1:] for z in x), 1)] for x in orders.values())
    # Windows: the part beside the query, turned to its strand.
    hits = H.search(qs.filter("id = 'q'"), index).join(rec, "id").withColumn("m", F.lit(200))
    cut_ = {r.id: r.seq for r in H.windowed(hits).collect()}
    assert cut_["same"] == base and cut_["turned"] == base and len(cut_["far"]) <= 310
    assert H.search(qs.filter("id = 'e'"), index).count() == 0
    banned = qs.withColumn("left_out", F.array(F.lit("N1")))
    named = H.build_index(rec.withColumn("names", F.when(F.col("id") == "same", F.array(F.lit("N1"))).otherwise(F.array(F.lit("N2")))), k=11, stride=3)
    assert {(r.query, r.id) for r in H.search(banned, named).collect()} == {k for k in got if k[1] != "same"}


def test_selection_over_many_rounds(spark):
    """The registered query's rounds, spares, containment and stops against the plain compilation, and what does not fit into a task's memory the slow way."""
    d = "/root/testdata/sf0.001"
    from cladewise.plans import selection_queries as Q

    hits = [r.asDict() for r in Q._event_hits(spark, d).collect()]
    by = {}
    for h in hits:
        by.setdefault(h["query"], []).append({**h, "identity": None})
    got = {}
    rows = Q.greedy_rounds(spark, d).collect()
    for r in sorted(rows, key=lambda r: (r.query, r.place)):
        got.setdefault(r.query, ([], r.status, r.reason))[0].append(r.id)
    for name, own in by.items():
        want = plain_selection(own, Q.MANY_ROUNDS, Q.FEW_HITS)
        assert got.get(name, ([], want[1], want[2])) == want, name
    assert max(r.round for r in rows) >= 2 and len(rows) < len(hits)
    few = X.select_homologues(Q._event_hits(spark, d), Q.MANY_ROUNDS, Q.FEW_HITS, held=10).drop("seq")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, rows))


def test_tables(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert T.has_row(a, {"k": " x", "v": "1"}) and not T.has_row(a, {"k": "x", "v": 2}) and not T.has_row(a, {"z": 1})
    assert T.append_row(a, {"w": 5}).filter("w = '5' and k = 'NULL'").count() == 1
    with pytest.raises(Exception, match="differ in length"):
        T.zip_join(a, a.limit(1).select(F.col("v").alias("o")), [F.col("k")], [F.col("o")]).collect()
    names = spark.createDataFrame([("f", "Ab", 1), ("f", "aB", 2), ("f", "c", 3)], "file string, name string, ord int")
    assert [r.unique_name for r in T.unique_names(names, ["file"], "name", ["ord"]).orderBy("ord").collect()] == ["Ab", "aB_1", "c"]
    many = ["a", "a", "a_1", "A_2", "a", "a_1", "a_x", "a_01", "a"]
    made = [r.unique_name for r in T.unique_names(spark.createDataFrame([("f", x, i) for i, x in enumerate(many)], "file string, name string, ord int"), ["file"], "name", ["ord"]).orderBy("ord").collect()]
    assert made == ["a", "a_3", "a_1", "A_2", "a_4", "a_1_1", "a_x", "a_01", "a_5"] and len({x.lower() for x in made}) == len(made)
    rng = random.Random(1)
    rows = [(rng.choice("xy") if i % 3 else None, i) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, i int")
    assert {(r.i, r.n) for r in T.numbered(df, [F.col("i")], "n").collect()} == {(i, n) for n, i in enumerate(sorted(i for _, i in rows), 1)}
    assert {(r.i, r.chunk) for r in T.chunks(df, 7, [F.col("i")]).collect()} == {(i, n // 7) for n, i in enumerate(sorted(i for _, i in rows))}
    want = set()
    for g in ("x", "y", None):
        own = sorted(i for h, i in rows if h == g)
        want |= set(zip(own, [None, *own], [*own[1:], None], strict=False))
    assert {(r.i, r.previous_i, r.next_i) for r in T.neighbours(df, ["g"], ["i"], "i").collect()} == want
    assert {(r.k, r.found) for r in T.with_membership(a, a.filter("v = 1"), {"k": "k"}).collect()} == {("x", True), ("y", False)}


def test_neighbours_in_order(spark, tmp_path, monkeypatch):
    """Neighbours meet across ranges and not across groups, and sequences are read and shuffled once."""
    monkeypatch.setattr(A, "PER_RANGE", 20)
    rng = random.Random(3)
    rows = [(rng.choice("xyz") if i % 3 else None, i, None if i % 29 == 5 else f"s{i}") for i in rng.sample(range(2000), 400)] + [("one", 5000, "a"), ("x", None, "last")]
    spark.createDataFrame(rows, "g string, i long, s string").repartition(5).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    found = A.neighbours_in_order(df, ["g"], "i", "s")
    want = set()
    for g in ("x", "y", "z", "one", None):
        own = sorted(((i, s) for h, i, s in rows if h == g), key=lambda r: (r[0] is None, r[0]))
        want |= {(g, *a, b[1]) for a, b in zip(own, own[1:], strict=False) if b[1] is not None}
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["g", "i", "s", "next_s"] and len(got) == len(want) and set(got) == want
    plan = A.neighbours_in_order(df, ["g"], "i", "s")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^]]*\bs#", plan)) == 1 and not re.search("SortMergeJoin|ShuffledHashJoin", plan), plan
    assert A.neighbours_in_order(df.limit(0), ["g"], "i", "s").count() == 0


def test_next_documents_read_texts_once(spark):
    """Every query on a document and the next one reads and maps the texts once."""
    from cladewise.plans import catalog

    for name in ("k2p_stats", "k2p_distance", "mark_matches", "similarity_pairs", "force_identity", "truncate_to_query"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet \[[^]]*\btext#", plan)) == 1 and not re.search("SortMergeJoin|ShuffledHashJoin", plan), name


def test_index_by_id(spark, tmp_path):
    """A lookup is pushed to the files of its buckets, a join leaves the index where it is, in a session that did not write it as well; repeated ids are told."""
    path = f"file://{tmp_path}/index"
    rec = spark.createDataFrame([(f"r{i}", "ACGT" * (i % 5), f"o{i}") for i in range(500)], "id string, seq string, organism string")
    database.write_index(rec, path, 8)
    found = database.lookup(spark, path, ["r7", "r499", "none"])
    assert {r.id for r in found.collect()} == {"r7", "r499"}
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id" in plan
    assert len(list((tmp_path / "index" / "rows").glob("*.parquet"))) == 8
    spark.sql(f"DROP TABLE {database._table(path)}")  # as in another session
    other = spark.range(1000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"))
    joined = other.repartition(8, "id").join(database.open_index(spark, path).hint("merge"), "id")
    assert joined.count() == 500
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in text and "Exchange" not in text.split("+- Sort")[-1] and "Bucketed: true" in text, text
    with pytest.raises(database.RepeatedIdError, match="r7"):
        database.write_index(rec.union(rec.filter("id = 'r7'")), path, 8)


def test_compiled_database(spark, tmp_path):
    """Batches merge by id, the last wins, the same again changes nothing; a version that was not finished is not seen."""
    path = f"file://{tmp_path}/db"
    five = lineage(phylum="P", **{"class": "C"}, order="O", family="F", genus="G")
    taxonomy = spark.createDataFrame([("1", five), ("2", five[:3]), ("3", lineage(phylum="a;b", **{"class": "C"}, order="O", family="F", genus="G"))], f"taxid string, lineage {L.ENTRY_ARRAY}")
    taxids = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", "9"), ("g", "1"), ("", "1")], "id string, taxid string")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, organism string, sequence string")
    with pytest.raises(FileNotFoundError):
        database.records(spark, path)
    one = batch(("a", "x", "AC"), ("b", "x", "GG"), ("c", "x", "A"), ("d", "x", "A"), ("e", "x", "A"), ("f", "x", "A"), ("g", "x", " "), (None, "x", "A"), ("", "y", "A"), ("a", "z", "TT"))
    for _ in range(2):
        database.merge_batch(path, "one", one, taxids, taxonomy)
        got = {r.id: (r.batch, r.taxid) for r in database.records(spark, path).collect()}
        assert got == {"a": ("one", "1"), "b": ("one", "1")}
        assert Counter(r.reason for r in database.ledger(spark, path).collect()) == {"no id": 2, "no sequence": 1, "no taxid": 1, "no lineage": 1, "mark in a name": 1, "too few levels": 1, "id stands twice": 1}
    database.merge_batch(path, "two", batch(("b", "new", "CCC"), ("a", "x", "")), taxids, taxonomy)
    assert {r.id: (r.batch, r.sequence) for r in database.records(spark, path).select("id", "batch", "sequence").collect()}["b"] == ("two", "CCC")
    assert database.records(spark, path).count() == 2 and database.versions(spark, path) == [1, 2, 3]
    (tmp_path / "db" / "records" / "v=4").mkdir()
    assert database.versions(spark, path) == [1, 2, 3]


def test_assignment_goes_on(spark, tmp_path):
    """A second run with new queries runs only these; options or records that change run all again; a run that died is not known."""
    from cladewise.plans import resume

    rng = random.Random(31)
    records, mutate = planted(rng, 2)
    rec = spark.createDataFrame(records, f"id string, seq string, organism string, lineage {L.ENTRY_ARRAY}")
    asked = [(f"q{i}", mutate(records[i][1], 0.01)) for i in (1, 8, 15, 22)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, seq string")
    config = assignment.AssignConfig(quotas=X.Quotas(minidentity=0.8, relbitscore=0.0, genera=6, individuals=2), replicates=5)
    path = f"file://{tmp_path}/runs"
    first = resume.assign_more(path, frame(asked[:2]), rec, config)
    old = {(r.query, r.path, r.prob) for r in first["posterior"].collect()}
    runs = {r.query: r.run for r in first["posterior"].select("query", "run").distinct().collect()}
    assert set(runs) == {"q1", "q8"}
    second = resume.assign_more(path, frame(asked), rec, config)
    now = {r.query: r.run for r in second["posterior"].select("query", "run").distinct().collect()}
    assert {q: now[q] for q in runs} == runs and set(now) == {"q1", "q8", "q15", "q22"} and len(set(now.values())) == 2
    assert old <= {(r.query, r.path, r.prob) for r in second["posterior"].collect()}
    third = resume.assign_more(path, frame(asked), rec, config)
    assert {r.run for r in third["selected"].select("run").distinct().collect()} == set(now.values()) and third["failed"].count() == 0
    # Rows of a run that is not in the ledger are not read.
    spark.read.parquet(f"{path}/posterior/run={now['q1']}").write.parquet(f"{path}/posterior/run=dead")
    assert resume.assign_more(path, frame(asked), rec, config)["posterior"].count() == second["posterior"].count()


def test_slashes_in_names(spark):
    trees = spark.createDataFrame([("q", lineage(phylum="A/B", genus="E%/S")), ("q", lineage(phylum="A/B", genus="T"))], f"query string, lineage {L.ENTRY_ARRAY}")
    summary = R.summarise(trees)
    assert {r.path for r in R.leaves(summary).collect()} == {"phylum:A%2FB/genus:E%25%2FS", "phylum:A%2FB/genus:T"}
    low = summary.withColumn("cnt", F.when(F.col("depth") == 1, 0).otherwise(F.col("cnt")))
    assert {r["name"]: r.cnt for r in R.repair(low).collect()} == {"A/B": 2, "E%/S": 1, "T": 1}
    assert {r.path: (r.n, len(r.leaves)) for r in R.leaf_sets(summary).collect()}["phylum:A%2FB"] == (2, 2)


def test_lost_replicates_count(spark):
    """Alignments with too few bases give no distances; their replicates still count as trees."""
    rows = [("q", n, "ACGTACGTAC") for n in ("q", "a", "b", "c")]
    df = spark.createDataFrame(rows, "query string, name string, aligned string")
    clades = N.bootstrap_clades(df, 5)
    assert {(r.rep, len(r.clade)) for r in clades.collect()} == {(i, 0) for i in range(5)} and N.clade_support(clades, 5).count() == 0
    three = spark.createDataFrame([("q", n, "ACGTACGTAC" * 5) for n in "qab"], "query string, name string, aligned string")
    assert {(r.rep, len(r.clade)) for r in N.bootstrap_clades(three, 3).collect()} == {(i, 0) for i in range(3)}


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">q1 'x' \"y\"\nACG T\nTTT\n\n>q2\nAC\n")
    got = {r.title: r.sequence for r in files.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"q1 'x' \"y\"": "ACGTTTT", "q2": "AC"}
    with pytest.raises(Exception, match="id stands twice"):
        files.checked_ids(spark.createDataFrame([("a",), ("a",)], "id string"), "id").collect()
    rec = spark.createDataFrame([("i1 ; genus: G, species: G s ; G s", "ac-gx"), ("broken", "A")], "title string, sequence string")
    good, bad = files.native_records(rec)
    assert [(r.id, r.sequence, L_) for r in good.collect() for L_ in [r.lineage[0].name]] == [("i1", "ACGN", "G")] and bad.count() == 1
    assert files.taxon_index(good).count() == 2
    name = "a_name_that_is_longer_than_forty_characters_by_far"
    text = sinks.nexus_alignment(spark.createDataFrame([("q", name, "AC-T"), ("q", "b", "ACGT")], "query string, name string, aligned string")).first().text
    (tmp_path / "a.nex").write_text(text)
    assert {(r.name, r.aligned) for r in files.nexus_matrix(spark, str(tmp_path / "a.nex")).collect()} == {(name, "AC-T"), ("b", "ACGT")}
    with pytest.raises(Exception, match="differ in length"):
        sinks.phylip_alignment(spark.createDataFrame([("q", "a", "AC"), ("q", "b", "A")], "query string, name string, aligned string")).collect()
    (tmp_path / "h.xml").write_text("<B><Hit><Hit_id>g1</Hit_id><Hit_len>9</Hit_len><Hit_hsps><Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_evalue>0.1</Hsp_evalue><Hsp_query-from>3</Hsp_query-from><Hsp_query-to>7</Hsp_query-to><Hsp_hit-from>9</Hsp_hit-from><Hsp_hit-to>5</Hsp_hit-to></Hsp></Hit_hsps></Hit></B>")
    h = files.search_results(spark, str(tmp_path / "h.xml")).first()
    assert (h.id, h.score, h.q_start, h.q_len, h.q_strand, h.s_start, h.s_strand) == ("g1", 50.5, 2, 5, 1, 4, -1)
    (tmp_path / "k.txt").write_text("a=1\nb=x=y\n")
    assert {(r.key, r.value) for r in files.key_values(spark, str(tmp_path / "k.txt")).collect()} == {("a", "1"), ("b", "x=y")}
    (tmp_path / "t.nex").write_text("#NEXUS\nbegin data;\nmatrix\n a AC-T\n 'b' ACGT\n;\nend;\nbegin trees;\n   tree t1 = [&U] (a,b);\nend;\n")
    assert {r.name: r.aligned for r in files.nexus_matrix(spark, str(tmp_path / "t.nex")).collect()} == {"a": "AC-T", "b": "ACGT"}
    assert files.nexus_trees(spark, str(tmp_path / "t.nex")).first().newick == "(a,b)"
    (tmp_path / "c.txt").write_text("a b | c d\na | c d\n")
    assert files.constraints(spark, str(tmp_path / "c.txt")).count() == 1


def test_fasta_format(spark, tmp_path):
    """The format reads what the text reader reads, however files are split, and writes what it reads."""
    rng = random.Random(41)
    text = "".join(f">t{i} some words\n" + "".join("".join(rng.choices("ACGT", k=rng.randrange(0, 40))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randrange(4))) for i in range(80))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(text, newline="")
    (tmp_path / "in" / "b.fasta").write_text(">only\nAC GT")
    (tmp_path / "in" / "c.fasta").write_text("")
    fasta_source.register(spark)
    want = {tuple(r) for r in files.fasta(spark, str(tmp_path / "in")).collect()}
    for split in (1, 7, 50, 1 << 20):
        got = spark.read.format("fasta").option("split", split if split > 1 else 13).load(str(tmp_path / "in")).collect()
        assert {tuple(r) for r in got} == want and len(got) == 81
    for i in range(0, len(text), 3):  # every record is in one range, wherever it is cut
        with open(tmp_path / "in" / "a.fasta", "rb") as f:
            assert len([*fasta_source._records(f, 0, i), *fasta_source._records(f, i, len(text))]) == 80, i
    out = f"file://{tmp_path}/out"
    df = spark.read.format("fasta").load(f"file://{tmp_path}/in")
    df.repartition(3).write.format("fasta").option("width", 7).mode("append").save(out)
    again = spark.read.format("fasta").load(out)
    assert {tuple(r)[1:] for r in again.collect()} == {w[1:] for w in want} and not list((tmp_path / "out").glob("_temporary*"))
    assert [r.title for r in df.filter("title in ('only', 'nowhere')").collect()] == ["only"]


def test_containment_by_rare_words(spark):
    """Words of any length, short ones and nulls among them, against a plain search."""
    rng = random.Random(51)
    word = lambda n: "".join(rng.choices("abAB", k=n))
    rows = [(i, rng.choice(["g", "h", None]), word(rng.choice([0, 1, 3, 6, 12, 30, 60]))) for i in range(250)] + [(900 + i, "g", "common" * 9) for i in range(5)] + [(999, "g", None)]
    df = spark.createDataFrame(rows, "id int, g string, seq string")
    up = [(i, g, None if x is None else x.upper()) for i, g, x in rows]
    inside = {i for i, g, x in up if x is not None and any(h == g and j != i and y is not None and x in y for j, h, y in up)}
    assert {r.id for r in X.not_contained(df, df, ["g"], k=5).collect()} == {i for i, *_ in rows} - inside
    some = [r for r in rows if r[0] % 3 == 0]
    acc = spark.createDataFrame(some, "id int, g string, seq string")
    want = {i for i, g, x in up if x is not None and any(h == g and y is not None and x in y.upper() for j, h, y in some)}
    assert {r.id for r in X.contained(df, acc, ["g"], k=5).collect()} == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", "A" * 250)], "title string, sequence string")
    sinks.write_fasta(df, str(tmp_path / "out"))
    assert files.fasta(spark, str(tmp_path / "out")).first().sequence == "A" * 250
    al = spark.createDataFrame([("q", "a", "AC"), ("q", "b", "A-")], "query string, name string, aligned string")
    assert "ntax=2 nchar=2" in sinks.nexus_alignment(al).first().text and sinks.phylip_alignment(al).first().text.startswith("2 2\n")
    with pytest.raises(Exception, match="differ in length"):
        sinks.nexus_alignment(al.union(spark.createDataFrame([("q", "c", "A")], al.schema))).collect()
    trees = spark.createDataFrame([("q", lineage(genus="G", species="G a")), ("q", lineage(genus="G", species="G b")), ("q", lineage(genus="H", species="H c"))], f"query string, lineage {L.ENTRY_ARRAY}")
    s = R.summarise(trees)
    assert sinks.newick(s).first().newick == "((G_a,G_b),H_c);" or sinks.newick(s).first().newick == "(H_c,(G_a,G_b));"
    lines = sinks.ascii_tree(R.posteriors(s, R.tree_counts(trees))).orderBy("path").collect()
    assert lines[0].line == "+G (genus) 67%" and lines[1].line.startswith("    +G a")
    priors = spark.createDataFrame([("q", "genus:G", 0.5)], "query string, path string, prior double")
    lines = sinks.ascii_tree(R.posteriors(s, R.tree_counts(trees)), priors).orderBy("path").collect()
    assert lines[0].line == "+G (genus) 67% bf: 2.00" and "bf" not in lines[1].line
    sinks.write_table(df.select("title"), str(tmp_path / "tsv"))
    assert files.table(spark, str(tmp_path / "tsv")).first().title == "t"


def test_database_by_name_or_path(spark, tmp_path):
    (tmp_path / "db.fasta").write_text(">i1 ; genus: G, species: G s ; G s\nac-gx\n>broken\nAC\n")
    assert [(r.id, r.seq) for r in assignment.database_records(spark, str(tmp_path / "db.fasta")).collect()] == [("i1", "ACGN")]
    assignment.PLUGINS.add("records", "Mine", lambda s: s.range(3))
    assert assignment.database_records(spark, "mine").count() == 3
    with pytest.raises(PluginNotFoundError):
        assignment.database_records(spark, str(tmp_path / "none.fasta"))
    missing = files.table(spark, str(tmp_path / "none.tsv"))
    assert missing.count() == 0 and missing.columns == []


def test_own_database_and_aligner(spark):
    """An example of plug-ins: a search that knows its hits, and sequences that are aligned already."""
    seq = ["ACGTACGTAC" * 6, "ACGTACGTAT" * 6, "ACGTTCGTAC" * 6, "TCGTACGAAC" * 6]
    line = lambda i: lineage(phylum="P", **{"class": "C"}, order="O", family=f"F{i // 2}", genus=f"G{i}", species=f"G{i} s")
    rec = spark.createDataFrame([(f"r{i}", x, f"G{i} s", line(i)) for i, x in enumerate(seq)], f"id string, seq string, organism string, lineage {L.ENTRY_ARRAY}")
    qs = spark.createDataFrame([("q", seq[0])], "id string, seq string")
    all_pairs = lambda q, r, c: q.select(F.col("id").alias("query")).crossJoin(r.select("id")).withColumn("ord", F.substring("id", 2, 1).cast("int")).withColumn("score", F.lit(9.0)).withColumn("significance", F.lit(0.0))
    assignment.PLUGINS.add("database", "all", all_pairs)
    out = assignment.assign(qs, rec, assignment.AssignConfig(quotas=X.Quotas(nrsignificant=3), database="all", alignment="prealigned", replicates=3))
    assert {r["name"]: r.prob for r in out["posterior"].collect()}["P"] == 1.0


def test_plugins():
    p = Plugins()
    p.add("database", "Mine", len)
    assert p.find("database", "mine") is len
    with pytest.raises(PluginNotFoundError):
        p.find("alignment", "mine")
    with pytest.raises(ValueError):
        assignment.AssignConfig(cutoffs=(40,))


def test_stream(spark, tmp_path):
    rows = [("a", "ACGT", "2024-01-01 00:00:00"), ("b", "ACGT", "2024-01-01 01:00:00"), ("c", "TT~.", "2024-01-01 02:00:00"), ("d", "~", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "id string, sequence string, t string").select("id", "sequence", F.to_timestamp("t").alias("seen")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.first_copies(ingest.records(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ACGT", "TT"]
    trees = spark.createDataFrame([("q", lineage(genus="G")), ("q", lineage(genus="H"))], f"query string, lineage {L.ENTRY_ARRAY}")
    trees.coalesce(1).write.parquet(str(tmp_path / "trees"))
    q = ingest.grow_summary(spark.readStream.schema(trees.schema).parquet(str(tmp_path / "trees")), str(tmp_path / "sum"), str(tmp_path / "c2"))
    assert q.awaitTermination(60)
    assert {r.path: r.cnt for r in ingest.read_summary(spark, str(tmp_path / "sum")).collect()} == {"genus:G": 1, "genus:H": 1}


def test_difference_triangular_by_blocks(spark, monkeypatch):
    """Against all pairs: groups of different sizes over several blocks, ragged and null vectors, unknown states."""
    monkeypatch.setattr(A, "RUN", 8)
    rng = random.Random(21)
    rows = [(g, i, rng.choices([True, False, None], [5, 5, 1], k=rng.choice([0, 3, 5, 5, 5]))) for g, n in ((1, 45), (2, 3), (3, 30), (4, 1)) for i in rng.sample(range(1000), n)] + [(2, 2000, None), (None, 1, [True])]
    df = spark.createDataFrame(rows, "g long, m long, states array<boolean>")
    got = {(r.a, r.b): r.difference for r in A.mean_difference_triangular(df, "g", "m").collect()}
    want = {}
    at = lambda g, k: [s[k] for h, m, s in sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: r[1]) if len(s) > k]
    for a in range(1, 5):
        for b in range(a + 1, 5):
            pairs = [(x, y) for k in range(5) for i, x in enumerate(at(a, k)) for y in at(b, k)[i:]]
            if pairs:
                want[a, b] = sum(x is not None and y is not None and x != y for x, y in pairs) / len(pairs)
    assert got == pytest.approx(want) and len(want) > 3


def test_search_results_of_one_file_are_split(spark, tmp_path):
    one = "<Hit>\n <Hit_id>g{0}</Hit_id><Hit_len>9</Hit_len><Hit_hsps><Hsp><Hsp_bit-score>{0}.5</Hsp_bit-score><Hsp_evalue>0.1</Hsp_evalue><Hsp_query-from>3</Hsp_query-from><Hsp_query-to>7</Hsp_query-to><Hsp_hit-from>9</Hsp_hit-from><Hsp_hit-to>5</Hsp_hit-to></Hsp></Hit_hsps>\n</Hit>\n"
    (tmp_path / "h.xml").write_text("<Hits>\n" + "".join(one.format(i) for i in range(3000)) + "</Hits>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        h = files.search_results(spark, str(tmp_path / "h.xml"))
        assert h.rdd.getNumPartitions() > 10
        assert sorted((r.id, r.score, r.q_start, r.s_strand) for r in h.collect()) == sorted((f"g{i}", i + 0.5, 2, -1) for i in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_search_xml_takes_little_disk(spark, tmp_path, monkeypatch):
    """Hits take some ten bytes each for their numbers, not hundreds for their tags, and none is lost; rows of even partitions are not shuffled."""
    from cladewise.plans import catalog, selection_queries

    monkeypatch.setattr(selection_queries, "new_path", lambda _, name: f"{tmp_path}/{name}")
    n = catalog.QUERIES["xml_hits"](spark, "/root/testdata/sf0.001").count()
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 60 * n == 60 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()

    monkeypatch.setattr(sinks, "PER_FILE", 100)
    hit = F.struct(F.col("id").cast("double").alias("Hsp_bit-score"), F.lit(0.1).alias("Hsp_evalue"), *(F.lit(i).alias(c) for i, c in enumerate(("Hsp_query-from", "Hsp_query-to", "Hsp_hit-from", "Hsp_hit-to"), 3)))
    made = lambda x: x.select(F.concat(F.lit("g<&"), "id").alias("Hit_id"), F.struct(F.array(hit).alias("Hsp")).alias("Hit_hsps"))
    for i, (rows, parts) in enumerate(((spark.range(0, 1000, 1, 1), 10), (spark.range(0, 1000, 1, 7), 7), (spark.range(0, 1000, 1, 3), 3), (spark.range(1000, 1050, 1, 2), 2), (spark.range(0), None))):
        x = sinks.dealt(rows)
        assert parts in (None, x.rdd.getNumPartitions()), i
        sinks.write_xml(made(x), f"{tmp_path}/{i}", "Hits", "Hit")
        assert sorted((r.id, r.score) for r in files.search_results(spark, f"{tmp_path}/{i}").collect()) == sorted((f"g<&{r.id}", float(r.id)) for r in rows.collect())
        assert all(n <= 100 for n in (r[0] for r in spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/{i}").filter("value like '%<Hit>%'").groupBy(F.col("_metadata.file_name")).count().select("count").collect()))


def test_mapped_letters(spark):
    """As regexp_replace, upper and translate give it, without their time for each character."""
    texts = ["Ab.c~ Zz9\t\n-é ß ı ſ K 😀 xyz", "", None, "the quick brown fox JUMPS", "~~..  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plain = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), adapters.MAP_FROM, adapters.MAP_TO)
    got = df.select(S.mapped(F.col("text"), adapters.BASES).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in got.collect()) and "translate" not in got.select("a")._jdf.queryExecution().executedPlan().toString()


def test_extension_of_many_rows(spark, monkeypatch):
    """Rows together give what each gives alone, and what counting gives, however they are cut."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        query = "".join(rng.choices("ACGT", k=rng.randint(30, 80)))
        offset = rng.choice([0, 3])
        part = "".join(c if rng.random() > 0.1 else rng.choice("ACGTN") for c in query[offset : len(query) - rng.randint(0, 9)])
        rows.append((query, part, offset, [offset + rng.randint(0, len(part) - 11) for _ in range(rng.randint(1, 4))]))

    def side(x):
        best, n, total = 0, 0, 0
        for i, v in enumerate(x, 1):
            total += v
            if total > best:
                best, n = total, i
            if best - total > 20:
                break
        return best, n

    want = []
    for query, part, offset, places in rows:
        each = [1 if a == b else -2 for a, b in zip(query[offset:], part)]  # noqa: B905
        islands, found = [], set()
        for p in sorted(places):
            if not islands or p - islands[-1][1] > 40:
                islands.append([p, p])
            islands[-1][1] = p
        for a, b in islands:
            a, b = a - offset, b - offset + 11
            (right, r), (left, n) = side(each[b:]), side(each[:a][::-1])
            found.add((a - n + offset, b + r - a + n, sum(each[a:b]) + right + left))
        want.append(sorted(found))
    assert H.extend_all(rows, 11, H.Scoring()) == want == [H.extend(*x, 11, H.Scoring()) for x in rows]
    monkeypatch.setattr(H, "CELLS", 200)
    assert H.extend_all(rows, 11, H.Scoring()) == want


def test_derived_records_are_dealt_over_tasks(spark):
    """Places are hashed as Spark does it, and what customers ask for is not worked out in one task."""
    df = spark.createDataFrame([(f"k{i}", i, 3 * i) for i in range(50)], "k string, i int, j int")
    got = df.select(F.xxhash64("k").alias("seed"), "j", F.xxhash64("k", "j").alias("h")).toPandas()
    assert (assignment._hashed(got["j"].to_numpy(), got["seed"].to_numpy()) == got["h"].to_numpy()).all()
    _, records = assignment._families(spark, "/root/testdata/sf0.001")
    sizes = records.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
