"""Trees in Newick text and Nexus files, read as bit sets over their leaves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comments, quoted labels, marks and plain labels.
TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s()\[\]':;,]+")


class NewickError(ValueError):
    pass


def parse(text: str, names: dict[str, str] | None = None) -> tuple[list[str], list[int], list[float | None], list[str], int]:
    """Leaves in order of name; of each clade (an inner node, the root aside) its leaves as bits of a number, its length and its label; and how many children the root has.

    names: what labels of leaves stand for, as a translate command says.
    """
    parent, label, length = [-1], [""], [None]
    children = [0]
    now, number = 0, False

    def node(up: int) -> int:
        parent.append(up)
        label.append("")
        length.append(None)
        children.append(0)
        children[up] += 1
        return len(parent) - 1

    depth = 0
    for m in TOKEN.finditer(text):
        t = m[0]
        if t[0] == "[":
            continue
        if t == "(":
            if children[now] or label[now]:
                raise NewickError("a group begins where none may")
            now, depth = node(now), depth + 1
        elif t == ",":
            if not depth:
                raise NewickError("a comma outside of groups")
            now = node(parent[now])
        elif t == ")":
            if not depth:
                raise NewickError("too many closing marks")
            now, depth = parent[now], depth - 1
        elif t == ";":
            break
        elif t == ":":
            number = True
            continue
        elif number:
            try:
                length[now] = float(t)
            except ValueError:
                raise NewickError(f"no length: {t}") from None
        else:
            label[now] = t[1:-1].replace("''", "'") if t[0] == "'" else t
        number = False
    if depth:
        raise NewickError("a group does not end")
    own = [(names or {}).get(x, x) for x in label]
    tips = [i for i in range(len(parent)) if not children[i]]
    leaves = sorted(own[i] for i in tips)
    if "" in leaves or len(set(leaves)) < len(leaves):
        raise NewickError("leaves without a name of their own")
    place = {x: i for i, x in enumerate(leaves)}
    below = [0] * len(parent)
    for i in tips:
        below[i] = 1 << place[own[i]]
    for i in range(len(parent) - 1, 0, -1):  # children come after their parents
        below[parent[i]] |= below[i]
    inner = [i for i in range(1, len(parent)) if children[i]]
    return leaves, [below[i] for i in inner], [length[i] for i in inner], [label[i] for i in inner], children[0]


def _words(bits: int, n: int) -> list[int]:
    raw = bits.to_bytes(-(-n // 64) * 8, "little")
    return np.frombuffer(raw, "<i8").tolist()


TREES = "query string, rep long, tree_name string, leaves array<string>, clades array<array<bigint>>, lengths array<double>, labels array<string>, root_children int, problem string"


def trees(rows: DataFrame) -> DataFrame:
    """Parsed trees; ``problem`` says what is wrong where there is no tree. rows: query, rep, tree_name, newick, names (map or null)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for text, names in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    try:
                        leaves, clades, lengths, labels, degree = parse(text or "", dict(names) if names else None)
                        out.append((leaves, [_words(c, len(leaves)) for c in clades], lengths, labels, degree, None))
                    except NewickError as e:
                        out.append((None, None, None, None, None, str(e)))
                kinds = (pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.float64()), pa.list_(pa.string()), pa.int32(), pa.string())
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], [x.split()[0] for x in TREES.split(", ")])

    return rows.select(F.col("query").cast("string"), F.col("rep").cast("long"), F.col("tree_name").cast("string"), "newick", "names").mapInArrow(task, TREES)


def nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """``trees`` of Nexus files, with the file as query. Files are read by commands, which end in semicolons, so large ones are split; a translate command holds for its file. Labels with semicolons are not read."""
    raw = spark.read.option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("query"), F.regexp_replace("value", r"\[![^\]]*\]", "").alias("c"))
    pairs = raw.filter(F.col("c").rlike(r"(?is)^\s*translate\s")).select("query", F.explode(F.split(F.regexp_replace("c", r"(?is)^\s*translate\s+", ""), ",")).alias("x"))
    pairs = pairs.select("query", F.regexp_extract("x", r"(?s)^\s*(\S+)\s+(.*?)\s*$", 1).alias("k"), F.regexp_replace(F.regexp_extract("x", r"(?s)^\s*(\S+)\s+(.*?)\s*$", 2), "^'|'$", "").alias("v")).filter("k <> ''")
    names = pairs.groupBy("query").agg(F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("names"))  # as many as a tree has leaves
    line = r"(?is)^\s*u?tree\s+\*?\s*([^\s=]+)\s*=\s*(.*)$"
    found = raw.filter(F.col("c").rlike(line)).select("query", F.monotonically_increasing_id().alias("rep"), F.regexp_extract("c", line, 1).alias("tree_name"), F.concat(F.regexp_extract("c", line, 2), F.lit(";")).alias("newick"))
    return trees(found.join(names, "query", "left"))


def leaf_id(name, known):
    """The id in a leaf's name ``id_Organism``: what stands before the first mark, or before the second where only that is among the known ids (an array)."""
    one, two = F.substring_index(name, "_", 1), F.substring_index(name, "_", 2)
    return F.when(F.array_contains(known, one), one).when(F.array_contains(known, two), two)
