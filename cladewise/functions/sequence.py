"""Column functions on sequences and names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nucleotide codes in capitals, and the 4-bit mask of each (A=1, C=2, G=4, T=8).
CODES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15}
LONGEST_NAME = 150


#: Marks that become underscores, and marks that go.
SEPARATORS, MARKS = r"[-/\\()|<>.,:;\[\] ]", "[!@#$%^&*+?~`\"']"


def safe_name(s: Column) -> Column:
    """A name usable in files and trees: separators become underscores, other marks go."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), SEPARATORS, "_"), MARKS, "")


def base_name(s: Column) -> Column:
    """Letters, digits and dots only; with n before a leading digit."""
    kept = F.regexp_replace(s, "[^0-9a-zA-Z.]", "")
    return F.when(kept.rlike("^[0-9]"), F.concat(F.lit("n"), kept)).otherwise(kept)


def qualified_name(file: Column, title: Column) -> Column:
    """``file_title``; null where it is over 150 characters, which is an error to report."""
    name = F.concat_ws("_", file, title)
    return F.when(F.length(name) <= LONGEST_NAME, name)


def organism_label(s: Column) -> Column:
    return F.replace(F.translate(s, " -", "__"), F.lit("'"), F.lit(""))


def first_word(s: Column) -> Column:
    return F.regexp_extract(s, r"^(\S+)", 1)


def clean_query(seq: Column) -> Column:
    """Drops ``~`` and ``.``; what is no nucleotide code becomes N. Gaps stay."""
    return F.regexp_replace(F.regexp_replace(seq, "[~.]", ""), "[^ACGTUMRWSYKVHDBNacgtumrwsykvhdbn-]", "N")


def clean_record(seq: Column) -> Column:
    """Upper case, unknown letters N, gaps removed."""
    return F.replace(F.regexp_replace(F.upper(seq), "[^ACGTUMRWSYKVHDBN-]", "N"), F.lit("-"), F.lit(""))


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "AGTC", "TCAG")


def trim_unknown(seq: Column) -> Column:
    """Without Ns at either end and without inner runs of 50 or more."""
    return F.regexp_replace(seq, "(^N*)|(N{50,})|(N*$)", "")


def leading_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(F.ltrim(seq, F.lit("-")))


def trailing_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, F.lit("-")))


def has_inner_gap(seq: Column) -> Column:
    return ~seq.rlike("^-*[^-]+-*$")


def cut_to(seq: Column, query: Column) -> Column:
    """The part of an aligned sequence between the first and last site of the query."""
    return F.substring(seq, leading_gaps(query) + 1, F.length(query) - leading_gaps(query) - trailing_gaps(query))


def hit_window(q_start: Column, q_len: Column, q_strand: Column, s_start: Column, s_len: Column, s_strand: Column, query_length: Column, flanks: int, size: Column) -> Column:
    """Start and end (0-based, end exclusive) of what is kept of a hit: twice the query's overhang on each side, swapped on strand mismatch, widened by ``flanks`` and held within the sequence."""
    left, right = 2 * q_start, 2 * (query_length - q_len - q_start)
    same = q_strand == s_strand
    before, after = F.when(same, left).otherwise(right), F.when(same, right).otherwise(left)
    return F.struct(F.greatest(F.lit(0), s_start - before - flanks).alias("start"), F.least(size, s_start + s_len + after + flanks).alias("end"))


_GAP = ord("-")
_BASE = np.zeros(256, np.uint8)
_BASE[list(b"AGCT")] = [1, 2, 4, 8]  # purines are 1 and 2


def _codes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both strings as arrays of one number a character."""
    if a.isascii() and b.isascii():
        return np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)


def _shared(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Sites of both within the window that both cover."""
    start = max(len(x) - len(x.lstrip("-")) for x in (a, b))
    end = max(start, min(len(x.rstrip("-")) for x in (a, b)))
    return _codes(a[start:end], b[start:end])


def _of_pairs(kernel: Callable, kind: str) -> Callable[[Column, Column], Column]:
    """A column function of two strings from a function of two str; null with a null. Arrow batches, numpy within."""

    def apply(a: Column, b: Column) -> Column:
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else kernel(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

        def run_struct(x: pd.Series, y: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(None,) * 3 if p is None or q is None else kernel(p, q) for p, q in zip(x, y, strict=True)], columns=["aligned", "transitions", "transversions"], dtype="Int64")

        if kind.startswith("struct"):
            return F.pandas_udf(run_struct, kind)(a, b)
        run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)(a, b)

    return apply


def _similarity(a: str, b: str) -> float | None:
    x, y = _shared(a, b)
    some = int(((x != _GAP) | (y != _GAP)).sum())
    return int(((x == y) & (x != _GAP)).sum()) / some if some else None


def _identity(a: str, b: str) -> float | None:
    x, y = _shared(a, b)
    return int((x == y).sum()) / len(x) if len(x) else None


def _substitutions(a: str, b: str) -> tuple[int, int, int]:
    n = min(len(a), len(b))
    x, y = (np.where(c < 256, _BASE[np.minimum(c, 255)], 0) for c in _codes(a[:n], b[:n]))
    both = (x > 0) & (y > 0)
    same_kind = (x < 4) == (y < 4)
    return int(both.sum()), int((both & (x != y) & same_kind).sum()), int((both & ~same_kind).sum())


def _mark(seq: str, query: str) -> str:
    n = min(len(seq), len(query))
    x, y = _codes(seq[:n], query[:n])
    if x.dtype == np.uint8:
        capital = (x == y) & (x >= 65) & (x <= 90)
        return (x + np.where(capital, 32, 0).astype(np.uint8)).tobytes().decode() + seq[n:]
    return "".join(p.lower() if p == q else p for p, q in zip(seq[:n], query[:n], strict=True)) + seq[n:]


def mapped(s: Column, to: dict[str, str]) -> Column:
    """Each character replaced as told; others go. Keys and values are ASCII, so bytes are looked at: Spark's translate takes some hundred times as long."""
    table = bytes.maketrans("".join(to).encode(), "".join(to.values()).encode())
    gone = bytes(i for i in range(256) if chr(i) not in to)

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else v.encode().translate(table, gone).decode() for v in x], dtype=object)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(s)


def similarity(a: Column, b: Column) -> Column:
    """Equal sites over sites that are not a gap in both, within the common window; null without any."""
    return _of_pairs(_similarity, "double")(a, b)


def identity(a: Column, b: Column) -> Column:
    """Equal sites, gaps included, over the length of the common window; null if it is empty."""
    return _of_pairs(_identity, "double")(a, b)


def substitutions(a: Column, b: Column) -> Column:
    """aligned, transitions, transversions over sites where both are plain bases."""
    return _of_pairs(_substitutions, "struct<aligned:long,transitions:long,transversions:long>")(a, b)


#: Distance of a saturated pair, and the least number of aligned bases.
SATURATED, LEAST_ALIGNED = 10000.0, 20


def k2p(aligned: Column, transitions: Column, transversions: Column) -> Column:
    """Kimura two-parameter distance; SATURATED where a logarithm has no value, null with too few bases."""
    p, q = F.try_divide(transitions.cast("double"), aligned), F.try_divide(transversions.cast("double"), aligned)
    a, b = F.lit(1.0) - 2 * p - q, F.lit(1.0) - 2 * q
    d = F.when((a <= 0) | (b <= 0), F.lit(SATURATED)).otherwise(F.lit(-0.5) * F.log(a) - F.lit(0.25) * F.log(b))
    return F.when(aligned >= LEAST_ALIGNED, d)


def code_mask(base: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), base)


def base_of(mask: Column) -> Column:
    """The code of a mask; U, which has the mask of T, is not told from it."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in CODES.items() if k != "U" for x in (v, k))), mask)


def mark_matches(seq: Column, query: Column) -> Column:
    """Sites equal to the query's in lower case."""
    return _of_pairs(_mark, "string")(seq, query)


def similarity_colour(score: Column) -> Column:
    """Hex colour of a score: two ramps that meet at 0.5, after 0.7 to 1 is stretched to 0 to 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 0.7) / 0.3))
    part = lambda x: F.lpad(F.hex(F.floor(x * 255).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(F.least(F.lit(1.0), 2 * (1 - s))), part(F.least(F.lit(1.0), 2 * s)), F.lit("00"))


def percent(p: Column) -> Column:
    text = F.concat(F.round(p * 100).cast("int").cast("string"), F.lit("%"))
    return F.when(text == "0%", "~0%").otherwise(text)


def search_filter(limit: str, exclude: list[str]) -> str:
    """The text of a remote search's restriction."""
    return f"({limit}) NOT ({' OR '.join(['uncultured[WORD]', *(f'{t}[ORGN]' for t in exclude)])})"
