"""Byte-level BPE of whole texts by forced boundaries, and back.

Two bytes that stand next to each other inside no token of the vocabulary can
never be merged, so a text may be cut between them, and the parts encoded apart
from each other give the ids of the whole. Cuts are made on two levels:

1. In the text, where the pattern that splits texts cannot look over such a
   pair: where characters change between letters (a-z and those of U+00C0 to
   U+00FF), digits, marks and white space, except behind white space and behind
   an apostrophe; and between two letters, or two digits, which stand in one
   word on both sides. Each fragment is split as it is within the text. Most
   are one word, with the space before it, or some marks; each is encoded once
   and remembered.
2. In a fragment that may be more than one word by its characters: the
   library's own splitter splits it, a word is cut at every such pair, and the
   library's merges encode each part.

Strings of added tokens are cut out first, the leftmost and longest ones, and
stand for their id, as in the library. A task reads and writes slices of its
rows; nothing is shuffled, and a lost task repeats its result.

Defined results: a null or empty text has no ids and decodes to the empty
string; null ids, repeated rows, empty tables and columns of other names are
passed over; ids that are not in the vocabulary decode to nothing, as in the
library; null ids of a list as well.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .token_ids import tokenizer_file

#: Fragments that are remembered, and the longest of them.
KNOWN, LONGEST = 1 << 19, 64
#: Bytes that stand for themselves in vocabularies of this kind; the others are U+0100 and on, in order.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WHITE = [9, 10, 11, 12, 13, 32]
#: Fragments that are one word of the pattern.
ONE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: The first byte of U+00C0 to U+00FF, and the second of the two that are no letters.
LATIN, TIMES, DIVISION = 0xC3, 0x97, 0xB7
#: Kinds of characters.
LETTER, DIGIT, MARK, SPACE = 1, 2, 3, 4


def byte_chars() -> str:
    """The character of each byte."""
    others = iter(range(0x100, 0x200))
    plain = set(PLAIN)
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class Remembered(dict):
    """Ids of short fragments; forgotten when there are many, so memory has a bound."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.encode(fragment)
        if len(fragment) <= LONGEST:
            if len(self) >= KNOWN:
                self.clear()
            self[fragment] = ids
        return ids


class FragmentCoder:
    """Encodes and decodes by one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        as_it_is = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback", "ignore_merges"))
        added = spec.get("added_tokens") or []
        if not as_it_is or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        whole = Tokenizer.from_file(path)
        self.model, self.split = whole.model, whole.pre_tokenizer
        chars = byte_chars()
        of_char = {c: b for b, c in enumerate(chars)}
        raw = {i: bytes(of_char[c] for c in t) for t, i in model["vocab"].items()}
        self.inside = self.pairs(raw.values())
        self.bytes_of = raw | {t["id"]: bytes(of_char[c] for c in t["content"]) if all(c in of_char for c in t["content"]) else t["content"].encode() for t in added}
        self.chars = {b: c for b, c in enumerate(chars)}
        self.joint = {chars[x >> 8] + chars[x & 255] for x in np.flatnonzero(self.inside).tolist()}
        self.kind = np.zeros(256, np.uint8)
        for b in range(0x21, 0x7F):
            self.kind[b] = DIGIT if chr(b).isdigit() else LETTER if chr(b).isalpha() else MARK
        self.kind[WHITE] = SPACE
        self.free = ~self.inside
        self.four = [i.to_bytes(4, "little") for i in range(max(self.bytes_of, default=0) + 1)]
        self.added = {t["content"].encode(): int(t["id"]).to_bytes(4, "little") for t in added if t["content"]}
        self.find = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.known = Remembered(self.fragment)

    @staticmethod
    def pairs(tokens) -> np.ndarray:
        """For each two bytes, 256 * first + second, whether a token holds them next to each other."""
        inside = np.zeros(1 << 16, bool)
        for t in tokens:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[256 * b[:-1] + b[1:]] = True
        return inside

    def fragment(self, raw: bytes) -> bytes:
        """Ids of a fragment."""
        if ONE.fullmatch(raw):
            return b"".join([self.four[t.id] for t in self.model.tokenize(raw.decode("latin-1").translate(self.chars))])
        joint, ids = self.joint, []
        for word, _ in self.split.pre_tokenize_str(raw.decode()):
            start = 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in joint:
                    ids += self.model.tokenize(word[start:i])
                    start = i
            ids += self.model.tokenize(word[start:])
        return b"".join([self.four[t.id] for t in ids])

    def cuts(self, raw: bytes) -> np.ndarray:
        """Where fragments of a text begin, its start aside."""
        b = np.frombuffer(raw, np.uint8)
        kind = self.kind[b]
        lead = np.flatnonzero(b[:-1] == LATIN)
        lead = lead[(b[lead + 1] != TIMES) & (b[lead + 1] != DIVISION)]
        kind[lead] = kind[lead + 1] = LETTER
        one, two, left = kind[:-1], kind[1:], b[:-1]
        ends = (one != two) & ((left != ord("'")) | (two == SPACE)) | (one == two) & (one < MARK)
        sure = ends & (one > 0) & (one < SPACE) & (two > 0) & (left != LATIN)
        return np.flatnonzero(sure & self.free[(left.astype(np.uint16) << 8) + b[1:]]) + 1

    def part(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        at = [0, *self.cuts(raw).tolist(), len(raw)]
        return b"".join(map(self.known.__getitem__, [raw[s:e] for s, e in zip(at, at[1:])]))

    def encode(self, raw: bytes | None) -> bytes:
        """Ids of a text in UTF-8, four bytes each, little-endian."""
        if not raw:
            return b""
        if self.find is None or not self.find.search(raw):
            return self.part(raw)
        return b"".join(self.added[x] if i % 2 else self.part(x) for i, x in enumerate(self.find.split(raw)))

    def decode(self, ids: list[int | None]) -> str:
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes_of.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


_OPEN: dict[str, FragmentCoder] = {}


def coder(path: str | None = None) -> FragmentCoder:
    """One for each worker process and vocabulary."""
    path = path or tokenizer_file("byte_bpe_50k.json")
    if path not in _OPEN:
        _OPEN[path] = FragmentCoder(path)
    return _OPEN[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in slices(batches):
            ids = [by.encode(raw) for raw in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, path: str | None = None) -> DataFrame:
    """doc_id, ids and their text (decoded) of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in slices(batches):
            texts = [by.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>, decoded string")


def op12_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
