"""Token ids packed into rows of fixed length by best-fit decreasing, as binary matrices.

Documents longer than a row are cut into whole rows and a rest; nothing is
lost. Rests go longest first into the row with the least room that holds them.
A segment tree over amounts of room finds it: leaf r tells whether a row with
r free places is open, and the search is for the first such leaf at or after
the length. Each task packs what it reads, ``block_tokens`` at a time: no
shuffle, no group, and memory does not depend on the input.

A row holds its ids (little-endian, 16 bits each if the vocabulary allows, else
32), padded; cumulative segment lengths from 0; and positions that start again
at 0 with each segment.

Defined results: a null or empty text is the end token alone; null ids and
repeated rows are packed as they come; an empty table gives no rows; of equal
lengths the earlier document goes first, of rows with equal room the latest
opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .token_ids import tokenizer

SCHEMA = "sequence_id long, tokens int, ids binary, cu_lengths array<int>, positions binary, doc_ids array<long>, starts array<long>"
PER_TASK = 1 << 33


class Room:
    """Open rows by free places, in a segment tree over 0..capacity."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = self.base + free
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The least room of at least ``need``, and a row that has it; the row is no longer open."""
        i, tree = self.base + need, self.tree
        while not tree[i]:
            while i & 1:  # a right child: go on above
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.base:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        free = i - self.base
        row = self.rows[free].pop()
        if not self.rows[free]:
            while i and not (i < self.base and (tree[2 * i] or tree[2 * i + 1])):
                tree[i] = 0
                i >>= 1
        return free, row


def best_fit(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document, start, length)."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            rows.append([(doc, start, capacity)])
        if n % capacity:
            rests.append((-(n % capacity), doc))
    room = Room(capacity)
    for n, doc in sorted(rests):
        n = -n
        found = room.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        free, row = found
        rows[row].append((doc, lengths[doc] - n, n))
        if free > n:
            room.add(free - n, row)
    return rows


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, ranks_path: str | None = None, merges_path: str | None = None, end_id: int = 50256, pad_id: int = 50256, block_tokens: int = 1 << 20) -> DataFrame:
    """A row for each packed sequence."""
    ramp = np.arange(capacity, dtype="<u2" if capacity <= 1 << 16 else "<u4")

    def pack(ids: list, tokens: list[np.ndarray], first: int, kind: str) -> pa.RecordBatch:
        rows = best_fit([len(t) for t in tokens], capacity)
        out = {k: [] for k in ("sequence_id", "tokens", "ids", "cu_lengths", "positions", "doc_ids", "starts")}
        for i, row in enumerate(rows):
            lengths = [n for _, _, n in row]
            cu = np.concatenate(([0], np.cumsum(lengths)))
            line = np.full(capacity, pad_id, kind)
            line[: cu[-1]] = np.concatenate([tokens[d][s : s + n] for d, s, n in row])
            place = np.zeros(capacity, ramp.dtype)
            place[: cu[-1]] = np.concatenate([ramp[:n] for n in lengths])
            for k, v in zip(out, (first + i, int(cu[-1]), line.tobytes(), cu.astype(np.int32), place.tobytes(), [ids[d] for d, _, _ in row], [s for _, s, _ in row]), strict=True):
                out[k].append(v)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks_path, merges_path, special=False)
        kind = "<u2" if max(end_id, pad_id, tok.largest) < 1 << 16 else "<u4"
        first = TaskContext.get().partitionId() * PER_TASK
        ids, tokens, size = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens.append(np.append(tok.ids(text), np.uint32(end_id)).astype(kind))
                ids.append(doc_id)
                size += len(tokens[-1])
                if size >= block_tokens:
                    out = pack(ids, tokens, first, kind)
                    first += out.num_rows
                    yield out
                    ids, tokens, size = [], [], 0
        if size:
            yield pack(ids, tokens, first, kind)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: id matrices and positions as fixed-length binary, offsets as arrays."""
    packed.write.parquet(path)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("sequence_id", "tokens", "cu_lengths", "doc_ids", "starts", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
