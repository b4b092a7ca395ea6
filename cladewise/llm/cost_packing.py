"""Cost-balanced packing of token ids into sequences of bounded length.

A segment of n tokens costs ``linear * n + quadratic * n * n``: attention does
not cross segments. Documents go longest first to the sequence of lowest cost
that can take them whole; only where no open sequence can, the document is cut
and the cheapest open sequence is filled. Nothing is dropped. A segment tree
over used tokens, its leaves heaps of costs, finds the sequence.

Each task packs what it reads, ``block_tokens`` at a time, so there is no
shuffle, no group, and memory does not depend on the input. A repeated task
repeats its result. A block leaves at most one sequence that is not full.

Defined results: a null or empty text is one piece of the end token alone; null
ids and repeated rows are packed as they come; an empty table gives no pieces;
of equal lengths the earlier row goes first, of equal costs the lower sequence.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .token_ids import tokenizer

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Sequences that one task can number.
PER_TASK = 1 << 33


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences."""
    out: list[tuple[int, int, int, int, int]] = []
    count, rest = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((doc, start, capacity, count, 0))
            count += 1
        if n % capacity:
            rest.append((-(n % capacity), doc, n - n % capacity))
    heapq.heapify(rest)
    need = -(-sum(-x[0] for x in rest) // capacity)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity)]
    heaps[0] = [(0.0, count + i) for i in range(need)]  # in order, so a heap
    base = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * base)
    where = [0] * need  # used tokens

    def renew(used: int) -> None:
        i = base + used
        tree[i] = heaps[used][0] if heaps[used] else none
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    if need:
        renew(0)
    while rest:
        n, doc, start = heapq.heappop(rest)
        n = -n
        chosen, i = none, base + capacity - n + 1  # the least of those that use at most capacity - n
        while i > 1:
            if i & 1 and tree[i - 1] < chosen:
                chosen = tree[i - 1]
            i >>= 1
        if chosen is none:  # cut it: fill the cheapest
            chosen = tree[1]
            part = capacity - where[chosen[1] - count]
            heapq.heappush(rest, (part - n, doc, start + part))
            n = part
        cost, k = chosen
        used = where[k - count]
        heapq.heappop(heaps[used])
        renew(used)
        out.append((doc, start, n, k, used))
        where[k - count] = used + n
        if used + n < capacity:
            heapq.heappush(heaps[used + n], (cost + linear * n + quadratic * n * n, k))
            renew(used + n)
    return out, count + need


def pack_by_cost(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, ranks_path: str | None = None, merges_path: str | None = None, end_id: int | None = 0, linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each)."""

    def pack(ids: list, tokens: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        pieces, n = balance([len(t) // 4 for t in tokens], capacity, linear, quadratic)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        blobs = [tokens[d][4 * s : 4 * (s + m)] for d, s, m, _, _ in pieces]
        sizes = np.array([len(t) // 4 for t in tokens], np.int64)
        columns = [pa.array([ids[d] for d in doc], pa.int64()), *map(pa.array, (start, length, sizes[doc], seq + first, offset)), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), first + n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks_path, merges_path)
        first = TaskContext.get().partitionId() * PER_TASK
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        ids, tokens, size = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens.append(tok.ids(text).astype("<u4", copy=False).tobytes() + end)
                ids.append(doc_id)
                size += len(tokens[-1]) // 4
                if size >= block_tokens:
                    out, first = pack(ids, tokens, first)
                    yield out
                    ids, tokens, size = [], [], 0
        if size:
            out, first = pack(ids, tokens, first)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, SCHEMA)


def op10_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_by_cost(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
