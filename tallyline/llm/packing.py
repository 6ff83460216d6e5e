"""Packing: token ids of documents in windows of equal capacity, filled nearly equally.

Documents longer than a window give whole windows; what is left of each is an item.
Karmarkar-Karp differencing spreads a group's items over k windows: each item starts as a
partial partition with one filled window; the two partial partitions with the greatest
imbalance are merged, the fullest windows of one with the emptiest of the other, until one
is left. k starts at the least number that can hold the items and rises while a window
exceeds its capacity; where two percent more don't help, long items are cut in halves.

Full groups are formed inside a task from the rows it reads, at most GROUP items and
GROUP_TOKENS tokens each; such a group wastes less than about one window of some hundreds.
What a task has left over for no full group is dealt to groups of that size over all tasks,
the only rows that are shuffled: less than one group a task, however rows are split. The
last group of a small table may be less than full.

Defined results: a null or empty text has the end id only. Every row is a document of its
own, also with an equal or null id; other columns are left out. An empty table gives no
pieces. sequence_id is unique in a result, and may differ if rows are dealt to tasks
differently.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, reliable, sent, slices
from tallyline.llm.tokenizing import Encoder, packed

CAPACITY = 4096
GROUP = 1024
GROUP_TOKENS = 1_500_000
#: Sequences of what tasks leave over have numbers from here on.
_REST = 1 << 62
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """The window, of k, of each item, and the largest sum of a window."""
    if k == 1:
        return np.zeros(len(sizes), np.int64), sum(sizes)
    # A node has its windows' sums in descending order; merged ones know their two parts
    # and how positions in these map to their own.
    sums: list[np.ndarray] = []
    parts: list[tuple[int, int, np.ndarray, np.ndarray] | None] = []
    heap = []
    for i, size in enumerate(sizes):
        one = np.zeros(k, np.int64)
        one[0] = size
        sums.append(one)
        parts.append(None)
        heap.append((-size, i))
    heapq.heapify(heap)
    back = np.arange(k)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        together = sums[a] + sums[b][::-1]
        order = np.argsort(-together, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = back
        parts.append((a, b, place, place[::-1]))
        sums.append(together[order])
        sums[a] = sums[b] = back[:0]
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    window = np.empty(len(sizes), np.int64)
    stack = [(heap[0][1], back)]
    while stack:
        node, place = stack.pop()
        if (part := parts[node]) is None:
            window[node] = place[0]
        else:
            stack += [(part[0], place[part[2]]), (part[1], place[part[3]])]
    return window, int(sums[heap[0][1]][0])


def arranged(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start in it, length, window) of pieces, none of whose windows exceeds the capacity."""
    pieces = [(i, 0, size) for i, size in enumerate(sizes)]
    least = k = -(-sum(sizes) // capacity)
    while True:
        window, most = differencing([p[2] for p in pieces], k)
        if most <= capacity:
            return [(*p, int(w)) for p, w in zip(pieces, window, strict=True)]
        if k + 1 <= least + max(1, least // 50):
            k += 1
            continue
        long, k = max(p[2] for p in pieces) // 2, least
        cut = []
        for item, start, length in pieces:
            half = length // 2 if length > long else 0
            cut += [(item, start, half), (item, start + half, length - half)] if half else [(item, start, length)]
        pieces = cut


class _Packer:
    """Collects a task's documents and gives pieces whenever a group is full."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.items: list[tuple[object, int, bytes, int]] = []
        self.tokens = 0

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        many = len(ids) // 4
        whole = many - many % self.capacity
        for start in range(0, whole, self.capacity):
            yield doc, start, self.capacity, many, self.sequence, 0, ids[4 * start : 4 * (start + self.capacity)]
            self.sequence += 1
        if whole < many:
            self.items.append((doc, whole, ids[4 * whole :], many))
            self.tokens += many - whole
        if len(self.items) >= GROUP or self.tokens >= GROUP_TOKENS:
            yield from self.flush()

    def rest(self) -> Iterator[tuple]:
        """What is in no full group, without a sequence."""
        for doc, start, ids, many in self.items:
            yield doc, start, len(ids) // 4, many, None, None, ids
        self.items, self.tokens = [], 0

    def flush(self) -> Iterator[tuple]:
        if not self.items:
            return
        filled: dict[int, int] = {}
        for item, start, length, window in arranged([len(x[2]) // 4 for x in self.items], self.capacity):
            doc, before, ids, many = self.items[item]
            offset = filled.get(window, 0)
            filled[window] = offset + length
            yield doc, before + start, length, many, self.sequence + window, offset, ids[4 * start : 4 * (start + length)]
        self.sequence += max(filled) + 1
        self.items, self.tokens = [], 0


def pack(
    frame: DataFrame, tokenizer_file: str | Path, doc_id: str = "doc_id", text: str = "text", end: int | None = 2,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents.

    ``end`` is put after each document. ids are four bytes each, little-endian.
    """
    kind = frame.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    shared = frame.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    last = packed([end]) if end is not None else b""

    def told(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
        columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 36)
        id_type = None
        for batch in slices(batches, "text"):
            ids_of = batch.column("doc_id")
            id_type = ids_of.type
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pieces = []
            for doc, ids in zip(ids_of.to_pylist(), encoder.encode(texts), strict=True):
                pieces += packer.add(doc, ids + last)
            yield told(pieces, id_type)
        if id_type is not None:
            yield told(list(packer.rest()), id_type)

    def work_rest(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        packer = _Packer(capacity, _REST + (number << 32))
        ids_of = group.column("doc_id")
        columns = (ids_of, *(group.column(c) for c in ("start", "ids", "doc_tokens")))
        packer.items = list(zip(*(c.to_pylist() for c in columns), strict=True))
        return pa.Table.from_batches([told(list(packer.flush()), ids_of.type)])

    texts = sent(frame).select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    made = reliable(texts.mapInArrow(work, schema))
    rest = made.where("sequence_id IS NULL")
    many, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-many // GROUP), -(-tokens // GROUP_TOKENS))
    # Rows are dealt by what they are and where they stand, so that equal ones part.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "start"), F.lit(groups)).alias("group")
    placed = rest.select("*", dealt).groupBy("group").applyInArrow(work_rest, schema)
    return made.where("sequence_id IS NOT NULL").unionByName(placed)
