"""Packing documents into token windows by multiway differencing.

A document's tokens are cut into full windows and a rest. Rests are gathered
into blocks as they come; those of a block's first half stay whole, later ones
lose an eighth at one cut, as small pieces level what whole rests leave uneven.
Each block is spread over windows by the Karmarkar-Karp method for many parts: every piece starts as a partition of its
own; the two partitions with the largest imbalance are merged, the fullest parts
of one with the emptiest of the other, until one is left. If its fullest window
exceeds the capacity, the number of windows rises and the block is spread again.

A block never leaves its task, so packing shuffles nothing, has no key that
could be skewed, and a lost task repeats the same windows from the same input.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .tokenise import groups, tokeniser

CAPACITY = 1024
#: Windows of a block, and the tokens of each that a block leaves free for the imbalance.
WINDOWS, SLACK = 128, 8
#: Of a block's tokens this share, the last one, is of rests that are cut once, at this part of them; shorter ones stay whole.
CUT_SHARE, CUT_PART, CUT_LEAST = 0.5, 8, 64


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of sizes over so many parts: the members of each part, by index.

    Ties go to the partition made first, so reruns agree. Parts may be empty.
    """
    # A partial partition: (sum above its least, members as nested pairs) of its
    # parts by falling sum; parts without members aren't listed.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - parts
        if both <= 0:
            merged = sorted(a + b, key=_falling)
        else:
            alone_a, alone_b = len(a) - both, len(b) - both
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone_a:], reversed(b[alone_b:]))]
            merged = sorted(a[:alone_a] + met + b[:alone_b], key=_falling)
            if least := merged[-1][0]:
                merged = [(s - least, m) for s, m in merged]
        heapq.heappush(heap, (-merged[0][0], made, merged))
        made += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        members, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                members.append(x)
        out.append(sorted(members))
    return out + [[] for _ in range(parts - len(out))]


def _falling(part: tuple) -> int:
    return -part[0]


def spread(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of near-equal size, none above the capacity: as few as hold all, and more while one is too full."""
    parts = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, parts)
        if max((sum(sizes[i] for i in w) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        parts += 1


class Packer:
    """Takes documents' tokens, gives rows of pieces: (document, start, ids, window, offset)."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS, slack: int = SLACK, cut_share: float = CUT_SHARE):
        self.capacity, self.full = capacity, windows * (capacity - min(slack, capacity - 1))
        self.whole = self.full * (1 - cut_share)
        self.held: list[tuple] = []
        self.tokens = self.windows = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield doc, at, ids[at : at + self.capacity], self.windows, 0
            self.windows += 1
        rest = len(ids) - whole
        if not rest:
            return
        if self.held and self.tokens + rest > self.full:
            yield from self.flush()
        cut = rest // CUT_PART if rest >= CUT_LEAST and self.tokens >= self.whole else 0
        for begin, end in ((whole, whole + cut), (whole + cut, len(ids))):
            if begin < end:
                self.held.append((doc, begin, ids[begin:end]))
        self.tokens += rest

    def flush(self) -> Iterator[tuple]:
        for window in spread([len(x[2]) for x in self.held], self.capacity):
            offset = 0
            for i in window:
                doc, at, ids = self.held[i]
                yield doc, at, ids, self.windows, offset
                offset += len(ids)
            self.windows += 1
        self.held, self.tokens = [], 0


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in windows of at most `capacity` tokens.

    A document is its text's ids by the vocabulary file, then end_id; null counts
    as empty, so every row has one token at least. Repeated rows are packed each.
    Further columns are ignored, whatever their names.

    Rows: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id, offset, and with with_ids the ids.
    A sequence_id holds the task's number in its upper bits.
    """
    out = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer = Packer(capacity)
        coder = tokeniser(vocabulary)

        def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([r[0][0] for r in rows], id_type)]
            columns += [pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2]) for r in rows], [r[0][1] for r in rows], [first + r[3] for r in rows], [r[4] for r in rows])]
            if with_ids:
                columns.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, out.names)

        id_type = None
        for got in batches:
            id_type, rows = got.schema.field(0).type, []
            docs_ids, texts = got.column(0).to_pylist(), [x or "" for x in got.column(1).to_pylist()]
            for part in groups(texts):
                ids, counts = coder.encode(texts[part])
                ends = np.cumsum(counts)
                # Each document's ids with the end id after them.
                at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)
                closed = np.full(len(ids) + len(counts), end_id, "<u4")
                closed[at] = ids
                begin = 0
                for doc, end in zip(docs_ids[part], (ends + np.arange(1, len(counts) + 1)).tolist()):
                    rows += packer.add((doc, end - begin), closed[begin:end])
                    begin = end
                if len(rows) > 5000:
                    yield batch(rows, id_type)
                    rows = []
            if rows:
                yield batch(rows, id_type)
        if packer.held:
            yield batch(list(packer.flush()), id_type)

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, out)
