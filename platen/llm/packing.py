"""Bounded-space online best-fit packing of tokenised documents into sequences.

Each task packs the documents it reads: a fixed number of bins is open at a time, kept by free space with a bitset over
the free spaces in use. A piece goes to the fullest bin that takes it; when too many are open, the fullest one closes. The
pieces of a bin leave the task when it closes, so a task holds as many ids as its open bins take, 8 MB.

The pieces that MERGED tasks leave in open bins at their ends are packed once more by one task, as a stream from the
longest on. Only these pieces are shuffled; all others stay where they were read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import cut, slices, table
from platen.llm.tokens import tokenizer_memory

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0
#: sequence_id = task * TASK_SPAN + number within the task.
TASK_SPAN = 1 << 40
#: Tasks whose last pieces are packed together, and the first sequence_id of those: LATER + group of tasks * TASK_SPAN + number.
MERGED = 16
LATER = 1 << 62


class OpenBins:
    """At most `most` open bins; place(length) gives (bin number, offset). closed: numbers of bins that take no more."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used, self.open, self.made = 0, 0, 0  # used: bit f is set while a bin has f free
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.used &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.used >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.most:
                self.closed.append(self._take((self.used & -self.used).bit_length() - 1))
            self.by_free[left].append(number)
            self.used |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.capacity - free


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: whole capacities from the end, so only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])
_KINDS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary, open boolean"


def packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, most: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the pieces of each bin as it closes; at the end those of the bins left open."""
    memory, bins = tokenizer_memory(path), OpenBins(capacity, most)
    base = TaskContext.get().partitionId() * TASK_SPAN
    end = END_ID.to_bytes(4, "little")
    waiting: dict[int, list[tuple]] = {}

    def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for b in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[b : b + 4096], strict=True), PIECES, strict=True)], schema=PIECES)

    for batch in slices(batches):
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = memory.ids_of(text or "") + end
            for k, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                number, offset = bins.place(length)
                waiting.setdefault(number, []).append((doc_id, k, start, length, zlib.crc32(own), base + number, offset, own if with_ids else None))
                for shut in bins.closed:
                    rows += [(*r, False) for r in waiting.pop(shut)]
                bins.closed.clear()
            if len(rows) >= 4096:
                yield from batch_of(rows)
                rows = []
        yield from batch_of(rows)
    yield from batch_of([(*r, True) for left in waiting.values() for r in left])


def packed_again(batches: Iterator[pa.RecordBatch], capacity: int, most: int, span: int) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by groups of tasks, the longest of each first -> the same with their new places."""
    group, bins = None, OpenBins(capacity, most)
    at, length_at, offset_at = (PIECES.get_field_index(c) for c in ("sequence_id", "length", "offset"))
    for b in batches:
        sequences, offsets = [], []
        for sequence, length in zip(b.column(at).to_pylist(), b.column(length_at).to_pylist(), strict=True):
            if sequence // span != group:
                group, bins = sequence // span, OpenBins(capacity, most)
            number, offset = bins.place(length)
            bins.closed.clear()
            sequences.append(LATER + group * TASK_SPAN + number)
            offsets.append(offset)
        columns = list(b.columns)
        columns[at], columns[offset_at] = pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())
        yield pa.RecordBatch.from_arrays(columns, schema=b.schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids (little-endian unsigned 32-bit).

    A null or empty text is one piece of the end id alone. Repeated rows and null ids are packed as
    they come. A text longer than a sequence is cut; no other is. An empty table gives no row. Other columns
    are not read. path: a tokenizer file that every executor has. The pieces are checkpointed before the last ones are packed again, so that
    both parts of the result come from one packing, whatever executors are lost.
    """
    read = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    first = cut(read.mapInArrow(lambda batches: packed(batches, path, capacity, open_bins, with_ids), _KINDS))
    span = TASK_SPAN * MERGED
    last = first.where("open").repartition(F.expr(f"sequence_id div {span}")).sortWithinPartitions(F.expr(f"sequence_id div {span}"), F.desc("length"), "sequence_id", "offset")
    most = open_bins * MERGED  # numbers alone; as short pieces come last, no bin need close before them
    again = last.mapInArrow(lambda batches: packed_again(batches, capacity, most, span), _KINDS)
    return first.where("not open").unionByName(again).drop("open")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")
