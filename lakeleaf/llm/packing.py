"""Sum-of-squares online packing of documents into training sequences (operator 3).

A task packs the documents of its input partition as they come. What is open is described by a level array: for each fill level the number of
sequences filled so far. A document goes to the level that makes the sum of the squared counts least, among the levels that have room and an empty
sequence. Whole sequences are cut off documents longer than a sequence first. At the end the open sequences are merged: those
least full are cut into the gaps of the fullest, so that one sequence at most stays short, and that one is split at powers of two, which need
no padding. The same is done with half of the open sequences whenever there are MOST_OPEN of them, as where all documents are longer than half a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kind
from .runtime import steps
from .word_tokens import word_encoder

#: Sequences of one partition: ids are partition * 2**IDS_BITS + number.
IDS_BITS = 36
#: Open sequences of a task at most.
MOST_OPEN = 2_048


class Packer:
    """Level array and open sequences of one task. Needs memory for MOST_OPEN open sequences of `size` ids.

    `put` and `finish` yield (sequence number, offset, key, start, ids, document's tokens)."""

    def __init__(self, size: int = 2048):
        if size < 2 or size & (size - 1):
            raise ValueError("the size of a sequence is a power of two")
        self.size, self.next = size, 0
        self.levels = np.zeros(size, np.int64)
        self.held = 0
        #: For each level its open sequences, each a list of (key, start, ids, document's tokens).
        self.open: list[list[list[tuple]]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The level that a document of n < size tokens goes to; 0 stands for an empty sequence, and ties go to the fullest."""
        room = self.size - n
        counts = self.levels[: room + 1]
        gain = 1 - 2 * counts
        gain[0] = 0
        gain[1:][counts[1:] == 0] = np.iinfo(np.int64).max // 2
        after = 2 * self.levels[n:] + 1
        gain[:room] += after[:room]  # a sequence that gets full leaves the array
        best = gain.min()
        return int(np.flatnonzero(gain == best)[-1])

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, ids, total in pieces:
            yield self.next, at, key, start, ids, total
            at += len(ids) // 4
        self.next += 1

    def put(self, key: object, ids: bytes, total: int) -> Iterator[tuple]:
        size, start, n = 4 * self.size, 0, len(ids)
        while n - start >= size:
            yield from self._emit([(key, start // 4, ids[start : start + size], total)])
            start += size
        left = (n - start) // 4
        if not left:
            return
        level = self.level_for(left)
        held = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
            self.held -= 1
        held.append((key, start // 4, ids[start:], total))
        if level + left == self.size:
            yield from self._emit(held)
        else:
            self._keep(level + left, held)
            if self.held >= MOST_OPEN:
                yield from self.finish(max(1, MOST_OPEN // 2))

    def _keep(self, level: int, pieces: list[tuple]) -> None:
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.held += 1

    def finish(self, keep: int = 0) -> Iterator[tuple]:
        """Close all open sequences but `keep`: the least full are cut into the gaps of the fullest."""
        held = [(level, pieces) for level in range(self.size) for pieces in self.open[level]]
        self.levels[:], self.held, self.open = 0, 0, [[] for _ in range(self.size)]
        low, high, spare = 0, len(held) - 1, []
        while high - low + 1 > keep:
            level, pieces = held[high]
            high -= 1
            gap = self.size - level
            while gap and (spare or low <= high):
                if not spare:
                    spare = held[low][1]
                    low += 1
                key, start, ids, total = spare.pop()
                n = len(ids) // 4
                if n > gap:
                    spare.append((key, start, ids[: 4 * (n - gap)], total))
                    start, ids, n = start + n - gap, ids[4 * (n - gap) :], gap
                pieces.append((key, start, ids, total))
                gap -= n
            if gap and keep:
                self._keep(self.size - gap, pieces)
            elif gap:
                yield from self._powers(pieces)
            else:
                yield from self._emit(pieces)
        if spare and not keep:
            yield from self._powers(spare)
        elif spare:
            self._keep(sum(len(x[2]) for x in spare) // 4, spare)
        for level, pieces in held[low : high + 1]:
            self._keep(level, pieces)

    def _powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Sequences of falling powers of two that hold the pieces in order."""
        left = sum(len(x[2]) for x in pieces) // 4
        rest = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                key, start, ids, total = rest.pop()
                n = min(room, len(ids) // 4)
                out.append((key, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((key, start + n, ids[4 * n :], total))
                room -= n
            yield from self._emit(out)


def pack(df: DataFrame, vocabulary_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (all bigint).

    A document is its text's ids and then end_id, so a null or empty text is one token. Every id lies in one piece; the pieces of a sequence are gapless from
    offset 0; a sequence has `size` tokens, or a power of two at the end of a partition. with_ids adds `ids` array<bigint>. Repeated rows are packed
    each. Without shuffle: a task packs its own partition, holds MOST_OPEN open sequences at most, and gives the same rows when it is run again."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(vocabulary_path), Packer(size)
        base = TaskContext.get().partitionId() << IDS_BITS

        def batch(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            number, offset, key, start, ids, total = zip(*found, strict=True)
            columns = [
                pa.array(key, kind),
                pa.array(start, pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array(total, pa.int64()),
                pa.array([base + x for x in number], pa.int64()),
                pa.array(offset, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

        kind = None
        for part, texts in steps(batches, "text"):
            kind = part.schema.field(0).type
            found: list[tuple] = []
            for key, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                found += packer.put(key, ids + end, len(ids) // 4 + 1)
            if found:
                yield batch(found, kind)
        if kind is not None and (found := list(packer.finish())):
            yield batch(found, kind)

    schema = f"id {_kind(df, id_col)}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
