"""Packing token sequences: bounded-space online best fit.

Pieces arrive one by one.  Each goes into the open bin that it fills best, the
one with the least free space that still holds it; if none does, a new bin opens.
At most `open_bins` are open at a time: when another must open, the fullest
closes for good.  The open bins stand in a bitset keyed by free space, so the best
bin is the lowest set bit from the piece's length on, and the fullest the lowest
bit of all.

Spark's part: tokenizing is a narrow pass whose rows hold no texts; these small
rows are dealt by a hash of (doc_id, piece), ordered by the same hash, and every
packer streams its share with a state of `open_bins` numbers.  Both the dealing
and the order follow from the rows alone, so a lost task gives the same bins when
it runs again.  A packer gets what `fan_in` partitions have tokenized, since each
one leaves some bins half full at its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm import bpe
from arcwell.llm.common import with_fields, without

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit over `capacity` with at most `open_bins` open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to capacity tokens."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit {self.capacity}")
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.count += 1
        return at, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a first one that takes the rest."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0) -> DataFrame:
    """Pieces of all documents' ids, each document followed by `end`; a null text is empty and gives that id alone."""
    at = path or bpe.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(at)
        tail = np.array([end], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.encode_whole(text.as_py()), tail])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(parts: DataFrame, capacity: int = 2048, open_bins: int = 4096, fan_in: int = 12) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset.

    Full pieces make sequences of their own.  Repeated rows are placed each by
    itself.  Sequence ids are unique, not gapless: the packer's number in the upper bits.
    Columns named like the two that are added are replaced.
    """
    parts = without(parts, "sequence_id", "offset")
    names = parts.columns
    packers = max(1, parts.rdd.getNumPartitions() // fan_in)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for rows in batches:
            placed = [bins.place(n) for n in rows["length"].tolist()]
            yield rows[names].assign(sequence_id=np.array([base + b for b, _ in placed], "int64"), offset=np.array([o for _, o in placed], "int64"))

    mixed = F.xxhash64("doc_id", "piece")
    dealt = parts.withColumn("__aw_mix", mixed).repartition(packers, "__aw_mix").sortWithinPartitions("__aw_mix", "doc_id", "piece", "ids_crc32")
    return dealt.mapInPandas(run, with_fields(parts, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, open_bins: int = 4096) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: PIECES with sequence_id and offset.

    A null doc_id is packed like any other and comes back null.
    """
    return pack(pieces(docs, capacity, path), capacity, open_bins)
