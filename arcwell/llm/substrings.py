"""Substring deduplication by content-defined chunks of a gear rolling hash.

The gear hash of a position sums a fixed random number for each of the last bytes,
doubled once for each byte since, so it depends on the last 16 bytes only.  A text is
divided into units: words, and in stretches of over `stretch` bytes without white
space (Chinese, Japanese, Thai, code, base64) pieces between those character
boundaries whose hash is the least among the boundaries of any `piece` bytes.  Of the
ends of units a cut is each whose hash is the least of any `window` consecutive ones.
So the cuts in a passage are the same wherever it stands, an insertion shifts none
behind it, and where no two hashes tie each `window` ends hold a cut, however short
the words: from the first to the last common cut lie at least 4 * window - 3 words,
and those of 16 bytes, less than the passage has.  Longer stretches without a cut (of
one repeated character) are divided at `longest` bytes, between characters.

Two chunks next to each other that several documents hold belong to the smallest
doc_id.  Other documents lose both where they are part of an unbroken run of such
chunks with at least `least_words` words: so a passage that repeats goes from all
documents but one, while chance repeats of a few words stay everywhere.  A word of a
stretch counts as one for each 8 bytes.  Pairs of chunks stay whole in their owner,
so nothing vanishes from the corpus.

Each document sends the different digests of its pairs (64 bits; a false match alone
removes nothing, as a run needs several) with its doc_id.  They are reduced
to owners before the shuffle; the join back is a sort-merge join whose hot
partitions adaptive execution splits, the side of the owners having each digest
once.  Texts move once, to meet the digests they lost, and are chunked anew there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import numbered, with_fields, without

#: Random number of each byte value; only 16 bits of the sums are used.
GEAR = np.random.default_rng(2024).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Chunking:
    """window in units, the others in bytes."""

    window: int = 7
    stretch: int = 24
    piece: int = 16
    longest: int = 256


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash (mod 2**16) at each byte over the bytes up to it, by doubling the span four times."""
    h = GEAR[data]
    for span in (1, 2, 4, 8):
        shifted = h[:-span] << np.uint16(span)
        h = h.copy()
        h[span:] += shifted
    return h


def least_of_window(values: np.ndarray, window: int) -> np.ndarray:
    """Whether a value is less than all others of some `window` consecutive ones."""
    reach = np.zeros(len(values), np.int64)
    for before in (True, False):
        ok = np.ones(len(values), bool)
        for d in range(1, window):
            less = np.zeros(len(values), bool)
            if before:
                less[d:] = values[d:] < values[:-d]
            else:
                less[:-d] = values[:-d] < values[d:]
            ok &= less
            reach += ok
    return reach >= window - 1


def unit_ends(data: np.ndarray, hashes: np.ndarray, how: Chunking) -> np.ndarray:
    """Ends of all units but the last, a word's behind its white space."""
    space = _SPACE[data]
    at = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    place = np.arange(len(data))
    run = place - np.maximum.accumulate(np.where(space, place, -1))
    if run.max() <= how.stretch:
        return at
    # a boundary far enough from white space, and before none
    inside = np.nonzero((run[:-1] >= how.stretch) & ~space[1:] & (data[1:] & 0xC0 != 0x80))[0] + 1
    ranks = np.full(len(data) + 1, 1 << 16, np.int64)
    ranks[inside] = hashes[inside - 1]
    return np.union1d(at, inside[least_of_window(ranks, how.piece)[inside]])


def cuts(raw: bytes, how: Chunking) -> np.ndarray:
    """Ends of all chunks; the last is the end of the data."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    hashes = gear_hashes(data)
    at = unit_ends(data, hashes, how)
    at = at[least_of_window(hashes[at - 1], how.window)]
    ends = np.append(at, n)
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= how.longest:
        return ends
    more = []
    for end, size in zip(ends[sizes > how.longest].tolist(), sizes[sizes > how.longest].tolist()):
        start = end - size
        while end - start > how.longest:
            start += how.longest
            while raw[start] & 0xC0 == 0x80:
                start -= 1
            more.append(start)
    return np.sort(np.concatenate([ends, more]))


def chunks(text: str | None, how: Chunking) -> tuple[bytes, list[int], list[int]]:
    """The text in UTF-8, the ends of its chunks and their digests as signed longs."""
    raw = (text or "").encode()
    ends = cuts(raw, how).tolist()
    digest = xxhash.xxh3_64_digest
    own = b"".join([digest(raw[a:b]) for a, b in zip([0, *ends], ends)])
    return raw, ends, np.frombuffer(own, "<i8").tolist()


def pair_digests(digests: list[int]) -> list[int]:
    """A digest for each two chunks next to each other; a chunk alone is its own."""
    own = np.array(digests, np.int64).view(np.uint64)
    if len(own) < 2:
        return digests
    mixed = (own[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (own[:-1] >> np.uint64(29))
    return ((mixed + own[1:]) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).tolist()


def chunk_digests(docs: DataFrame, how: Chunking) -> DataFrame:
    """(doc_id, digest) of the different pairs of chunks of each row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, n = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for text in batch.column(1):
                own = sorted(set(pair_digests(chunks(text.as_py(), how)[2])))
                found += own
                n.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(found, pa.int64())], ["doc_id", "digest"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, digest long")


def count_words(raw: bytes, how: Chunking) -> int:
    """Words, of those without white space for over `stretch` bytes one for each 8 bytes."""
    return sum(1 if len(w) <= how.stretch else len(w) // 8 for w in raw.split())


def lost_spans(raw: bytes, ends: list[int], digests: list[int], lost: set[int], least_words: int, how: Chunking) -> list[tuple[int, int]]:
    """Byte spans of the runs of chunks in lost pairs with least_words words or more."""
    found = [d in lost for d in pair_digests(digests)]
    gone = [a or b for a, b in zip([False, *found], [*found, False])] if len(ends) > 1 else found
    spans, start, at = [], None, 0
    for end, out in [*zip(ends, gone), (len(raw), False)]:
        if out:
            start = at if start is None else start
        elif start is not None:
            if count_words(raw[start:at], how) >= least_words:
                spans.append((start, at))
            start = None
        at = end
    return spans


def dedup_substrings(docs: DataFrame, least_words: int = 16, how: Chunking | None = None) -> DataFrame:
    """docs with kept_text, spans (start and end in bytes of what went), and n_lost_words.

    Rows with one doc_id count as one document, and what repeats within a document
    stays.  Rows whose doc_id is null neither own nor lose.  Null texts come back
    as empty ones.  Columns of docs named like the three that are added are replaced.
    """
    how = how or Chunking()
    docs = without(docs, "kept_text", "spans", "n_lost_words")
    found = chunk_digests(docs, how)
    owners = found.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("digest", "owner")
    lost = found.join(owners, "digest").where("doc_id > owner").groupBy("doc_id").agg(F.collect_list("digest").alias("__aw_lost")).withColumnRenamed("doc_id", "__aw_id")
    names = docs.columns
    met = docs.join(lost, F.col("doc_id").cast("long") == F.col("__aw_id"), "left").select(*numbered(names), "__aw_lost")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone, words = [], [], []
            for text, lost in zip(batch.column(at), batch.column(len(names))):
                text = text.as_py() or ""
                spans: list[tuple[int, int]] = []
                if lost.is_valid:
                    raw, ends, digests = chunks(text, how)
                    spans = lost_spans(raw, ends, digests, set(lost.values.to_pylist()), least_words, how)
                    if spans:
                        stay = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)])
                        text = b"".join(raw[a:b] for a, b in stay).decode()
                kept.append(text)
                gone.append([{"start": a, "end": b} for a, b in spans])
                words.append(sum(len(raw[a:b].split()) for a, b in spans))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.string()), pa.array(gone, span), pa.array(words, pa.int64())], [*names, "kept_text", "spans", "n_lost_words"])

    return met.mapInArrow(run, with_fields(docs, "kept_text string, spans array<struct<start:bigint,end:bigint>>, n_lost_words long"))
