"""Byte-level BPE by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never end up inside one
token, so the text may be cut between the two bytes before any merge is looked
for.  The fragments are encoded independently and their ids
concatenated.  The result is
the one of the plain merge loop, since a merge across a cut would make a token
that holds the pair.

The cuts are made in three steps, all before any merge.  No token holds a space
behind another character than
white space (checked when a vocabulary is loaded; byte 0xA0 is exempt, as it ends
the no-break space), and the pretokenizing pattern starts anew at a single space
between two characters that are not white space.  So whole
texts are cut there, before the pattern runs, and the units, mostly words, are
cached.  The pattern cuts new units into pretokens, and these are cut at every byte
pair that no token holds, whatever their length.  What is left between two cuts goes
to a merge loop piece by piece: that of a library where it takes the vocabulary's ids
for ranks, else our own over the merge table.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pretokenizing pattern of the byte-level format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries that a cache holds before it is emptied; bounds a worker's memory.
CACHE = 120_000
assert sys.byteorder == "little" and array("I").itemsize == 4


def printable_bytes() -> dict[str, int]:
    """Characters by which byte-level vocabulary files write bytes.

    Bytes with a visible Latin-1 character stand for themselves; the others take
    the code points from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    """Encoder and decoder over a `tokenizers` JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        model = spec["model"]
        self.vocab: dict[bytes, int] = {bytes(map(to_byte.__getitem__, t)): i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self._pair: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (self.vocab[bytes(map(to_byte.__getitem__, x))] for x in (left, right))
            self._pair[a << 20 | b] = (rank, self.vocab[bytes(map(to_byte.__getitem__, left + right))])
        self._byte = [self.vocab[bytes([b])] for b in range(256)]
        #: inner[a, b]: the pair occurs inside a token, so it is no forced boundary.
        self.inner = np.zeros((256, 256), dtype=bool)
        for token in self.vocab:
            for a, b in zip(token, token[1:]):
                self.inner[a, b] = True
        n = max([*self.vocab.values(), *self.added.values()]) + 1
        table = [b""] * n
        for token, i in self.vocab.items():
            table[i] = token
        for token, i in self.added.items():
            table[i] = token.encode()
        self._table = table
        self._core = self._library()
        self._spaced = not self.inner[[b for b in range(256) if b not in (0x20, 0xA0)], 32].any()
        self._split = regex.compile(PATTERN)
        self._wide = (re.compile(r" \s"), re.compile(r"\s "))
        self._cut = re.compile(r"(?<=\S) (?=\S)")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._encode = self._core._core_bpe.encode_single_piece if self._core else self.merge
        #: What follows a single space, up to the next -> its ids, the space's too; frequent units come back from the older generation.
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _library(self):
        """tiktoken's pattern and merge loop, if the ids are in merge order, as it takes them for ranks."""
        ids = [*sorted(self._byte), *(i for _, i in sorted(self._pair.values()))]
        if any(ids[k] >= ids[k + 1] for k in range(len(ids) - 1)):
            return None
        return tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=self.vocab, special_tokens={})

    def merge(self, part: bytes) -> list[int]:
        """One fragment's ids by the merge table: the least merge first, the leftmost of equal ones; a heap over a linked list, in n log n."""
        pair, ids = self._pair, [self._byte[b] for b in part]
        n = len(ids)
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := pair.get(ids[k] << 20 | ids[k + 1])) is not None]
        if not heap:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = merged, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (found := pair.get(merged << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (found[0], k, merged, ids[after[k]], found[1]))
            if (p := before[k]) >= 0 and (found := pair.get(ids[p] << 20 | merged)) is not None:
                heapq.heappush(heap, (found[0], p, ids[p], merged, found[1]))
        return [i for i in ids if i >= 0]

    def _cuts(self, pretokens: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The pretokens' bytes, and where to cut them: between pretokens and at forced boundaries; both ends are among these."""
        data = b"".join(pretokens)
        b = np.frombuffer(data, np.uint8)
        at = ~self.inner.ravel()[(b[:-1].astype(np.uint16) << np.uint16(8)) | b[1:]]
        ends = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        at[ends[:-1] - 1] = True
        return data, np.concatenate([[0], np.nonzero(at)[0] + 1, ends[-1:]])

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units that stand behind each other, the space of each but the first in front of it, as little-endian uint32 bytes.

        White space at an end is allowed in front of the first and behind the last.
        """
        if not (text := "".join(units)):
            return [b""] * len(units)
        data, cuts = self._cuts([p.encode() for p in self._split.findall(text)])
        places = cuts.tolist()
        ids = [self._encode(data[a:b]) for a, b in zip(places, places[1:])]
        raw = array("I", chain.from_iterable(ids)).tobytes()
        many = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        to = (4 * many[np.searchsorted(cuts, ends)]).tolist()
        return [raw[a:b] for a, b in zip([0, *to], to)]

    def cuts(self, text: str) -> dict[str, int]:
        """How many cuts of each kind a text gets: at single spaces, by the pattern elsewhere, and at byte pairs inside pretokens."""
        units = self.units(text)
        pretokens = [p.encode() for k, unit in enumerate(units) for p in self._split.findall(" " + unit if k else unit)]
        spaces, pieces = len(units) - 1, len(self._cuts(pretokens)[1]) - 1 if pretokens else 0
        return {"space": spaces, "pretoken": len(pretokens) - 1 - spaces, "pair": pieces - len(pretokens)}

    def units(self, text: str) -> list[str]:
        """The text cut at forced boundaries before single spaces; the first piece, then what follows each space."""
        if not self._spaced:
            return [text]
        if text[:1] == " " or text[-1:] == " " or any(p.search(text) for p in self._wide):
            return self._cut.split(text)
        return text.split(" ")

    def _plain(self, text: str) -> list[bytes]:
        first, *rest = self.units(text)
        cache, older = self._cache, self._older
        new: dict[str, bytes | None] = {u: older.get(u) for u in rest if u not in cache}
        todo = [u for u, found in new.items() if found is None]
        # a unit with white space at its end is the text's last and so the last here
        head, *made = self._encode_units([first, *(" " + u for u in todo)])
        if not new:
            return [head, *map(cache.__getitem__, rest)]
        new.update(zip(todo, made))
        out = [head, *(cache[u] if u in cache else new[u] for u in rest)]
        cache.update((u, found) for u, found in new.items() if len(u) <= 64)
        if len(cache) >= CACHE:
            self._older, self._cache = cache, {}
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as uint32; none for an empty or null text.  Strings of added tokens become their ids."""
        if not text:
            return np.zeros(0, "<u4")
        if self._special is None or not self._special.search(text):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        parts: list[bytes] = []
        for k, piece in enumerate(self._special.split(text)):
            if k % 2:
                parts.append(np.array([self.added[piece]], "<u4").tobytes())
            elif piece:
                parts += self._plain(piece)
        return np.frombuffer(b"".join(parts), "<u4")

    def encode_whole(self, text: str | None) -> np.ndarray:
        """The same ids, without cuts or caches of our own: the library's loop over whole texts, where it takes the ids for ranks."""
        if not text or self._core is None:
            return self.encode(text)
        if self._special is None or not self._special.search(text):
            return self._core.encode_to_numpy(text)
        return np.concatenate([np.array([self.added[p]], "<u4") if k % 2 else self._core.encode_to_numpy(p) for k, p in enumerate(self._special.split(text))])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self._table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of the tokens, added ones included; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file and process."""
    return ForcedBoundaryBPE(path)


def vocabulary() -> str:
    """Default place of the vocabulary, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of the text's token ids; a null or empty text has none; a column of that name is replaced."""
    at = path or vocabulary()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        bpe = load(at)
        return texts.map(lambda x: bpe.encode(x).view("<i4"))

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids; null ids give an empty text; a column of that name is replaced."""
    at = path or vocabulary()

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        bpe = load(at)
        return column.map(lambda x: bpe.decode([] if x is None else list(x)))

    return docs.withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and its ids decoded again, in one pass; only digests of both leave the worker.

    Rows: doc_id (as it is, null too), n_tokens, ids_sha256, decoded_sha256.  A
    null text counts as empty; repeated rows give repeated rows.
    """
    at = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(at)
        decimal = list(map(str, range(len(bpe._table))))
        for batch in batches:
            n, written, read = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py()).tolist()
                n.append(len(ids))
                written.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                read.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(read, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
