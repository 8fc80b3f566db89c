"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share long bit patterns.
Groups of `fan_out` consecutive fingerprints become a node that holds the bits on
which the whole group agrees (a value under a mask), groups of nodes a node above,
and so on.  A search goes down from the top and adds up, level by level, the
differing bits among those that a node fixes beyond its parent; once the sum
passes the radius, the whole group below is left out.

To spread the search over tasks without sending any fingerprint everywhere, the
64 bits are cut into radius + 1 blocks.  Two fingerprints at most `radius` bits
apart agree on a block, so each fingerprint goes to the task of each of its blocks'
values, and that block is the top node of the index there.  A block value that more
than `most` fingerprints share is divided again: the bits outside it are cut into
radius + 1 parts, of which two near ones agree on one too.  Only different
fingerprints take part: copies are reduced before the shuffle.

A task joins its index with itself and returns no pairs but, for each fingerprint,
one link to the smallest of its connected ones: their number is bounded by the
fingerprints, whatever the pairs.  As links are found, groups that lie in one
component already are left out of later searches from that component.  Components
over all tasks come from the star algorithm in arcwell.llm.graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import kept
from arcwell.llm.graph import components

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over the hashes of all word shingles, repeats included.

    A-Z in lower case, words between the six ASCII white-space characters; a text
    of fewer words is one shingle, one of none has fingerprint 0.  A bit is set if
    it is set in over half the XXH64 hashes (seed 42).
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    first, last = starts[: len(last)].tolist(), last.tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(last), _CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """Hierarchical index over different 64-bit codes whose first `top` bits are one node each."""

    def __init__(self, codes: np.ndarray, top: int = 16, fan_out: int = 8):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        self.codes = codes
        head = codes >> np.uint64(64 - top) if top else np.zeros(len(codes), np.uint64)
        run = np.concatenate([[0], np.cumsum(head[1:] != head[:-1])]) if len(codes) else np.zeros(0, np.int64)
        #: levels, leaves first: value and mask of each node, first child of each in the level below
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        both, either = codes, codes
        while True:
            first_of_run = np.searchsorted(run, np.arange(run[-1] + 1 if len(run) else 0))
            place = np.arange(len(run)) - first_of_run[run]
            starts = np.nonzero(place % fan_out == 0)[0]
            both, either = (f.reduceat(x, starts) if len(starts) else x for f, x in ((np.bitwise_and, both), (np.bitwise_or, either)))
            mask = ~(both ^ either)
            self.levels.append((both & mask, mask, starts))
            run = run[starts]
            if not len(run) or run[-1] + 1 == len(run):
                break
        self.root = np.repeat(np.arange(len(run)), np.diff(np.append(self._leaf_starts(len(self.levels) - 1), len(codes))))

    def _leaf_starts(self, level: int) -> np.ndarray:
        """First leaf below each node of a level."""
        at = self.levels[level][2]
        for k in range(level - 1, -1, -1):
            at = self.levels[k][2][at]
        return at

    def _below(self, q, node, d, parent_mask, level, radius, of):
        """(query, node, differences) of the children within the radius; level -1 are the codes."""
        starts = self.levels[level + 1][2]
        ends = np.append(starts[1:], len(self.levels[level][0]) if level >= 0 else len(self.codes))
        n = ends[node] - starts[node]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        child, q, d, above = np.repeat(starts[node], n) + pos, np.repeat(q, n), np.repeat(d, n), np.repeat(parent_mask, n)
        value, mask = (self.levels[level][0][child], self.levels[level][1][child]) if level >= 0 else (self.codes[child], np.full(len(child), _FULL))
        d = d + np.bitwise_count((of[q] ^ value) & mask & ~above)
        ok = d <= radius
        return q[ok], child[ok], d[ok], mask[ok]

    def pairs(self, queries: np.ndarray, radius: int, comp: np.ndarray | None = None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query, code) positions within the radius, each pair once, for queries given as positions.

        With comp, nodes that lie in the query's component altogether are left out.
        """
        level = len(self.levels) - 1
        root = self.root[queries]
        value, mask = self.levels[level][0][root], self.levels[level][1][root]
        stack = [(level, queries, root, np.bitwise_count((self.codes[queries] ^ value) & mask).astype(np.int64), mask)]
        spans = []
        if comp is not None:
            for k in range(len(self.levels)):
                at = self._leaf_starts(k)
                spans.append((np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)))
        while stack:
            level, q, node, d, mask = stack.pop()
            if comp is not None and level >= 0:
                low, high = spans[level]
                ok = (low[node] != high[node]) | (low[node] != comp[q])
                q, node, d, mask = q[ok], node[ok], d[ok], mask[ok]
            if not len(q):
                continue
            if len(q) * 8 > most and len(q) > 1:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], d[:half], mask[:half]), (level, q[half:], node[half:], d[half:], mask[half:])]
                continue
            q, node, d, mask = self._below(q, node, d, mask, level - 1, radius, self.codes)
            if level:
                stack.append((level - 1, q, node, d, mask))
            else:
                ok = q < node
                if ok.any():
                    yield q[ok], node[ok]

    def links(self, radius: int, step: int = 1 << 14, comp: np.ndarray | None = None, agree: Callable | None = None) -> np.ndarray:
        """For each code the position of the smallest one that it reaches over pairs within the radius.

        comp joins codes beforehand; agree(a, b) may refuse pairs.  The first steps are
        short, so that a large group is one component before most of it is searched.
        """
        comp = np.arange(len(self.codes)) if comp is None else comp
        at, size = 0, min(step, 256)
        while at < len(comp):
            for a, b in self.pairs(np.arange(at, min(at + size, len(comp))), radius, comp.copy()):
                if agree is not None:
                    ok = agree(a, b)
                    a, b = a[ok], b[ok]
                comp = _unite(comp, a, b)
            at, size = at + size, min(2 * size, step)
        return comp


def _unite(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest position of its component, after joining a and b."""
    while True:
        x, y = comp[a], comp[b]
        differ = x != y
        if not differ.any():
            return comp
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        parent = np.arange(len(comp))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        comp = parent[comp]


def _parts(mask: int, n: int) -> list[int]:
    """The bits outside a mask in n parts, each with the mask's own bits."""
    rest = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(rest) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:])]


def arranged(codes: np.ndarray, mask: int) -> np.ndarray:
    """The codes with the mask's bits in front."""
    places = sorted(range(64), key=lambda b: (not mask >> b & 1, -b))
    out = np.zeros_like(codes)
    for k, b in enumerate(places):
        out |= (codes >> np.uint64(b) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(different: DataFrame, radius: int = 3, most: int = 1 << 18) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp, each once) that give the components of all pairs within the radius.

    Groups of over `most` fingerprints that agree under a mask are cut by longer masks,
    until none is left; that changes no component.  Under a mask that leaves `radius`
    bits free there are 2 to the power of `radius` fingerprints at most.
    """
    most = max(most, 1 << radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not held:
            return
        fps, masks = (np.concatenate(x) for x in zip(*held))
        for signed in np.unique(masks).tolist():
            mask = signed % (1 << 64)
            own = fps[masks == signed]
            index = GrayIndex(arranged(own.view(np.uint64), mask), mask.bit_count())
            comp, own = index.links(radius), own[index.order]
            linked = np.nonzero(comp != np.arange(len(comp)))[0]
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[comp[linked]])], ["u", "v"])

    wide = F.array(*[F.lit(_signed(m)) for m in _parts(0, radius + 1)])
    rows, edges = different.select("fp", F.explode(wide).alias("mask")), None
    while True:
        keyed = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = kept(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "value"), "hot")
        masks = [r[0] for r in hot.select("mask").distinct().collect()]
        cold = keyed.join(hot, ["mask", "value"], "left_anti") if masks else keyed
        found = cold.repartition("mask", "value").select("fp", "mask").mapInArrow(run, "u long, v long")
        edges = found if edges is None else edges.union(found)
        if not masks:
            return edges
        longer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(p)) for p in _parts(m % (1 << 64), radius + 1)]))])
        # the same longer mask is reached in several ways
        rows = kept(keyed.join(hot, ["mask", "value"], "left_semi").select("fp", F.explode(longer[F.col("mask")]).alias("mask")).distinct(), "divided")


def near_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that it reaches over links of at most radius bits.

    Empty and null texts have fingerprint 0, which links like any other.  Repeated
    rows stay.  A null doc_id takes part, but is no component's id unless it has no other.
    """
    fps = kept(fingerprints(docs, words), "fingerprints")
    different = kept(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    reach = components(links(different.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = different.join(reach, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest.

    Rows with one doc_id are one document and stay or go together; rows without a
    doc_id stay.
    """
    found = near_components(docs.select("doc_id", "text"), words, radius)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__aw_stay")).distinct()
    met = docs.join(stay, F.col("doc_id").cast("long") == F.col("__aw_stay"), "left")
    return met.where(F.col("__aw_stay").isNotNull() | F.col("doc_id").isNull()).drop("__aw_stay")
