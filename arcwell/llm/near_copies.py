"""Operator 6 at a similarity of word shingles: its Gray-order index finds candidates, shingle sets decide.

A text's shingles are the different runs of `words` words.  Two texts of Jaccard
similarity 0.8 differ in about 10 of 64 SimHash bits, too many for blocks that must
hold a whole pair's agreement.  So a text has `seeds` fingerprints, each from another
mixing of the same shingle hashes, and each of their blocks of 16 bits is the top
node of an index, as in arcwell.llm.simhash.  Below it a pair is pruned once its
accumulated differences pass `radius`, or if the text's next fingerprint differs in
more than `second` bits.  At similarity 0.8 a bit differs with probability 0.15, so
one of 48 blocks shows the pair with probability 0.97 at least, more where changes
are spread over the text, as the fingerprints are taken over runs of two words,
of which a changed word touches only two.

A search has two rounds.  The first uses one fingerprint and joins most of a large
group; the second uses the others and leaves out pairs that are in one component
already, and so whole groups before their sets move.  A task returns the texts of
its candidate groups, no pairs; equal groups of several blocks are one.  The sets of
a group meet in one task, which compares exactly and returns a forest.  Groups of
over `most` texts are dealt in parts, every two of which meet.  Components over all
tasks come from the star algorithm in arcwell.llm.graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.llm.common import kept
from arcwell.llm.graph import components
from arcwell.llm.simhash import GrayIndex, arranged

#: Byte value -> its bits, highest first, as bytes of one number: sums of up to 255 need no carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


@dataclass(frozen=True)
class Search:
    """Fingerprints, their blocks, and how far a candidate's may differ."""

    seeds: int = 12
    sketch_words: int = 2
    block: int = 16
    radius: int = 13
    second: int = 18
    most: int = 4096


def hashed(text: str | None, words: int) -> np.ndarray:
    """The different XXH64 hashes of all word shingles in order; words as in simhash.fingerprint, a text of fewer is one shingle."""
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def sketch(hashes: np.ndarray, seeds: int) -> np.ndarray:
    """A fingerprint for each seed: a bit is set if it is in over half of the mixed hashes."""
    times = np.random.default_rng(2025).integers(0, 1 << 64, seeds, dtype=np.uint64) | np.uint64(1)
    ones = np.zeros(seeds * 64, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] * times
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += _SPREAD[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def forest(sets: list[np.ndarray], percent: int = 80, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between places of sets that, with those of equal labels, give the components of all pairs with a Jaccard similarity of percent or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    comp = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    own = np.zeros(ids.max() + 1, bool)
    edges = []
    for k in range(n - 1):
        later = k + 1 + np.nonzero(comp[k + 1 :] != comp[k])[0]
        small, large = np.minimum(sizes[later], sizes[k]), np.maximum(sizes[later], sizes[k])
        later = later[100 * small >= percent * large]
        if not len(later):
            continue
        mine = ids[starts[k] : starts[k] + sizes[k]]
        own[mine] = True
        if len(later) * 8 > n - k:
            # most of them: one pass over all that stand behind
            both = np.add.reduceat(own[ids[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1], dtype=np.int64)[later - k - 1]
        else:
            both = np.array([np.count_nonzero(own[ids[starts[j] : starts[j] + sizes[j]]]) for j in later.tolist()])
        own[mine] = False
        close = later[100 * both >= percent * (sizes[later] + sizes[k] - both)]
        joined, first = np.unique(comp[close], return_index=True)
        edges += [(k, j) for j in close[first].tolist()]
        comp[np.isin(comp, joined)] = comp[k]
        if (comp == comp[k]).all():
            break
    return edges


def candidates(sketches: DataFrame, seeds: range, how: Search) -> DataFrame:
    """(bucket, node, root) of the texts, from sketches (node, root, keys), that a block's index links to one of another root; bucket names the linked group."""
    blocks = 64 // how.block
    code = F.col("keys")
    each = [F.struct(F.lit(s * blocks + b).alias("place"), code[s].alias("code"), code[(s + 1) % how.seeds].alias("other"), F.shiftrightunsigned(code[s], 64 - (b + 1) * how.block).bitwiseAND(F.lit((1 << how.block) - 1)).alias("head")) for s in seeds for b in range(blocks)]
    dealt = sketches.select("node", "root", F.explode(F.array(*each)).alias("e")).select("e.place", "e.head", "e.code", "e.other", "node", "root").repartition("place", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not held:
            return
        places, codes, others, nodes, roots = (np.concatenate(x) for x in zip(*held))
        for place in np.unique(places).tolist():
            at = np.nonzero(places == place)[0]
            mask = ((1 << how.block) - 1) << (64 - (place % blocks + 1) * how.block)
            index = GrayIndex(arranged(codes[at].view(np.uint64), mask), how.block)
            at = at[index.order]
            other = others[at].view(np.uint64)
            # of one head, the texts of a root are linked already
            first = np.unique(np.stack([index.root, roots[at]]), axis=1, return_inverse=True)[1].ravel()
            least = np.full(first.max() + 1, len(at))
            np.minimum.at(least, first, np.arange(len(at)))
            before = least[first]
            comp = index.links(how.radius, comp=before.copy(), agree=lambda a, b, other=other: np.bitwise_count(other[a] ^ other[b]) <= how.second)
            # groups of more than one root
            grown = np.zeros(len(at), bool)
            grown[comp[comp != before]] = True
            found = np.nonzero(grown[comp])[0]
            if len(found):
                # a group's name: its block and its smallest node
                name = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(name, comp, nodes[at])
                group = name[comp[found]] * np.int64(1_000_003) + np.int64(place)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(nodes[at[found]]), pa.array(roots[at[found]])], ["bucket", "node", "root"])

    return dealt.select(F.col("place").cast("int"), "code", "other", "node", "root").mapInArrow(run, "bucket long, node long, root long")


def links(groups: DataFrame, sets: DataFrame, percent: int = 80, most: int = 4096) -> DataFrame:
    """Edges (u, v) among the nodes that share a bucket of groups (bucket, n, node, root), n its size, from sets (node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def found() -> pa.RecordBatch:
            nodes = list(held)
            edges = forest([np.frombuffer(held[x][1], np.uint64) for x in nodes], percent, np.array([held[x][0] for x in nodes])) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for bucket, a, b, node, root, hashes in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if (bucket, a, b) != now:
                    if len(held) > 1:
                        yield found()
                    now, held = (bucket, a, b), {}
                held[node] = (root, hashes.as_py())
        if len(held) > 1:
            yield found()

    # parts of a large group: each two of them meet
    parts = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    meets = F.when(parts <= 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b"))))
    spread = groups.select("bucket", F.explode(meets).alias("m"), "node", "root").select("bucket", "m.a", "m.b", "node", "root")
    dealt = spread.join(sets, "node").select("bucket", "a", "b", "node", "root", "hashes").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, how: Search | None = None) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id that it reaches over pairs of at least that similarity.

    Empty and null texts are copies of each other.  Repeated rows stay.  A null doc_id
    takes part, but is no component's id unless it has no other.  Texts are told apart
    by a 64-bit hash.
    """
    how = how or Search()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.xxhash64("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch(hashed(t.as_py(), how.sketch_words), how.seeds).view(np.int64) for t in batch.column(1)]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * how.seeds, flat)], ["doc_id", "node", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], ["node", "hashes"])

    found = kept(rows.mapInArrow(sketched, "doc_id long, node long, keys array<long>"), "sketches")
    different = kept(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "different")
    rooted, edges = different.select("node", "least", F.col("node").alias("root")), None
    for seeds in (range(1), range(1, how.seeds)):
        near = kept(candidates(different.select("node", "keys").join(rooted.select("node", "root"), "node"), seeds, how), "near")
        shapes = near.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("node").alias("a"), F.bit_xor(F.xxhash64("node")).alias("b"))
        # buckets of the same texts are one
        chosen = shapes.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
        groups = near.join(chosen, "bucket").select("bucket", "n", "node", "root")
        wanted = near.select("node").distinct().join(different.select("node", "least"), "node").select(F.col("node").alias("of"), "least")
        met = rows.join(wanted, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
        sets = met.select("node", "text").mapInArrow(sets_of, "node long, hashes binary")
        new = kept(links(groups, sets, percent, how.most), "links")
        edges = new if edges is None else edges.union(new)
        reach = components(edges).withColumnRenamed("node", "of")
        rooted = different.select("node", "least").join(reach, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.select("doc_id", "node").join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest.

    Rows with one doc_id are one document and stay or go together; rows without a
    doc_id stay.
    """
    found = near_components(docs.select("doc_id", "text"), words, percent)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__aw_stay")).distinct()
    met = docs.join(stay, F.col("doc_id").cast("long") == F.col("__aw_stay"), "left")
    return met.where(F.col("__aw_stay").isNotNull() | F.col("doc_id").isNull()).drop("__aw_stay")
