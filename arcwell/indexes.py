"""Vertex lists of predicate paths and of frequent subgraphs, as semi-join filters.

Both indexes keep, for a shape, the vertices that can stand at one of its places.
A query that contains the shape may keep only rows whose value is in the list.
This is an optimization: results are the same without it.  An index is of the
store's state whose facts() it was built from (`of`; None if these were others), and
the store uses it in that state only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.plans.parser import Group, Pattern, Query, Var
from arcwell.terms import Term, hash_part

#: A step over any predicate.  A step against the direction of a predicate is its complement ~p: negative, as no id is.
ANY = -(1 << 63)
#: Directories of a level's lists; a list is read from one of them.
PARTS = 64

Path = tuple[int, ...]


class PathIndex:
    """For each kept predicate path the vertices at its end.

    Level by level, all paths of a length at once: the vertices of a path joined
    with the triples that leave them give the paths one longer.  A path stays if it
    is selective, |V(path)| / |V(suffix)| < most_ratio, and, at length l, ends in at
    least ((l - 1) / max_length)**2 * least vertices.
    """

    def __init__(self, spark, path: str, counts: dict[Path, int], of: tuple | None = None):
        self.spark, self.path, self.counts, self.of = spark, path, counts, of

    @classmethod
    def build(cls, facts: DataFrame, path: str, max_length: int = 3, most_ratio: float = 0.8, least: int = 0, reverse: bool = False, any_predicate: bool = False, most_paths: int = 100_000) -> PathIndex:
        spark = facts.sparkSession
        steps = facts.select("s", "p", "o")
        if reverse:
            steps = steps.union(facts.select(F.col("o").alias("s"), F.bitwise_not("p").alias("p"), F.col("s").alias("o")))
        if any_predicate:
            steps = steps.union(facts.select("s", F.lit(ANY).cast("long").alias("p"), "o").distinct())
        kept: dict[Path, int] = {}
        every: dict[Path, int] = {}
        for length in range(1, max_length + 1):
            at = f"{path}/L{length}"
            if length == 1:
                found = steps.select(F.array("p").alias("path"), F.col("o").alias("v"))
            else:
                last = F.element_at("path", -1)
                before = spark.read.parquet(f"{path}/L{length - 1}")
                bounce = last == F.bitwise_not("p")
                found = before.join(steps, F.col("v") == F.col("s")).where(~bounce).select(F.concat("path", F.array("p")).alias("path"), F.col("o").alias("v"))
            name = F.array_join(F.transform("path", lambda p: p.cast("string")), ",")
            named = found.distinct().withColumn("name", name).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int"))
            named.hint("rebalance", "part").sortWithinPartitions("part", "name", "v").write.mode("overwrite").partitionBy("part").parquet(at)
            rows = spark.read.parquet(at).groupBy("path").count().limit(most_paths + 1).collect()
            if len(rows) > most_paths:
                raise ValueError(f"more than {most_paths} paths of length {length}")
            now = {tuple(r["path"]): r["count"] for r in rows}
            every |= now
            floor = ((length - 1) / max_length) ** 2 * least
            for p, n in now.items():
                suffix = every.get(p[1:]) if length > 1 else None
                if n >= floor and (suffix is None or n / suffix < most_ratio):
                    kept[p] = n
        return cls(spark, path, kept, getattr(facts, "store_state", None))

    def vertices(self, p: Path) -> DataFrame:
        """A path's list: one directory is read, and of its row groups those that may hold the path."""
        name = ",".join(map(str, p))
        return self.spark.read.parquet(f"{self.path}/L{len(p)}").where((F.col("part") == hash_part(name, PARTS)) & (F.col("name") == name)).select("v")

    def updated(self, facts: DataFrame, path: str, **how) -> PathIndex:
        """The index of changed facts; built anew, which is exact for deletions too."""
        return PathIndex.build(facts, path, **how)

    def candidates(self, edges: Sequence[tuple[str, int, str]]) -> dict[str, list[Path]]:
        """For each node of a query's graph the kept paths that end there, without suffixes of longer ones."""
        longest = max(map(len, self.counts), default=0)
        steps: dict[str, list[tuple[str, int]]] = {}
        for s, p, o in edges:
            steps.setdefault(o, []).append((s, p))
            steps.setdefault(s, []).append((o, ~p))
        out = {}
        for node in steps:
            paths: set[Path] = set()
            front: list[tuple[str, Path]] = [(node, ())]
            for _ in range(longest):
                front = [(n, (p, *path)) for at, path in front for n, p in steps.get(at, ()) if not path or path[0] != ~p]
                paths |= {path for _, path in front}
            known = [p for p in paths if p in self.counts]
            out[node] = [p for p in known if not any(q != p and q[-len(p) :] == p for q in known)]
        return out

    def lists(self, edges: Sequence[tuple[str, int, str]]) -> dict[str, list[tuple[int, DataFrame]]]:
        return {n: [(self.counts[p], self.vertices(p)) for p in sorted(paths, key=lambda p: self.counts[p])[:2]] for n, paths in self.candidates(edges).items()}


Edge = tuple[int, int, int]  # from place, to place, predicate
LISTS = "v long, place int"


def canonical(edges: Iterable[Edge]) -> tuple[tuple[Edge, ...], tuple[int, ...]]:
    """The smallest code of a small graph over all numberings of its nodes, and the new number of each node."""
    edges = list(edges)
    n = 1 + max(max(a, b) for a, b, _ in edges)
    return min((tuple(sorted((perm[a], perm[b], p) for a, b, p in edges)), perm) for perm in permutations(range(n)))


@dataclass
class Shape:
    """A frequent subgraph: support, different vertices at each place, and the folder of these lists."""

    code: tuple[Edge, ...]
    support: int
    counts: tuple[int, ...]
    path: str
    reuse: dict[int, tuple[str, int]]


def _meeting(left: DataFrame, right: DataFrame, on: Sequence[str]) -> int:
    """Rows of a join, from the numbers of rows of each key."""
    a, b = left.groupBy(*on).agg(F.count("*").alias("__a")), right.groupBy(*on).agg(F.count("*").alias("__b"))
    return a.join(b, list(on)).agg(F.coalesce(F.sum(F.col("__a").cast("decimal(38,0)") * F.col("__b")), F.lit(0))).first()[0]


def occurring(facts: DataFrame, code: Sequence[Edge], most_embeddings: int) -> list[DataFrame] | None:
    """For each place of a shape the different vertices that stand there in some embedding, column v.

    Embeddings are listed only of the part of a shape in which each place is on a cycle
    or between two; None if a join there has more than most_embeddings rows.  What hangs
    on this part, and all of a shape without cycles, is reduced by semi-joins towards its
    root and back, so each step has at most the rows of the triples of a predicate.
    """
    n = 1 + max(max(a, b) for a, b, _ in code)
    between: dict[tuple[int, int], DataFrame] = {}
    for a, b, p in code:
        rows = facts.where(F.col("p") == p).select(F.col("s").alias(f"v{a}"), F.col("o").alias(f"v{b}"))
        key = (min(a, b), max(a, b))
        between[key] = between[key].join(rows, [f"v{k}" for k in key]) if key in between else rows
    near: dict[int, set[int]] = {k: {x for e in between if k in e for x in e if x != k} for k in range(n)}

    def edge(a: int, b: int) -> DataFrame:
        return between[min(a, b), max(a, b)]

    def within(rows: DataFrame, place: int, vertices: DataFrame | None) -> DataFrame:
        return rows if vertices is None else rows.join(vertices, f"v{place}", "left_semi")

    # leaves go first; each leaves its parent the vertices that have a partner
    up: dict[int, DataFrame | None] = dict.fromkeys(range(n))
    left, hung = {k: set(v) for k, v in near.items()}, []
    while (leaf := next((k for k, v in left.items() if len(v) == 1), None)) is not None:
        (parent,) = left[leaf]
        partners = within(edge(leaf, parent), leaf, up[leaf]).select(f"v{parent}").distinct()
        up[parent] = partners if up[parent] is None else up[parent].join(partners, f"v{parent}", "left_semi")
        hung.append((leaf, parent))
        left[parent].discard(leaf)
        del left[leaf]
    full: dict[int, DataFrame] = {}
    if len(left) == 1:
        (root,) = left
        full[root] = up[root]
    else:
        todo = {e: within(within(rows, e[0], up[e[0]]), e[1], up[e[1]]) for e, rows in between.items() if e[0] in left and e[1] in left}
        first = next(iter(todo))
        core, have = todo.pop(first), set(first)
        while todo:
            # an edge that closes a cycle before one that opens
            e = max(todo, key=lambda e: len(have & set(e)))
            on = [f"v{k}" for k in e if k in have]
            if len(on) == 1 and _meeting(core, todo[e], on) > most_embeddings:
                return None
            core, have = core.join(todo.pop(e), on), have | set(e)
        full = {k: core.select(f"v{k}").distinct() for k in left}
    for leaf, parent in reversed(hung):
        full[leaf] = within(within(edge(leaf, parent), parent, full[parent]), leaf, up[leaf]).select(f"v{leaf}").distinct()
    return [full[k].toDF("v") for k in range(n)]


class GraphIndex:
    """Vertex lists of frequent subgraphs of up to max_edges edges.

    Shapes grow edge by edge from frequent ones and are named by their canonical code,
    so each is grown once.  Only the different vertices at each place are found and
    kept (`occurring`), as embeddings can be as many as the square of the triples.
    Support is the least number of different vertices at a place; the threshold rises
    with size, least * edges.  A place whose list is more than 0.7 of its parent's
    uses the parent's list.
    """

    def __init__(self, spark, shapes: dict[tuple[Edge, ...], Shape], of: tuple | None = None):
        self.spark, self.shapes, self.of = spark, shapes, of

    @classmethod
    def build(cls, facts: DataFrame, path: str, max_edges: int = 2, least: int = 2, most_edges_of_predicate: int | None = None, most_embeddings: int = 200_000_000, most_shapes: int = 1000, most_predicates: int = 10_000) -> GraphIndex:
        spark = facts.sparkSession
        rows = facts.groupBy("p").count().limit(most_predicates + 1).collect()
        if len(rows) > most_predicates:
            raise ValueError(f"more than {most_predicates} predicates")
        sizes = {r["p"]: r["count"] for r in rows}
        predicates = sorted(p for p, n in sizes.items() if n >= least and (most_edges_of_predicate is None or n < most_edges_of_predicate))
        shapes: dict[tuple[Edge, ...], Shape] = {}
        front: list[Shape] = []

        def keep(code, parent: Shape | None, old: dict[int, int]) -> None:
            lists = occurring(facts, code, most_embeddings)
            if lists is None:
                return
            at = f"{path}/shape{len(shapes)}"
            placed = reduce(DataFrame.union, [vs.select("v", F.lit(k).alias("place")) for k, vs in enumerate(lists)])
            placed.write.mode("overwrite").partitionBy("place").parquet(at)
            found = {r["place"]: r["count"] for r in spark.read.schema(LISTS).parquet(at).groupBy("place").count().collect()}
            counts = [found.get(k, 0) for k in range(len(lists))]
            if min(counts) < least * len(code):
                return
            reuse = {}
            for k, from_parent in old.items():
                if parent is not None and counts[k] > 0.7 * parent.counts[from_parent]:
                    reuse[k] = parent.reuse.get(from_parent, (parent.path, from_parent))
            shapes[code] = Shape(code, min(counts), tuple(counts), at, reuse)
            front.append(shapes[code])

        for p in predicates:
            keep(((0, 1, p),), None, {})
        for _ in range(max_edges - 1):
            grown, front[:] = list(front), []
            tried: set = set()
            for shape in grown:
                n = len(shape.counts)
                for p in predicates:
                    for a, b in [(a, b) for a in range(n) for b in range(n) if a != b] + [(a, n) for a in range(n)] + [(n, a) for a in range(n)]:
                        if (a, b, p) in shape.code:
                            continue
                        code, perm = canonical([*shape.code, (a, b, p)])
                        if code in tried or code in shapes:
                            continue
                        tried.add(code)
                        if len(shapes) >= most_shapes:
                            raise ValueError(f"more than {most_shapes} frequent shapes")
                        keep(code, shape, {perm[k]: k for k in range(n)})
        return cls(spark, shapes, getattr(facts, "store_state", None))

    def vertices(self, shape: Shape, place: int) -> DataFrame:
        path, k = shape.reuse.get(place, (shape.path, place))
        return self.spark.read.schema(LISTS).parquet(path).where(F.col("place") == k).select("v")

    def matches(self, shape: Shape, edges: Sequence[tuple[str, int, str]]) -> Iterable[dict[int, str]]:
        """Places to query nodes such that each edge of the shape is one of the query."""

        def go(k: int, bound: dict[int, str]):
            if k == len(shape.code):
                yield bound
                return
            a, b, p = shape.code[k]
            for s, q, o in edges:
                if q == p and bound.get(a, s) == s and bound.get(b, o) == o:
                    yield from go(k + 1, bound | {a: s, b: o})

        yield from go(0, {})

    def lists(self, edges: Sequence[tuple[str, int, str]]) -> dict[str, list[tuple[int, DataFrame]]]:
        """For each query node the lists of the largest shapes around it, the shortest first."""
        best: dict[str, list[tuple[int, int, Shape, int]]] = {}
        for shape in self.shapes.values():
            for found in self.matches(shape, edges):
                for place, node in found.items():
                    best.setdefault(node, []).append((-len(shape.code), shape.counts[place], shape, place))
        out = {}
        for node, found in best.items():
            found.sort(key=lambda x: x[:2])
            out[node] = [(n, self.vertices(shape, place)) for _, n, shape, place in found[:1]]
        return out


class Indexed:
    """A store with the vertex lists that apply to one query: a graph for arcwell.plans.compile.

    A list is used on a pattern if it has less than `alpha` of the pattern's different values.
    """

    def __init__(self, store, query: Query, indexes: Sequence, alpha: float = 0.5):
        self.store, self.alpha = store, alpha
        self.spark = store.spark
        self._lists: dict[str, list[tuple[int, DataFrame]]] = {}
        edges = list(self._edges(query.where))
        for index in indexes:
            for node, found in index.lists(edges).items():
                self._lists.setdefault(node, []).extend(found)

    def _edges(self, group: Group):
        """Edges that every solution has: patterns of the outermost group with known predicates."""
        for k, x in enumerate(group.patterns):
            if isinstance(x.p, Term) and (p := self.store.id_of(x.p)) is not None:
                yield tuple(n.name if isinstance(n, Var) else f"={self.store.id_of(n)}" for n in (x.s,)) + (p,) + tuple(n.name if isinstance(n, Var) else f"={self.store.id_of(n)}" for n in (x.o,))

    def vertices(self, pattern: Pattern) -> dict[str, list[DataFrame]]:
        size = self.store.size(pattern)
        return {v: [df for n, df in self._lists.get(v, ()) if n < self.alpha * size.values[v]] for v in pattern.variables()}

    def __getattr__(self, name):
        return getattr(self.store, name)
