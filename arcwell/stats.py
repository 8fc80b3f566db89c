"""Statistics over id triples: exact pattern counts, join sizes, characteristic sets, star estimates, schema.

All are aggregates; what is returned to the driver is one number or a small report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outgoing(p: int) -> int:
    """An outgoing predicate in a characteristic set that has incoming ones too: the complement, negative as no id is."""
    return ~p


class Statistics:
    """Counts of a table (s, p, o)."""

    def __init__(self, facts: DataFrame):
        self.facts = facts

    def pairs(self, a: str, b: str) -> DataFrame:
        """Different pairs of two slots with their number of triples."""
        return self.facts.groupBy(a, b).agg(F.count("*").alias("count"))

    def singles(self, a: str) -> DataFrame:
        """Different values of a slot with their number of triples."""
        return self.facts.groupBy(a).agg(F.count("*").alias("count"))

    def cardinality(self, **fixed: int) -> int:
        df = self.facts
        for slot, value in fixed.items():
            df = df.where(F.col(slot) == value)
        return df.count()

    def join_size(self, a: str, b: str) -> int:
        """Rows of the join of all triples with themselves on slot a = slot b."""
        left, right = self.singles(a).toDF("v", "m"), self.singles(b).toDF("v", "n")
        return left.join(right, "v").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]


def characteristic_sets(facts: DataFrame, incoming: bool = True) -> DataFrame:
    """(predicates, count): nodes by the set of predicates at them, outgoing ones as ~p where incoming ones count too."""
    out = facts.select(F.col("s").alias("node"), (F.bitwise_not("p") if incoming else F.col("p")).alias("p"))
    both = out.union(facts.select(F.col("o").alias("node"), "p")) if incoming else out
    sets = both.distinct().groupBy("node").agg(F.array_sort(F.collect_list("p")).alias("predicates"))
    return sets.groupBy("predicates").agg(F.count("*").alias("count"))


def superset_count(sets: DataFrame, predicates: Sequence[int]) -> int:
    """Nodes whose set contains all the predicates."""
    wanted = F.array(*[F.lit(p).cast("long") for p in predicates])
    return sets.where(F.size(F.array_except(wanted, F.col("predicates"))) == 0).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def pair_stats(facts: DataFrame, incoming: bool = True) -> DataFrame:
    """(p1, p2, count): nodes at which two predicates meet, p1 < p2, from the characteristic sets rather than from nodes."""
    p = F.col("predicates")
    combos = F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.struct(x.alias("p1"), y.alias("p2")))))
    return characteristic_sets(facts, incoming).select(F.explode(combos).alias("c"), "count").groupBy("c.p1", "c.p2").agg(F.sum("count").alias("count"))


def star_sets(facts: DataFrame) -> DataFrame:
    """(predicates, subjects, counts): subjects by their set of outgoing predicates, with the triples of each predicate."""
    each = facts.groupBy("s", "p").agg(F.count("*").alias("n"))
    nodes = each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("pn"))
    flat = nodes.select(F.col("pn.p").alias("predicates"), F.explode("pn").alias("x"))
    sums = flat.groupBy("predicates", "x.p").agg(F.sum("x.n").alias("n"), F.count("*").alias("subjects"))
    return sums.groupBy("predicates").agg(F.max("subjects").alias("subjects"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("counts"))


def star_estimate(sets: DataFrame, predicates: Sequence[int]) -> float:
    """Expected rows of a star over the predicates: for each superset, subjects times the mean number of triples of each."""
    wanted = F.array(*[F.lit(p).cast("long") for p in predicates])
    rows = F.col("subjects").cast("double")
    for p in predicates:
        rows = rows * F.col("counts")[F.lit(p).cast("long")] / F.col("subjects")
    return sets.where(F.size(F.array_except(wanted, F.col("predicates"))) == 0).agg(F.coalesce(F.sum(rows), F.lit(0.0))).first()[0]


def schema_classes(facts: DataFrame, most: int = 10_000) -> list[tuple[tuple[int, ...], int]]:
    """Classes of subjects by outgoing predicates, without those that another class covers.

    A class goes if another has all its predicates, or all but one where it has more
    than three; its subjects then count there.  Classes are a report: more than
    `most` raise an error.
    """
    rows = characteristic_sets(facts, False).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    classes = {tuple(r["predicates"]): r["count"] for r in rows}
    for small in sorted(classes, key=lambda c: (len(c), c)):
        for big in sorted(classes, key=lambda c: (-len(c), c)):
            missing = len(set(small) - set(big))
            if big != small and len(big) >= len(small) and missing <= (1 if len(small) > 3 else 0):
                classes[big] += classes.pop(small)
                break
    return sorted(classes.items())


def class_edges(facts: DataFrame, classes: Sequence[tuple[tuple[int, ...], int]], most: int = 10_000) -> DataFrame:
    """(source, p, target, count): triples between subjects of the classes, a class by its place in the list."""
    nodes = facts.select("s", "p").distinct().groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("set"))

    def place(own: set[int]) -> int | None:
        return next((k for k, (c, _) in enumerate(classes) if len(own - set(c)) <= (1 if len(own) > 3 else 0)), None)

    # the different sets are a report as the classes are
    sets = nodes.select("set").distinct().limit(most + 1).collect()
    if len(sets) > most:
        raise ValueError(f"more than {most} sets of predicates")
    named = facts.sparkSession.createDataFrame([(r["set"], place(set(r["set"]))) for r in sets], "set array<long>, class int")
    member = nodes.join(named, "set").select(F.col("s").alias("node"), "class")
    a, b = member.toDF("s", "source"), member.toDF("o", "target")
    return facts.join(a, "s").join(b, "o").groupBy("source", "p", "target").agg(F.count("*").alias("count"))


def dot(edges: DataFrame, names: dict[int, str] | None = None, most: int = 100_000) -> str:
    """A class graph of at most `most` edges in the dot language."""
    rows = edges.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges between classes")
    rows.sort(key=lambda r: tuple(-1 if x is None else x for x in (r["source"], r["p"], r["target"])))
    lines = [f'  c{r["source"]} -> c{r["target"]} [label="{(names or {}).get(r["p"], r["p"])} ({r["count"]})"];' for r in rows]
    return "\n".join(["digraph schema {", *lines, "}"])
