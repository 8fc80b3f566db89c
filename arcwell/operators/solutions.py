"""Operators over solution rows: one column a variable, null where it is unbound.

Each one only declares DataFrame operations; Catalyst chooses the physical form.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplicity of a row where equal rows have been counted.
N = "__n"
#: Rows on each side of a cell of `spread`, rows that one of its tasks makes, and its most tasks.
CELL, TASK_PAIRS, MOST_TASKS = 1024, 1 << 24, 100_000


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != N]


def empty(spark: SparkSession, names: Sequence[str], kind: str) -> DataFrame:
    """No rows (an unresolvable constant)."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(n) for n in names])


def singleton(spark: SparkSession) -> DataFrame:
    """One row without variables, the identity of joins."""
    return spark.range(1).select()


def match(triples: DataFrame, slots: dict[str, Column | str]) -> DataFrame:
    """Triple pattern: slot -> a constant's condition, or a variable's name.

    Conditions become filters, names columns; a name in several slots makes these equal.
    """
    out = triples
    names: dict[str, str] = {}
    for slot, what in slots.items():
        if not isinstance(what, str):
            out = out.where(what)
        elif what in names:
            out = out.where(F.col(names[what]) == F.col(slot))
        else:
            names[what] = slot
    return out.select(*[F.col(slot).alias(name) for name, slot in names.items()])


def counted(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Aggregated scan: different values of some variables with their number of rows."""
    n = F.sum(N) if N in df.columns else F.count("*")
    return df.groupBy(*keep).agg(n.alias(N))


def join(a: DataFrame, b: DataFrame, how: str = "inner", wide: bool = False) -> DataFrame:
    """Equi-join on all shared variables, cross product where there are none; multiplicities multiply. wide: an inner join that is spread."""
    shared = [v for v in variables(a) if v in variables(b)]
    both = N in a.columns and N in b.columns
    if both:
        b = b.withColumnRenamed(N, "__m")
    if shared and wide:
        out = spread(a, b, shared)
    else:
        out = a.join(b, shared, how) if shared else a.crossJoin(b)
    return out.withColumn(N, F.col(N) * F.col("__m")).drop("__m") if both else out


def spread(a: DataFrame, b: DataFrame, shared: Sequence[str]) -> DataFrame:
    """The equi-join where few values make far more rows than come in.

    The rows of a value are cut on both sides into runs of about `CELL`; each pair of
    runs is a cell, and cells are dealt to as many tasks as the rows to be made ask for.
    A row is copied once for each run of the other side, a thousandth of what it makes.
    """
    here, there = (df.groupBy(*shared).agg(F.count("*").alias(n)) for df, n in ((a, "__na"), (b, "__nb")))
    sizes = here.join(there, list(shared))
    made = sizes.agg(F.sum(F.col("__na").cast("decimal(38,0)") * F.col("__nb"))).first()[0] or 0
    # fewer than the session's partitions would be dealt anew, by size of input
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-int(made) // TASK_PAIRS)))
    runs = sizes.select(*shared, F.ceil(F.col("__na") / CELL).alias("__ka"), F.ceil(F.col("__nb") / CELL).alias("__kb"))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        run = F.pmod(F.xxhash64(*df.columns), F.col(f"__k{own}"))
        cut = df.join(runs, list(shared)).withColumn(f"__s{own}", run).withColumn(f"__s{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__k{other}") - 1)))
        return cut.drop("__ka", "__kb").repartition(tasks, *shared, "__sa", "__sb")

    return side(a, "a", "b").join(side(b, "b", "a"), [*shared, "__sa", "__sb"]).drop("__sa", "__sb")


def linked(a: DataFrame, b: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Different rows of a join without its shared variables, made once each instead of made and sorted out.

    Rows of one side with the same set of shared values are a class; the classes that
    have a value in common are found, and then the members of each such pair are paired.
    """
    sides = []
    for df, c in ((a, "__ca"), (b, "__cb")):
        own = [v for v in df.columns if v not in shared]
        sides.append(df.dropna(subset=list(shared)).groupBy(*own).agg(F.sort_array(F.collect_set(F.struct(*shared))).alias(c)))
    left, right = sides
    each = [df.select(c).distinct().withColumn("__k", F.explode(c)) for df, c in ((left, "__ca"), (right, "__cb"))]
    pairs = each[0].join(each[1], "__k").select("__ca", "__cb").distinct()
    return spread(left.join(pairs, "__ca"), right.join(pairs, "__cb"), ["__ca", "__cb"]).drop("__ca", "__cb")


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left outer join on all shared variables (extension); multiplicities multiply, a row without a match keeps its own.

    Without a shared variable each row meets all of b, or none if b is empty: a cross
    product as the query says, of which Spark picks the form by size.
    """
    shared = [v for v in variables(a) if v in variables(b)]
    counts = N in a.columns or N in b.columns
    if N in b.columns:
        b = b.withColumnRenamed(N, "__m")
    if shared:
        out = a.join(b, shared, "left")
    else:
        # at most one row goes to all tasks
        some = b.select(F.lit(True).alias("__some")).limit(1)
        alone = a.join(F.broadcast(some), F.lit(True), "left_anti")
        missing = [f for f in b.schema.fields if f.name not in a.columns]
        out = a.crossJoin(b).unionByName(alone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))
    if not counts:
        return out
    one = F.lit(1).cast("long")
    own = F.col(N) if N in a.columns else one
    theirs = F.coalesce(F.col("__m"), one) if "__m" in out.columns else one
    return out.withColumn(N, own * theirs).drop("__m")


def within(df: DataFrame, column: str, vertices: DataFrame) -> DataFrame:
    """Rows whose column is in a vertex list: a semi-join, so no row is doubled."""
    (v,) = vertices.columns
    return df.join(vertices.withColumnRenamed(v, "__v"), F.col(column) == F.col("__v"), "left_semi")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union; variables that a part lacks are null there."""
    kinds = {c: kind for p in parts for c, kind in p.dtypes}
    counts = any(N in p.columns for p in parts)
    names = list(dict.fromkeys(v for p in parts for v in variables(p)))

    def shaped(p: DataFrame) -> DataFrame:
        own = [F.col(v) if v in p.columns else F.lit(None).cast(kinds[v]).alias(v) for v in names]
        return p.select(*own, *([F.col(N) if N in p.columns else F.lit(1).cast("long").alias(N)] if counts else []))

    return reduce(DataFrame.union, map(shaped, parts))


def duplicates(df: DataFrame, names: Sequence[str], mode: str) -> DataFrame:
    """The five duplicate modes over the named variables; count and duplicates append `count`."""
    if mode in ("distinct", "reduced"):
        return df.select(*names).distinct()
    if mode in ("count", "duplicates"):
        n = F.sum(N) if N in df.columns else F.count("*")
        out = df.groupBy(*names).agg(n.alias("count"))
        return out.where("count >= 2") if mode == "duplicates" else out
    if N in df.columns:
        df = df.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col(N))))
    return df.select(*names)
