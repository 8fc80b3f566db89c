"""Queries to DataFrames.

A graph gives rows of a pattern (scan), estimates (size), terms behind its internal
values (decode) and vertex lists of its indexes (vertices).  Values are term
structs, or ids of a store; ids are decoded as late as a filter, the order or the
output asks for, and filters on one variable's text run on the dictionary first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwell.functions.expr import Compiler
from arcwell.operators import solutions as op
from arcwell.plans import optimizer
from arcwell.plans.parser import Expr, Group, Pattern, Query, Reach, Star, TableFunction, Var, parse
from arcwell.terms import TERM, Term, rendered


@dataclass
class Options:
    """typed: numbers compare as numbers.  indexes: use vertex lists.  reorder: order joins by estimates.  aggregate: count unused slots away.

    wide: estimated rows from which a join that makes several times its input is spread over tasks.
    """

    typed: bool = False
    indexes: bool = True
    reorder: bool = True
    aggregate: bool = True
    wide: float = 2e7
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    table_functions: dict[str, Callable] = field(default_factory=dict)
    most_steps: int = 10_000


@dataclass
class Rows:
    """Solutions; decoded are the variables held as terms rather than ids."""

    df: DataFrame
    decoded: set[str]


def _rows(df: DataFrame) -> Rows:
    """Rows whose term columns are known by their type."""
    return Rows(df, {c for c, kind in df.dtypes if kind.startswith("struct")})


class Plan:
    """One query over one graph; `tree` describes what was planned."""

    def __init__(self, graph, query: Query, options: Options | None = None):
        self.graph, self.query, self.options = graph, query, options or Options()
        self.spark = graph.spark
        self.tree: list[str] = []
        self._used = optimizer.used(query)
        self._unique: set[str] = set()  # variables of rows that are known to be different

    # representation

    def _decode(self, rows: Rows, names) -> Rows:
        todo = [n for n in names if n in rows.df.columns and n not in rows.decoded]
        if not todo:
            return rows
        return Rows(self.graph.decode(rows.df, todo), rows.decoded | set(todo))

    def _alike(self, a: Rows, b: Rows) -> tuple[Rows, Rows]:
        """Both with the same representation of shared variables."""
        mixed = (a.decoded ^ b.decoded) & set(a.df.columns) & set(b.df.columns)
        return self._decode(a, mixed), self._decode(b, mixed)

    def _join(self, a: Rows | None, b: Rows, how: Callable = op.join) -> Rows:
        if a is None:
            return b
        a, b = self._alike(a, b)
        return Rows(how(a.df, b.df), a.decoded | b.decoded)

    def _join_wide(self, a: Rows, b: Rows, group: Group, last: bool) -> Rows:
        """A join that makes far more rows than it gets. last: only filters follow."""
        a, b = self._alike(a, b)
        shared = [v for v in op.variables(a.df) if v in op.variables(b.df)]
        wanted = set(self.query.output()) | {k[1:] for k, _ in self.query.order}
        filtered = {v for e in group.filters for v in e.variables()}
        mode = self.query.mode
        if not last or mode not in ("all", "distinct", "reduced"):
            return Rows(op.join(a.df, b.df, wide=True), a.decoded | b.decoded)
        # terms are named on the few rows before, not on the many after
        a, b = (self._decode(x, [v for v in x.df.columns if v in wanted and v not in filtered and v not in shared]) for x in (a, b))
        single = op.N not in a.df.columns and op.N not in b.df.columns and min(len(a.df.columns), len(b.df.columns)) > len(shared)
        if mode != "all" and single and not set(shared) & (wanted | filtered):
            out = op.linked(a.df, b.df, shared)
            self._unique = set(out.columns)
            return Rows(out, (a.decoded | b.decoded) - set(shared))
        named = [v for v in shared if v in wanted and v not in filtered and v not in a.decoded]
        if named:
            twins = Rows(a.df.select("*", *[F.col(v).alias(f"__t_{v}") for v in named]), a.decoded)
            a = self._decode(twins, [f"__t_{v}" for v in named])
        out = op.join(a.df, b.df, wide=True)
        if named:
            out = out.drop(*named).withColumnsRenamed({f"__t_{v}": v for v in named})
        return Rows(out, (a.decoded | b.decoded | set(named)) - {f"__t_{v}" for v in named})

    def _note(self, depth: int, text: str) -> None:
        self.tree.append("  " * depth + text)

    # groups

    def _scan(self, pattern: Pattern | Star, depth: int) -> Rows | None:
        df = self.graph.scan(pattern)
        if df is None:
            return None
        said = f"scan {_shown(pattern)}"
        if self.options.indexes:
            for name, lists in self.graph.vertices(pattern).items():
                for vertices in lists:
                    df = op.within(df, name, vertices)
                    said += f" within index of ?{name}"
        keep = [v for v in op.variables(df) if v in self._used]
        if self.options.aggregate and self.query.mode != "all" and len(keep) < len(op.variables(df)):
            if not keep or self._repeats(pattern, keep):
                if self.query.mode in ("count", "duplicates") or not keep:
                    df = op.counted(df, keep).where(F.col(op.N) > 0)
                    said += " counted"
                else:
                    df = df.select(*keep).distinct()
                    said += " distinct"
            else:
                df = df.select(*keep, *([op.N] if op.N in df.columns else []))
        self._note(depth, said)
        return _rows(df)

    def _repeats(self, pattern: Pattern | Star, keep: list[str]) -> bool:
        """Whether the kept variables repeat enough for an aggregate before the joins to pay."""
        size = self.graph.size(pattern)
        groups = 1.0
        for v in keep:
            groups *= size.values.get(v, size.rows)
        return groups < 0.5 * size.rows

    def group(self, group: Group, depth: int = 0) -> Rows | None:
        """Solutions of a group; None if it is known to be empty."""
        patterns = self.graph.stars(group.patterns) if hasattr(self.graph, "stars") else group.patterns
        if self.options.reorder:
            patterns = optimizer.order(patterns, self.graph.size)
        rows: Rows | None = None
        so_far: optimizer.Size | None = None
        alone = depth == 0 and not (group.unions or group.reaches or group.functions or group.optionals)
        for k, p in enumerate(patterns):
            found = self._scan(p, depth + 1)
            if found is not None and self.options.reorder and len(patterns) > 1:
                self.tree[-1] += f" ~{self.graph.size(p).rows:.0f} rows"
            if found is None:
                self._note(depth + 1, f"empty {_shown(p)}")
                return None
            own = self.graph.size(p) if len(patterns) > 1 else None
            both = so_far.joined(own) if so_far is not None else own
            if so_far is not None and so_far.values.keys() & own.values.keys() and both.rows >= self.options.wide and both.rows > 4 * max(so_far.rows, own.rows):
                self._note(depth + 1, f"spread join ~{both.rows:.0f} rows")
                rows = self._join_wide(rows, found, group, alone and k == len(patterns) - 1)
            else:
                rows = self._join(rows, found)
            so_far = both
        for branches in group.unions:
            self._note(depth + 1, f"union of {len(branches)}")
            parts = [x for b in branches if (x := self.group(b, depth + 1)) is not None]
            if not parts:
                return None
            mixed = set().union(*(p.decoded for p in parts))
            parts = [self._decode(p, mixed) for p in parts]
            rows = self._join(rows, _rows(op.union([p.df for p in parts])))
        for r in group.reaches:
            rows = self._reach(rows, r, depth + 1)
            if rows is None:
                return None
        if rows is None:
            rows = Rows(op.singleton(self.spark), set())
        todo = list(group.functions)
        while todo:
            ready = next((f for f in todo if all(x.name in rows.df.columns for x in f.inputs if isinstance(x, Var))), None)
            if ready is None:
                raise ValueError("a table function's inputs are never bound")
            todo.remove(ready)
            rows = self._function(rows, ready, depth + 1)
        for g in group.optionals:
            self._note(depth + 1, "optional")
            found = self.group(g, depth + 1)
            if found is None:
                missing = [v for v in g.variables() if v not in rows.df.columns]
                rows = Rows(rows.df.select("*", *[F.lit(None).cast(TERM).alias(v) for v in missing]), rows.decoded | set(missing))
            else:
                rows = self._join(rows, found, op.optional)
        for e in group.filters:
            self._note(depth + 1, f"filter {e.op}")
            rows = self._filter(rows, e)
        return rows

    def _filter(self, rows: Rows, e: Expr) -> Rows:
        names = [v for v in e.variables() if v in rows.df.columns]
        raw = [v for v in names if v not in rows.decoded]
        if raw:
            if set(raw) == set(names) and (c := self._on_ids(e, set(rows.df.columns))) is not None:
                return Rows(rows.df.where(c), rows.decoded)
            if hasattr(self.graph, "terms_where") and len(names) == 1 and len(raw) == 1 and "bound" not in _ops(e) and not _true_of_null(e):
                terms = self.graph.terms_where(lambda t: self._compiler({names[0]: t}).condition(e))
                return Rows(op.within(rows.df, names[0], terms), rows.decoded)
        before = rows.df.columns
        shown = self._decode(rows, names)
        return Rows(shown.df.where(self._compiler({v: F.col(v) for v in names}).condition(e)).select(*before), shown.decoded)

    def _compiler(self, variables: dict[str, Column]) -> Compiler:
        return Compiler(variables, self.options.typed, self.options.functions, self.graph.known)

    def _on_ids(self, e: Expr, bound: set[str]) -> Column | None:
        """=, != and in over variables and known constants, on ids; None for anything else."""

        def operand(x: Expr) -> Column | None:
            if x.op == "var" and x.args[0] in bound:
                return F.col(x.args[0])
            if x.op == "const" and (i := self.graph.id_of(x.args[0])) is not None:
                return F.lit(i)
            return None

        if e.op in ("=", "!=", "in"):
            sides = [operand(x) for x in e.args]
            if any(s is None for s in sides):
                return None
            if e.op == "in":
                return F.coalesce(sides[0].isin(*sides[1:]), F.lit(False)) if len(sides) > 1 else F.lit(False)
            return F.coalesce(sides[0] == sides[1] if e.op == "=" else sides[0] != sides[1], F.lit(False))
        return None

    def _reach(self, rows: Rows | None, r: Reach, depth: int) -> Rows | None:
        """One or more edges, level by level from the bound end until nothing new is reached (extension)."""
        edge = self.graph.scan(Pattern(Var("__a"), r.predicate, Var("__b")))
        self._note(depth, "reaches")
        if edge is None:
            return None
        if len({kind for _, kind in edge.dtypes}) > 1:
            edge = self._decode(_rows(edge), edge.columns).df
        edge = edge.distinct()
        # the search begins at an end that is known: a constant, or the values found so far
        front, forward = edge, True
        for slot, what in (("__a", r.start), ("__b", r.end)):
            if not isinstance(what, Var):
                front, forward = edge.where(self.graph.equals(edge, slot, what)), slot == "__a"
                break
        else:
            for slot, what in (("__a", r.start), ("__b", r.end)):
                if rows is not None and what.name in rows.df.columns:
                    known = self._like(rows, what.name, edge.schema[slot].dataType)
                    if known is not None:
                        front, forward = edge.join(known.toDF("__seed").distinct(), F.col(slot) == F.col("__seed"), "left_semi"), slot == "__a"
                        break
        found = front
        for _ in range(self.options.most_steps):
            if forward:
                step = front.select("__a", F.col("__b").alias("__m")).join(edge.select(F.col("__a").alias("__m"), "__b"), "__m").select("__a", "__b").distinct()
            else:
                step = front.select(F.col("__a").alias("__m"), "__b").join(edge.select("__a", F.col("__b").alias("__m")), "__m").select("__a", "__b").distinct()
            front = step.join(found, ["__a", "__b"], "left_anti").checkpoint()
            if front.isEmpty():
                break
            found = found.union(front)
        else:
            raise RuntimeError(f"reaches needs more than {self.options.most_steps} steps")
        slots: dict = {}
        for slot, what in (("__a", r.start), ("__b", r.end)):
            slots[slot] = what.name if isinstance(what, Var) else self.graph.equals(found, slot, what)
        return self._join(rows, _rows(op.match(found, slots)))

    def _like(self, rows: Rows, name: str, kind) -> DataFrame | None:
        """The values of a variable if they are held as that type."""
        return rows.df.select(name) if rows.df.schema[name].dataType == kind else None

    def _function(self, rows: Rows, f: TableFunction, depth: int) -> Rows:
        from arcwell.functions.table import lateral

        if f.name not in self.options.table_functions:
            raise ValueError(f"no table function {f.name!r}")
        self._note(depth, f"table function {f.name}")
        rows = self._decode(rows, [x.name for x in f.inputs if isinstance(x, Var)])
        inputs = [F.col(x.name) if isinstance(x, Var) else x.column() for x in f.inputs]
        again = [v for v in f.outputs if v in rows.df.columns]
        names = [f"__out_{v}" if v in again else v for v in f.outputs]
        df = lateral(rows.df, self.options.table_functions[f.name], inputs, names)
        rows = self._decode(Rows(df, rows.decoded | {n for n in names}), again)
        df = rows.df
        for v in again:
            df = df.where(F.col(v) == F.col(f"__out_{v}")).drop(f"__out_{v}")
        return Rows(df, rows.decoded | set(f.outputs))

    # whole query

    def terms(self) -> DataFrame:
        """Solutions in order, the output's variables as term structs, and `count` in the modes that have it."""
        q = self.query
        rows = self.group(q.where)
        out = list(q.output())
        bound = set(q.where.variables())
        keys = [(k, d) for k, d in q.order if k == "count" or k[1:] in bound]
        names = list(dict.fromkeys([*out, *(k[1:] for k, _ in keys if k != "count")]))
        counts = q.mode in ("count", "duplicates")
        if rows is None:
            rows = Rows(op.empty(self.spark, names, TERM), set(names))
        missing = [n for n in names if n not in rows.df.columns]
        rows = Rows(rows.df.select("*", *[F.lit(None).cast(TERM).alias(n) for n in missing]), rows.decoded | set(missing))
        df = rows.df.select(*names) if q.mode in ("distinct", "reduced") and self._unique == set(names) else op.duplicates(rows.df, names, q.mode)
        if q.mode != "all" and set(names) - rows.decoded and hasattr(self.graph, "settled"):
            df = self.graph.settled(df)
        rows = self._decode(Rows(df, rows.decoded), names)
        df = rows.df
        if keys:
            order = []
            for k, descending in keys:
                if k == "count":
                    if counts:
                        order.append(F.col("count").desc() if descending else F.col("count").asc())
                    continue
                for part in ("type", "sub", "lex"):
                    c = F.col(k[1:])[part]
                    order.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
            if order:
                df = df.orderBy(*order)
        if q.offset is not None:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*out, *(["count"] if counts else []))

    def texts(self) -> DataFrame:
        """The same with lexical forms."""
        df = self.terms()
        return df.select(*[F.col(n)["lex"].alias(n) for n in self.query.output()], *([F.col("count")] if "count" in df.columns and "count" not in self.query.output() else []))

    def rendered(self) -> DataFrame:
        """One text column `line` as a result sink writes it: terms in N-Triples notation and NULL, between spaces."""
        df = self.terms()
        cells = [rendered(F.col(n)) for n in self.query.output()]
        if self.query.mode in ("count", "duplicates"):
            cells.append(F.col("count").cast("string"))
        return df.select(F.concat_ws(" ", *cells).alias("line"))


def _ops(e: Expr) -> set[str]:
    return {e.op} | {o for a in e.args if isinstance(a, Expr) for o in _ops(a)}


def _true_of_null(e: Expr) -> bool:
    """Whether a NULL variable might satisfy it: under a negation, or where NULL's text counts."""
    return bool(_ops(e) & {"!", "||", "call"})


def _shown(p: Pattern | Star) -> str:
    if isinstance(p, Star):
        return " ; ".join(map(_shown, p.patterns))
    return " ".join(f"?{x.name}" if isinstance(x, Var) else x.lex for x in (p.s, p.p, p.o))


def plan(graph, text: str, options: Options | None = None) -> Plan:
    return Plan(graph, parse(text), options)


def query(graph, text: str, options: Options | None = None) -> DataFrame:
    """Rows of lexical forms."""
    return plan(graph, text, options).texts()
