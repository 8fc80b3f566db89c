"""Relational tables as a graph, without materialising it.

Every column of a table is a predicate: a row's subject is the IRI table/key, a
foreign key gives an IRI, any other column a literal.  A pattern with a constant
predicate reads one table and two columns; constants become filters on the raw
columns, which reach the Parquet scan.

IRIs of rows are carried as one long, the key times 16 plus a code of the table, so
joins compare longs; they become terms by arithmetic where a filter or the output
needs their text.  Literals are term structs from the start.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.operators.solutions import match
from arcwell.plans.optimizer import Size
from arcwell.plans.parser import Pattern, Star, Var
from arcwell.terms import CUSTOM, DECIMAL, DOUBLE, INTEGER, LANGUAGE, LITERAL, TERM, URI, XSD, Term, literal_column, term


@dataclass(frozen=True)
class Predicate:
    """kind: to (an IRI of another table), text, integer, money, double, date, or tagged (by column lang)."""

    table: str
    column: str
    kind: str = "text"
    to: str | None = None


#: table -> (subject's name, key column; None: a hash of the whole row)
TABLES = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "orders": ("order", "o_orderkey"), "lineitem": ("line", None), "events": ("event", "event_id"), "documents": ("document", "doc_id"), "labels": ("document", "doc_id")}

VOCABULARY = {
    "r_name": Predicate("region", "r_name"),
    "n_name": Predicate("nation", "n_name"),
    "n_region": Predicate("nation", "n_regionkey", "to", "region"),
    "c_name": Predicate("customer", "c_name"),
    "c_nation": Predicate("customer", "c_nationkey", "to", "nation"),
    "c_mktsegment": Predicate("customer", "c_mktsegment"),
    "c_acctbal": Predicate("customer", "c_acctbal", "money"),
    "s_name": Predicate("supplier", "s_name"),
    "s_nation": Predicate("supplier", "s_nationkey", "to", "nation"),
    "s_acctbal": Predicate("supplier", "s_acctbal", "money"),
    "p_name": Predicate("part", "p_name"),
    "p_brand": Predicate("part", "p_brand"),
    "p_type": Predicate("part", "p_type"),
    "p_size": Predicate("part", "p_size", "integer"),
    "p_retailprice": Predicate("part", "p_retailprice", "money"),
    "o_cust": Predicate("orders", "o_custkey", "to", "customer"),
    "o_orderstatus": Predicate("orders", "o_orderstatus"),
    "o_orderpriority": Predicate("orders", "o_orderpriority"),
    "o_orderdate": Predicate("orders", "o_orderdate", "date"),
    "o_totalprice": Predicate("orders", "o_totalprice", "money"),
    "l_order": Predicate("lineitem", "l_orderkey", "to", "order"),
    "l_part": Predicate("lineitem", "l_partkey", "to", "part"),
    "l_supp": Predicate("lineitem", "l_suppkey", "to", "supplier"),
    "l_quantity": Predicate("lineitem", "l_quantity", "money"),
    "l_returnflag": Predicate("lineitem", "l_returnflag"),
    "l_linestatus": Predicate("lineitem", "l_linestatus"),
    "e_user": Predicate("events", "user_id", "to", "user"),
    "event_type": Predicate("events", "event_type"),
    "value": Predicate("events", "value", "double"),
    "lang": Predicate("documents", "lang"),
    "source": Predicate("documents", "source"),
    "n_chars": Predicate("documents", "n_chars", "integer"),
    "text": Predicate("documents", "text", "tagged"),
    "quality": Predicate("labels", "quality", "integer"),
    "toxic": Predicate("labels", "toxic", "integer"),
}


#: Code of each subject's name in the lowest four bits of an id.
CODES = {name: k for k, name in enumerate(["region", "nation", "customer", "supplier", "part", "order", "line", "event", "document", "user"])}
_WIDTH = 16


def _id(name: str, key: Column) -> Column:
    return key.cast("long") * _WIDTH + CODES[name]


def decoded(i: Column) -> Column:
    """The IRI behind an id; rows without a key show their hash."""
    code, key = F.pmod(i, F.lit(_WIDTH)), F.shiftright(i, 4)
    head = F.element_at(F.array(*[F.lit(n + "/") for n in CODES]), (code + 1).cast("int"))
    return F.when(i.isNotNull(), term(F.lit(URI), F.concat(head, F.when(code == CODES["line"], F.hex(key)).otherwise(key.cast("string")))))


def _object(p: Predicate) -> Column:
    c = F.col(p.column)
    if p.kind == "to":
        return _id(p.to, c)
    if p.kind == "integer":
        return literal_column(c.cast("string"), INTEGER)
    if p.kind == "money":
        return literal_column(c.cast("decimal(18,2)").cast("string"), DECIMAL)
    if p.kind == "double":
        return literal_column(c.cast("string"), DOUBLE)
    if p.kind == "date":
        return literal_column(F.date_format(c, "yyyy-MM-dd"), CUSTOM, F.lit(XSD + "date"))
    if p.kind == "tagged":
        return literal_column(c, LANGUAGE, F.col("lang"))
    return literal_column(c)


def _number(text: str) -> int | None:
    return int(text) if text.lstrip("-").isdigit() and str(int(text)) == text else None


class RelationalGraph:
    """The graph of a folder of tables, for arcwell.plans.compile."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _subject(self, table: str) -> Column:
        name, key = TABLES[table]
        return _id(name, F.col(key) if key else F.shiftright(F.xxhash64(*sorted(self.table(table).columns)), 4))

    def _narrowed(self, df: DataFrame, predicate: Predicate, pattern: Pattern) -> DataFrame | None:
        """df filtered by the pattern's constants on raw columns as far as they allow; None if nothing can match."""
        name, key = TABLES[predicate.table]
        if isinstance(pattern.s, Term):
            head, _, tail = pattern.s.lex.partition("/")
            if pattern.s.type != URI or head != name:
                return None
            if key is not None:
                if (n := _number(tail)) is None:
                    return None
                df = df.where(F.col(key) == n)
        if isinstance(pattern.o, Term):
            o, c = pattern.o, F.col(predicate.column)
            if predicate.kind == "to":
                head, _, tail = o.lex.partition("/")
                if o.type != URI or head != predicate.to or predicate.to == "line" or (n := _number(tail)) is None:
                    return None
                df = df.where(c == n)
            elif predicate.kind == "integer":
                if o.type != INTEGER or (n := _number(o.lex)) is None:
                    return None
                df = df.where(c == n)
            elif predicate.kind == "text":
                if o.type != LITERAL:
                    return None
                df = df.where(c == o.lex)
        return df

    def _branch(self, name: str, pattern: Pattern) -> DataFrame | None:
        predicate = VOCABULARY[name]
        df = self._narrowed(self.table(predicate.table), predicate, pattern)
        if df is None:
            return None
        return df.where(F.col(predicate.column).isNotNull()).select(self._subject(predicate.table).alias("s"), term(F.lit(URI), F.lit(name)).alias("p"), _object(predicate).alias("o"))

    def stars(self, patterns: tuple[Pattern, ...]) -> list[Pattern | Star]:
        """Patterns of one subject over columns of one table become one scan, as a row holds one value of each."""
        groups: dict[tuple, list[Pattern]] = {}
        for k, p in enumerate(patterns):
            known = isinstance(p.p, Term) and p.p.type == URI and p.p.lex in VOCABULARY
            groups.setdefault((p.s, VOCABULARY[p.p.lex].table) if known else (k,), []).append(p)
        return [g[0] if len(g) == 1 else Star(tuple(g)) for g in groups.values()]

    def _scan_star(self, star: Star) -> DataFrame | None:
        table = VOCABULARY[star.patterns[0].p.lex].table
        df, columns, what = self.table(table), [self._subject(table).alias("s")], {"s": star.patterns[0].s}
        for k, p in enumerate(star.patterns):
            predicate = VOCABULARY[p.p.lex]
            df = self._narrowed(df, predicate, p)
            if df is None:
                return None
            df = df.where(F.col(predicate.column).isNotNull())
            columns.append(_object(predicate).alias(f"o{k}"))
            what[f"o{k}"] = p.o
        return self._matched(df.select(*columns), what)

    def _matched(self, df: DataFrame, what: dict[str, Var | Term]) -> DataFrame:
        """df matched with a variable or constant for each column."""
        kinds = dict(df.dtypes)
        places: dict[str, list[str]] = {}
        for slot, x in what.items():
            if isinstance(x, Var):
                places.setdefault(x.name, []).append(slot)
        for slots in places.values():
            if len({kinds[s] for s in slots}) > 1:
                df = df.withColumns({s: decoded(F.col(s)) for s in slots if kinds[s] == "bigint"})
        return match(df, {s: x.name if isinstance(x, Var) else self.equals(df, s, x) for s, x in what.items()})

    def equals(self, df: DataFrame, column: str, t: Term) -> Column:
        """Whether a column holds a term."""
        c = F.col(column)
        if dict(df.dtypes)[column] == "bigint":
            if (i := self.id_of(t)) is not None:
                return c == i
            c = decoded(c)
        return (c["lex"] == t.lex) & (c["type"] == t.type) & c["sub"].eqNullSafe(F.lit(t.sub))

    def id_of(self, t: Term) -> int | None:
        """Id of a row's IRI; None for other terms and for rows that are named by their hash."""
        head, _, tail = t.lex.partition("/")
        if t.type != URI or head not in CODES or head == "line" or (n := _number(tail)) is None:
            return None
        return n * _WIDTH + CODES[head]

    def scan(self, pattern: Pattern | Star) -> DataFrame | None:
        """Rows of a triple pattern or star, a column for each variable; None if it can match nothing."""
        if isinstance(pattern, Star):
            return self._scan_star(pattern)
        if isinstance(pattern.p, Term):
            names = [pattern.p.lex] if pattern.p.type == URI and pattern.p.lex in VOCABULARY else []
        else:
            names = list(VOCABULARY)
        branches = [b for n in names if (b := self._branch(n, pattern)) is not None]
        if not branches:
            return None
        triples = self._together(branches)
        return self._matched(triples, {"s": pattern.s, "o": pattern.o} | ({"p": pattern.p} if isinstance(pattern.p, Var) else {}))

    @staticmethod
    def _together(branches: list[DataFrame]) -> DataFrame:
        """Union; objects become terms unless all are ids."""
        if len({dict(b.dtypes)["o"] for b in branches}) > 1:
            branches = [b.withColumn("o", decoded(F.col("o"))) if dict(b.dtypes)["o"] == "bigint" else b for b in branches]
        return reduce(DataFrame.union, branches)

    def rows(self, table: str) -> int:
        """Rows of a table, from the files' footers."""
        if table not in self._rows:
            self._rows[table] = self.table(table).count()
        return self._rows[table]

    def size(self, pattern: Pattern | Star) -> Size:
        if isinstance(pattern, Star):
            total = max(1, self.rows(VOCABULARY[pattern.patterns[0].p.lex].table))
            each = [self.size(p) for p in pattern.patterns]
            rows = float(total)
            for s in each:
                rows *= min(1.0, s.rows / total)
            values = {v: n for s in each for v, n in s.values.items()}
            return Size(max(rows, 1.0), {v: max(1.0, min(n, rows)) for v, n in values.items()})
        names = [pattern.p.lex] if isinstance(pattern.p, Term) else list(VOCABULARY)
        rows, subjects, objects = 0.0, 0.0, 0.0
        for n in names:
            if n not in VOCABULARY:
                continue
            p = VOCABULARY[n]
            total = self.rows(p.table)
            target = next((t for t, (name, _) in TABLES.items() if name == p.to), None)
            different = min(total, self.rows(target)) if target else max(1.0, total**0.5)
            if isinstance(pattern.s, Term):
                total = min(total, 1)
            rows += total / different if isinstance(pattern.o, Term) else total
            subjects, objects = subjects + total, objects + different
        values = {}
        for what, n in ((pattern.s, subjects), (pattern.p, len(names)), (pattern.o, objects)):
            if isinstance(what, Var):
                values[what.name] = max(1.0, min(float(n), rows))
        return Size(max(rows, 1.0), values)

    def decode(self, df: DataFrame, names: list[str]) -> DataFrame:
        return df.withColumns({n: decoded(F.col(n)) for n in names})

    def known(self, t: Term) -> bool:
        return True

    def vertices(self, pattern: Pattern) -> dict[str, list[DataFrame]]:
        """No vertex indexes here."""
        return {}

    def triples(self, names: list[str] | None = None) -> DataFrame:
        """(s, p, o) as term columns of some or all predicates."""
        tables: dict[str, list[str]] = {}
        for n in names or list(VOCABULARY):
            tables.setdefault(VOCABULARY[n].table, []).append(n)

        def rows(table: str, names: list[str]) -> DataFrame:
            """A table is read once, its rows named once."""
            objects = {n: decoded(_object(VOCABULARY[n])) if VOCABULARY[n].kind == "to" else _object(VOCABULARY[n]) for n in names}
            each = F.array(*[F.struct(term(F.lit(URI), F.lit(n)).alias("p"), o.alias("o")) for n, o in objects.items()])
            out = self.table(table).select(decoded(self._subject(table)).alias("s"), F.explode(each).alias("x"))
            # unions and arrays of expressions can lose the fields' names
            return out.select(F.col("s").cast(TERM).alias("s"), F.col("x.p").cast(TERM).alias("p"), F.col("x.o").cast(TERM).alias("o")).where(F.col("o").isNotNull())

        return reduce(DataFrame.union, [rows(t, ns) for t, ns in tables.items()])
