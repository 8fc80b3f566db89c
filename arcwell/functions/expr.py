"""FILTER expressions as columns.

Comparisons are two-valued: a NULL operand makes them false, and `!` of that true.
Two known terms are equal if type, lexical form and tag or datatype are; where one
side is computed (str, lang, arithmetic, ...) the texts are compared.  `<` and the
like compare texts; in typed mode two numeric literals compare as numbers.
Arithmetic reads the numeric beginning of a text, 0 if there is none, and writes
six significant digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcwell.plans.parser import Expr
from arcwell.terms import BUILTIN, CUSTOM, LANGUAGE, LITERAL, NUMERIC, URI, XSD, Term, is_blank, literal_column


@dataclass(frozen=True)
class Value:
    """A term column, or a boolean column; known if it stands for a term of the graph."""

    column: Column
    known: bool = False
    boolean: bool = False

    def text(self) -> Column:
        return F.when(self.column, "true").otherwise("false") if self.boolean else self.column["lex"]

    def kind(self) -> Column:
        return F.lit(8) if self.boolean else self.column["type"]

    def term(self) -> Column:
        return literal_column(self.text(), 8) if self.boolean else self.column

    def truth(self) -> Column:
        """Effective boolean value: of what is no boolean, whether its text is `true`."""
        return F.coalesce(self.column if self.boolean else self.column["lex"] == "true", F.lit(False))


def atof(text: Column) -> Column:
    """Number at the beginning of a text, 0 if there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(text.isNotNull(), F.coalesce(head.try_cast("double"), F.lit(0.0)))


def general_format(x: Column) -> Column:
    """A double with six significant digits, as C's %g writes it."""
    # as texts: comparing with infinite constants breaks the compilation of generated code
    shown = x.cast("string")
    parts = F.split(F.format_string("%.5e", x), "e")
    mantissa, exponent = parts[0], parts[1].cast("int")

    def bare(text: Column) -> Column:
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)

    fixed = bare(F.format_string("%.5e", x).cast("decimal(38,12)").cast("string"))
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    wide = F.concat(bare(mantissa), F.lit("e"), F.when(F.abs(exponent) >= 100, F.concat(F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))).otherwise(power))
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "nan")
        .when(shown == "Infinity", "inf")
        .when(shown == "-Infinity", "-inf")
        .when(x == 0, "0")
        .when((exponent >= -4) & (exponent < 6), fixed)
        .otherwise(wide)
    )


def _divide(a: Column, b: Column) -> Column:
    """IEEE division, also where ANSI mode would raise."""
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))


def datatype(t: Column) -> Column:
    out = F.when(t["type"] == CUSTOM, t["sub"]).when(t["type"] == URI, XSD + "URI")
    for number, name in BUILTIN.items():
        out = out.when(t["type"] == number, XSD + name)
    return out.otherwise(XSD + "string")


class Compiler:
    """Expressions over rows whose variables are term columns.

    variables maps a name to its column; what it lacks is unbound, NULL.
    functions are registered by IRI and take and return texts.  known says whether
    a constant is a term of the graph.
    """

    def __init__(self, variables: dict[str, Column], typed: bool = False, functions: dict[str, Callable[..., Column]] | None = None, known: Callable[[Term], bool] = lambda t: True):
        self.variables, self.typed, self.functions, self.known = variables, typed, functions or {}, known

    def condition(self, e: Expr) -> Column:
        return self.value(e).truth()

    def value(self, e: Expr) -> Value:
        return getattr(self, "_" + _NAMES.get(e.op, e.op))(e)

    def _null(self, e: Expr | None = None) -> Value:
        return Value(F.lit(None).cast("struct<type:int,lex:string,sub:string>"), True)

    def _var(self, e: Expr) -> Value:
        return Value(self.variables[e.args[0]], True) if e.args[0] in self.variables else self._null()

    def _const(self, e: Expr) -> Value:
        return Value(e.args[0].column(), self.known(e.args[0]))

    def _logic(self, e: Expr) -> Value:
        a, b = (self.condition(x) for x in e.args)
        return Value(a & b if e.op == "&&" else a | b, boolean=True)

    def _not(self, e: Expr) -> Value:
        return Value(~self.condition(e.args[0]), boolean=True)

    def _same(self, a: Value, b: Value) -> Column:
        if a.boolean or b.boolean or not (a.known and b.known):
            same = a.text() == b.text()
        else:
            x, y = a.column, b.column
            same = (x["lex"] == y["lex"]) & (x["type"] == y["type"]) & x["sub"].eqNullSafe(y["sub"])
        return F.coalesce(same, F.lit(False))

    def _equal(self, e: Expr) -> Value:
        a, b = (self.value(x) for x in e.args)
        same = self._same(a, b)
        if e.op == "=":
            return Value(same, boolean=True)
        return Value(~same & a.text().isNotNull() & b.text().isNotNull(), boolean=True)

    def _order(self, e: Expr) -> Value:
        a, b = (self.value(x) for x in e.args)
        ways = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        out = ways[e.op](a.text(), b.text())
        if self.typed:
            numeric = a.kind().isin(*NUMERIC) & b.kind().isin(*NUMERIC)
            out = F.when(numeric, ways[e.op](a.text().try_cast("double"), b.text().try_cast("double"))).otherwise(out)
        return Value(F.coalesce(out, F.lit(False)), boolean=True)

    def _number(self, e: Expr) -> Value:
        a, b = (atof(self.value(x).text()) for x in e.args)
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: _divide(a, b)}[e.op]()
        return Value(literal_column(general_format(out)))

    def _neg(self, e: Expr) -> Value:
        return Value(literal_column(general_format(-atof(self.value(e.args[0]).text()))))

    def _str(self, e: Expr) -> Value:
        return Value(literal_column(self.value(e.args[0]).text()))

    def _lang(self, e: Expr) -> Value:
        t = self.value(e.args[0]).term()
        return Value(F.when(t.isNotNull(), literal_column(F.when(t["type"] == LANGUAGE, t["sub"]).otherwise(""))))

    def _langmatches(self, e: Expr) -> Value:
        t, tag = (self.value(x) for x in e.args)
        t = t.term()
        return Value(F.coalesce((t["type"] == LANGUAGE) & (t["sub"] == tag.text()), F.lit(False)), boolean=True)

    def _datatype(self, e: Expr) -> Value:
        t = self.value(e.args[0]).term()
        return Value(F.when(t.isNotNull(), literal_column(datatype(t), LITERAL)))

    def _bound(self, e: Expr) -> Value:
        return Value(self._var(e).column.isNotNull(), boolean=True)

    def _sameterm(self, e: Expr) -> Value:
        x, y = (self.value(a).term() for a in e.args)
        return Value(F.coalesce((x["lex"] == y["lex"]) & (x["type"] == y["type"]) & x["sub"].eqNullSafe(y["sub"]), F.lit(False)), boolean=True)

    def _kind(self, e: Expr) -> Value:
        t = self.value(e.args[0]).term()
        out = {"isiri": lambda: t["type"] == URI, "isblank": lambda: is_blank(t), "isliteral": lambda: t["type"] != URI}[e.op]()
        return Value(F.coalesce(out, F.lit(False)), boolean=True)

    def _regex(self, e: Expr) -> Value:
        """Match of the whole text; a pattern that is not constant, or not valid, matches nothing; flag i is an extension."""
        pattern = e.args[1]
        flags = e.args[2].args[0].lex if len(e.args) > 2 and e.args[2].op == "const" else ""
        if pattern.op != "const" or not _valid(pattern.args[0].lex):
            return Value(F.lit(False), boolean=True)
        whole = ("(?i)" if "i" in flags else "") + rf"\A(?:{pattern.args[0].lex})\z"
        return Value(F.coalesce(self.value(e.args[0]).text().rlike(whole), F.lit(False)), boolean=True)

    def _in(self, e: Expr) -> Value:
        found = self.value(e.args[0])
        out = F.lit(False)
        for x in e.args[1:]:
            out = out | self._same(found, self.value(x))
        return Value(out, boolean=True)

    def _call(self, e: Expr) -> Value:
        """A registered function over texts; an unknown one is NULL."""
        name, *args = e.args
        if name not in self.functions:
            return Value(self._null().column)
        return Value(literal_column(self.functions[name](*[self.value(a).text() for a in args])))


def _valid(pattern: str) -> bool:
    """Whether the JVM's regular expressions take the pattern."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


_NAMES = {"&&": "logic", "||": "logic", "!": "not", "=": "equal", "!=": "equal"} | dict.fromkeys(("<", "<=", ">", ">="), "order") | dict.fromkeys("+-*/", "number") | dict.fromkeys(("isiri", "isblank", "isliteral"), "kind")
