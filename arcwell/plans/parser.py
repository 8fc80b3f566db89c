"""SPARQL SELECT subset: text to a tree of frozen dataclasses.

Accepted beyond the common grammar: missing dots between triples, `$x` and `?x`
variables, names with `_` and `-`, `:x` as the bare IRI x, and as extensions of
our own OPTIONAL, OFFSET, regex flags and `?a reaches ?b via <p>`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from arcwell.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, TYPE, Term, iri, literal

MODES = ("all", "distinct", "reduced", "count", "duplicates")


class ParseError(ValueError):
    """The text is no query of the subset; the message has the place."""


@dataclass(frozen=True)
class Var:
    """named is False for blank nodes, which SELECT * leaves out."""

    name: str
    named: bool = True


Node = Var | Term


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Node
    o: Node

    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for x in (self.s, self.p, self.o) if isinstance(x, Var)))


@dataclass(frozen=True)
class Star:
    """Patterns of one subject that a graph answers by one scan."""

    patterns: tuple[Pattern, ...]

    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for p in self.patterns for v in p.variables()))


@dataclass(frozen=True)
class Expr:
    """op with arguments; leaves are `var` (a name), `const` (a Term) and `null`."""

    op: str
    args: tuple = ()

    def variables(self) -> set[str]:
        if self.op in ("var", "bound"):
            return {self.args[0]}
        return {v for a in self.args if isinstance(a, Expr) for v in a.variables()}


@dataclass(frozen=True)
class TableFunction:
    name: str
    inputs: tuple[Node, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class Reach:
    """end is reached from start over one or more edges of the predicate."""

    start: Node
    end: Node
    predicate: Term


@dataclass(frozen=True)
class Group:
    patterns: tuple[Pattern, ...] = ()
    filters: tuple[Expr, ...] = ()
    unions: tuple[tuple[Group, ...], ...] = ()
    optionals: tuple[Group, ...] = ()
    functions: tuple[TableFunction, ...] = ()
    reaches: tuple[Reach, ...] = ()

    def variables(self) -> dict[str, bool]:
        """All variables in order of appearance; the value says whether named."""
        found: dict[str, bool] = {}
        for p in self.patterns:
            for x in (p.s, p.p, p.o):
                if isinstance(x, Var):
                    found.setdefault(x.name, x.named)
        for r in self.reaches:
            for x in (r.start, r.end):
                if isinstance(x, Var):
                    found.setdefault(x.name, x.named)
        for group in [*(g for u in self.unions for g in u), *self.optionals]:
            for name, named in group.variables().items():
                found.setdefault(name, named)
        for f in self.functions:
            for name in f.outputs:
                found.setdefault(name, True)
        return found


@dataclass(frozen=True)
class Query:
    where: Group
    projection: tuple[str, ...] | None = None
    mode: str = "all"
    order: tuple[tuple[str, bool], ...] = ()  # ("?x" name or "count", descending)
    limit: int | None = None
    offset: int | None = None
    prefixes: dict = field(default_factory=dict, compare=False)

    def output(self) -> tuple[str, ...]:
        """The projected variables; for `*` all named ones, by name."""
        if self.projection is not None:
            return self.projection
        return tuple(sorted(n for n, named in self.where.variables().items() if named))


_SPACE = re.compile(r"(?:\s+|#[^\n]*)*")
_IRI = re.compile(r"<((?:[^<>\s\"{}|^`\\]|\\.)*)>")
_VAR = re.compile(r"[?$]([0-9A-Za-z_][0-9A-Za-z_\-]*)")
_STRING = re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*)"""|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'', re.DOTALL)
_NUMBER = re.compile(r"[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)")
_NAME = re.compile(r"[0-9A-Za-z_][0-9A-Za-z_\-]*")
_QNAME = re.compile(r"([0-9A-Za-z_][0-9A-Za-z_\-]*)?:([0-9A-Za-z_][0-9A-Za-z_\-]*)?")
_BLANK = re.compile(r"_:([0-9A-Za-z_\-]+)")
_LANG = re.compile(r"@([0-9A-Za-z\-]+)")
_UNESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
#: Loosest first; each level's operators associate to the left.
_LEVELS = (("||",), ("&&",), ("!=", "<=", ">=", "=", "<", ">"), ("+", "-"), ("*", "/"))
_CALLS = {"str": (1, 1), "lang": (1, 1), "langmatches": (2, 2), "datatype": (1, 1), "sameterm": (2, 2), "isiri": (1, 1), "isuri": (1, 1), "isblank": (1, 1), "isliteral": (1, 1), "regex": (2, 3)}
#: Call a registered table function: filter <this>("name", "number of inputs", inputs..., ?outputs...).
TABLE_FUNCTION = "urn:arcwell:tableFunction"


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.fresh = text, 0, 0
        self.prefixes: dict[str, str] = {}
        self._skip()

    # scanning

    def _skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def fail(self, wanted: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise ParseError(f"line {line}: {wanted} expected at {self.text[self.at : self.at + 20]!r}")

    def take(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            self._skip()
        return m

    def symbol(self, *symbols: str) -> str | None:
        for s in symbols:
            if self.text.startswith(s, self.at):
                self.at += len(s)
                self._skip()
                return s
        return None

    def need(self, symbol: str) -> None:
        if not self.symbol(symbol):
            self.fail(repr(symbol))

    def word(self, *words: str) -> str | None:
        m = _NAME.match(self.text, self.at)
        if m and m[0].lower() in words and not self.text.startswith(":", m.end()):
            self.at = m.end()
            self._skip()
            return m[0].lower()
        return None

    def blank(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}", False)

    # terms

    def iri(self) -> Term | None:
        if m := self.take(_IRI):
            return iri(unescape(m[1]))
        at = self.at
        if m := self.take(_QNAME):
            prefix, name = m[1] or "", m[2] or ""
            if prefix in self.prefixes:
                return iri(self.prefixes[prefix] + name)
            if not prefix:
                return iri(name)
            self.at = at
            self.fail(f"known prefix instead of {prefix!r}")
        return None

    def literal(self) -> Term | None:
        if m := self.take(_STRING):
            lex = unescape(next(g for g in m.groups() if g is not None))
            if lang := self.take(_LANG):
                return literal(lex, lang=lang[1])
            if self.symbol("^^"):
                return literal(lex, datatype=(self.iri() or self.fail("datatype")).lex)
            return literal(lex)
        if word := self.word("true", "false"):
            return Term(BOOLEAN, word)
        if m := self.take(_NUMBER):
            return Term(DOUBLE if "e" in m[0].lower() else DECIMAL if "." in m[0] else INTEGER, m[0])
        return None

    def variable(self) -> Var | None:
        return Var(m[1]) if (m := self.take(_VAR)) else None

    # query

    def query(self) -> Query:
        while self.word("prefix"):
            m = self.take(re.compile(r"([0-9A-Za-z_\-]*)\s*:")) or self.fail("prefix name")
            place = self.take(_IRI) or self.fail("IRI")
            self.prefixes[m[1]] = place[1]
        if not self.word("select"):
            self.fail("SELECT")
        mode = self.word(*MODES[1:]) or "all"
        projection: tuple[str, ...] | None = None
        if not self.symbol("*"):
            names = []
            while v := self.variable():
                names.append(v.name)
                self.symbol(",")
            if not names:
                self.fail("projection")
            projection = tuple(dict.fromkeys(names))
        if self.word("from"):
            self.fail("no FROM clause")
        self.word("where")
        query = Query(self.group(), projection, mode)
        order: list[tuple[str, bool]] = []
        if self.word("order"):
            if not self.word("by"):
                self.fail("BY")
            while key := self.order_key():
                order.append(key)
            if not order:
                self.fail("order key")
        limits: dict[str, int] = {}
        while kind := self.word("limit", "offset"):
            m = self.take(re.compile(r"\d+")) or self.fail("number")
            limits[kind] = int(m[0])
        if limits.get("limit") == 0:
            self.fail("positive LIMIT")
        if self.at < len(self.text):
            self.fail("end of query")
        return replace(query, order=tuple(order), prefixes=dict(self.prefixes), **limits)

    def order_key(self) -> tuple[str, bool] | None:
        if way := self.word("asc", "desc"):
            self.need("(")
            v = self.variable()
            name = v.name if v else self.word("count") or self.fail("variable")
            self.need(")")
            return (f"?{name}" if v else "count", way == "desc")
        if v := self.variable():
            return f"?{v.name}", False
        return ("count", False) if self.word("count") else None

    def group(self) -> Group:
        self.need("{")
        patterns: list[Pattern] = []
        out = Group()
        while not self.symbol("}"):
            if self.symbol("."):
                continue
            if self.text.startswith("{", self.at):
                branches = [self.group()]
                while self.word("union"):
                    branches.append(self.group())
                out = merged(out, branches[0]) if len(branches) == 1 else replace(out, unions=(*out.unions, tuple(branches)))
            elif self.word("optional"):
                out = replace(out, optionals=(*out.optionals, self.group()))
            elif self.word("filter"):
                out = self.filter(out)
            else:
                out = self.triples(patterns, out)
        return replace(out, patterns=(*patterns, *out.patterns))

    def triples(self, patterns: list[Pattern], out: Group) -> Group:
        before = len(patterns)
        subject = self.node(patterns)
        if subject is None:
            self.fail("triple pattern")
        if self.word("reaches"):
            end = self.node(patterns) or self.fail("node")
            if not self.word("via"):
                self.fail("VIA")
            return replace(out, reaches=(*out.reaches, Reach(subject, end, self.iri() or self.fail("IRI"))))
        if len(patterns) > before and (self.text.startswith((".", "}"), self.at)):
            return out  # a subject [ ... ] that stands alone
        self.predicates(subject, patterns)
        return out

    def predicates(self, subject: Node, patterns: list[Pattern]) -> None:
        while True:
            predicate = self.predicate()
            while True:
                value = self.node(patterns) or self.fail("object")
                patterns.append(Pattern(subject, predicate, value))
                if not self.symbol(","):
                    break
            if not self.symbol(";"):
                return
            if self.text.startswith((".", "}", "]"), self.at):
                return

    def predicate(self) -> Node:
        if v := self.variable():
            return v
        if self.word("a"):
            return iri(TYPE)
        if self.symbol("["):
            self.need("]")
            return self.blank()
        return self.iri() or self.fail("predicate")

    def node(self, patterns: list[Pattern]) -> Node | None:
        if v := self.variable():
            return v
        if m := self.take(_BLANK):
            return Var(f"_n{m[1]}", False)
        if self.symbol("["):
            v = self.blank()
            if not self.symbol("]"):
                self.predicates(v, patterns)
                self.need("]")
            return v
        return self.literal() or self.iri()

    # filters

    def filter(self, out: Group) -> Group:
        at = self.at
        if (called := self.take(_IRI)) and called[1] == TABLE_FUNCTION:
            return replace(out, functions=(*out.functions, self.table_function()))
        self.at = at
        if self.symbol("(") and (start := self.variable() or self.literal() or self.iri()) and self.word("reaches"):
            end = self.variable() or self.literal() or self.iri() or self.fail("node")
            if not self.word("via"):
                self.fail("VIA")
            found = Reach(start, end, self.iri() or self.fail("IRI"))
            self.need(")")
            return replace(out, reaches=(*out.reaches, found))
        self.at = at
        whole = self.expression() if self.symbol("(") else None
        if whole is not None:
            self.need(")")
        else:
            whole = self.primary()
        return replace(out, filters=(*out.filters, *conjuncts(whole)))

    def table_function(self) -> TableFunction:
        self.need("(")
        args: list[Node] = []
        while not self.symbol(")"):
            args.append(self.variable() or self.literal() or self.iri() or self.fail("argument"))
            self.symbol(",")
        if len(args) < 3 or not isinstance(args[0], Term) or not isinstance(args[1], Term):
            self.fail("name and number of inputs")
        n = int(args[1].lex)
        outputs = args[2 + n :]
        if not outputs or not all(isinstance(o, Var) for o in outputs):
            self.fail("output variables")
        return TableFunction(args[0].lex, tuple(args[2 : 2 + n]), tuple(o.name for o in outputs))

    def expression(self, level: int = 0) -> Expr:
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while op := self.symbol(*_LEVELS[level]):
            left = Expr(op, (left, self.expression(level + 1)))
        return left

    def unary(self) -> Expr:
        if not self.text.startswith("!=", self.at) and self.symbol("!"):
            return Expr("!", (self.unary(),))
        if self.symbol("-"):
            return Expr("neg", (self.unary(),))
        if self.symbol("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> Expr:
        if self.symbol("("):
            inner = self.expression()
            self.need(")")
            return inner
        if v := self.variable():
            return Expr("var", (v.name,))
        if self.word("bound"):
            self.need("(")
            v = self.variable() or self.fail("variable")
            self.need(")")
            return Expr("bound", (v.name,))
        if name := self.word(*_CALLS):
            args = self.arguments()
            low, high = _CALLS[name]
            if not low <= len(args) <= high:
                self.fail(f"{low} arguments of {name}")
            return Expr({"isuri": "isiri"}.get(name, name), args)
        if self.word("in"):
            args = self.arguments()
            return Expr("in", args) if args else self.fail("operand of in")
        found = self.literal() or self.iri() or self.fail("expression")
        if found.type == 0 and self.text.startswith("(", self.at):
            return Expr("call", (found.lex, *self.arguments()))
        return Expr("const", (found,))

    def arguments(self) -> tuple[Expr, ...]:
        self.need("(")
        args = []
        while not self.symbol(")"):
            args.append(self.expression())
            if not self.symbol(",") and not self.text.startswith(")", self.at):
                self.fail("')'")
        return tuple(args)


def conjuncts(e: Expr) -> Iterator[Expr]:
    """Top-level operands of &&."""
    if e.op == "&&":
        for a in e.args:
            yield from conjuncts(a)
    else:
        yield e


def merged(a: Group, b: Group) -> Group:
    """One group with the parts of both."""
    return Group(*(getattr(a, k) + getattr(b, k) for k in ("patterns", "filters", "unions", "optionals", "functions", "reaches")))


def parse(text: str) -> Query:
    return _Parser(text).query()


def constants(group: Group) -> Iterator[Term]:
    """Terms that a group names in its patterns, ways and filters."""
    for p in group.patterns:
        yield from (x for x in (p.s, p.p, p.o) if isinstance(x, Term))
    for r in group.reaches:
        yield from (x for x in (r.start, r.predicate, r.end) if isinstance(x, Term))
    for e in group.filters:
        yield from _named_in(e)
    for g in [*(g for u in group.unions for g in u), *group.optionals]:
        yield from constants(g)


def _named_in(e: Expr) -> Iterator[Term]:
    for x in e.args:
        if isinstance(x, Term):
            yield x
        elif isinstance(x, Expr):
            yield from _named_in(x)
