"""Terms: what subjects, predicates and objects are.

A term is identified by its type, its lexical form and, for language-tagged and
custom-typed literals, the tag or datatype.  Values are never parsed at rest, so
"1" and "01" as integers are two terms.  A term column is a struct of the three.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Type ids and the names of the built-in datatypes
URI, LITERAL, LANGUAGE, CUSTOM, STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN = range(9)
XSD = "http://www.w3.org/2001/XMLSchema#"
BUILTIN = {STRING: "string", INTEGER: "integer", DECIMAL: "decimal", DOUBLE: "double", BOOLEAN: "boolean"}
NUMERIC = (INTEGER, DECIMAL, DOUBLE)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE = RDF + "type"

TERM = "struct<type:int,lex:string,sub:string>"


@dataclass(frozen=True)
class Term:
    type: int
    lex: str
    sub: str | None = None

    @property
    def blank(self) -> bool:
        return self.type == URI and self.lex.startswith("_:")

    def column(self) -> Column:
        return term(F.lit(self.type), F.lit(self.lex), F.lit(self.sub))


def iri(text: str) -> Term:
    return Term(URI, text)


def literal(lex: str, lang: str | None = None, datatype: str | None = None) -> Term:
    """A literal; the five built-in datatypes get types of their own."""
    if lang is not None:
        return Term(LANGUAGE, lex, lang)
    if datatype is None:
        return Term(LITERAL, lex)
    for number, name in BUILTIN.items():
        if datatype == XSD + name:
            return Term(number, lex)
    return Term(CUSTOM, lex, datatype)


def term(kind: Column, lex: Column, sub: Column | None = None) -> Column:
    return F.struct(kind.cast("int").alias("type"), lex.cast("string").alias("lex"), (F.lit(None) if sub is None else sub).cast("string").alias("sub"))


def iri_column(lex: Column) -> Column:
    return F.when(lex.isNotNull(), term(F.lit(URI), lex))


def literal_column(lex: Column, kind: int = LITERAL, sub: Column | None = None) -> Column:
    return F.when(lex.isNotNull(), term(F.lit(kind), lex, sub))


_ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_MUST_ESCAPE = re.compile(r'[\t\n\r"\\]')


def render(t: Term | None) -> str:
    """One term in N-Triples notation; NULL for none."""
    if t is None:
        return "NULL"
    if t.type == URI:
        return t.lex if t.blank else "<" + t.lex.replace("\\", "\\\\").replace(">", "\\>") + ">"
    text = '"' + _MUST_ESCAPE.sub(lambda m: _ESCAPES[m[0]], t.lex) + '"'
    if t.type == LANGUAGE:
        return f"{text}@{t.sub}"
    if t.type == CUSTOM:
        return f"{text}^^<{t.sub}>"
    return text if t.type == LITERAL else f"{text}^^<{XSD}{BUILTIN[t.type]}>"


def rendered(t: Column) -> Column:
    """The same as a column expression."""
    lex = t["lex"]
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        lex = F.replace(lex, F.lit(raw), F.lit(escaped))
    quoted = F.concat(F.lit('"'), lex, F.lit('"'))
    uri = F.replace(F.replace(t["lex"], F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\>"))
    out = F.when(t.isNull(), F.lit("NULL")).when(is_blank(t), t["lex"]).when(t["type"] == URI, F.concat(F.lit("<"), uri, F.lit(">")))
    out = out.when(t["type"] == LANGUAGE, F.concat(quoted, F.lit("@"), t["sub"])).when(t["type"] == CUSTOM, F.concat(quoted, F.lit("^^<"), t["sub"], F.lit(">")))
    for number, name in BUILTIN.items():
        out = out.when(t["type"] == number, F.concat(quoted, F.lit(f"^^<{XSD}{name}>")))
    return out.otherwise(quoted)


def is_blank(t: Column) -> Column:
    return (t["type"] == URI) & t["lex"].startswith("_:")


def hash_part(text: str, n: int) -> int:
    """pmod(xxhash64(text), n) as Spark has it."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % n
