"""Turtle and N-Triples: a tokenizer, a pull parser that recovers, readers and a writer.

N-Triples files split at lines, so they are read as text and parsed partition by
partition, each line by itself, so a bad one costs no other.  Turtle files carry prefixes and blank nodes across lines and are parsed
a whole file in a task, many files side by side.  Bad statements become rows of
`error`, the rest of their line is skipped, and reading goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, TERM, TYPE, Term, iri, literal, rendered

TRIPLES = f"s {TERM}, p {TERM}, o {TERM}, error string"

_SPACE = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)*")
_IRI = re.compile(r"<((?:[^>\\\n]|\\.)*)>")
_LONG = re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*)"""|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*)\'\'\'', re.DOTALL)
_SHORT = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'')
_LANG = re.compile(r"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)")
_DOUBLE = re.compile(r"[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+")
_DECIMAL = re.compile(r"[+-]?\d*\.\d+")
_INTEGER = re.compile(r"[+-]?\d+")
_BLANK = re.compile(r"_:([\w][\w\-]*(?:\.[\w\-]+)*)")
_QNAME = re.compile(r"([\w][\w\-]*(?:\.[\w\-]+)*)?:((?:[\w:%\-]|\\.)(?:[\w:%\-.]|\\.)*(?<!\.)|)")
_WORD = re.compile(r"@?[A-Za-z]+")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
_SCHEME = "://"


class TurtleError(ValueError):
    pass


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        code = int(m[1] or m[2], 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            raise TurtleError("no such character")
        return chr(code)
    if m[3] in _PLAIN:
        return _PLAIN[m[3]]
    if m[3].isalnum():
        raise TurtleError(f"unknown escape \\{m[3]}")
    return m[3]


def unescape(text: str) -> str:
    return _ESCAPE.sub(_unescape, text) if "\\" in text else text


class Parser:
    """Pull parser over one text; iterate for triples, `errors` has (line, message) of skipped statements."""

    def __init__(self, text: str, scope: str = ""):
        self.text, self.at, self.scope, self.n = text, 0, scope, 0
        self.base, self.prefixes = "", {}
        self.out: list[tuple[Term, Term, Term]] = []
        self.errors: list[tuple[int, str]] = []

    def _skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def _take(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        return m

    def _symbol(self, s: str) -> bool:
        self._skip()
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def _need(self, s: str) -> None:
        if not self._symbol(s):
            raise TurtleError(f"{s!r} expected at {self.text[self.at : self.at + 20]!r}")

    def __iter__(self) -> Iterator[tuple[Term, Term, Term]]:
        while True:
            self._skip()
            if self.at >= len(self.text):
                return
            self.out = []
            began = self.at
            try:
                self._statement()
            except TurtleError as e:
                self.errors.append((self.text.count("\n", 0, began) + 1, str(e)))
                end = self.text.find("\n", max(self.at, began))
                self.at = len(self.text) if end < 0 else end + 1
                self.out = []
            yield from self.out

    def _statement(self) -> None:
        at = self.at
        word = self._take(_WORD)
        kind = word[0].lower() if word else ""
        if kind in ("@prefix", "prefix", "@base", "base") and not self.text.startswith(":", self.at):
            self._skip()
            if kind.endswith("prefix"):
                m = self._take(re.compile(r"([\w][\w\-.]*)?:"))
                if not m:
                    raise TurtleError("prefix name expected")
                self._skip()
                self.prefixes[m[1] or ""] = self._iri()
            else:
                self.base = self._iri()
            if kind[0] == "@":
                self._need(".")
            return
        self.at = at
        lone = self.text.startswith("[", self.at)
        subject = self._subject()
        self._skip()
        if not (lone and self.text.startswith(".", self.at)):
            self._predicates(subject)
        self._need(".")

    def _iri(self) -> str:
        m = self._take(_IRI)
        if not m:
            raise TurtleError(f"IRI expected at {self.text[self.at : self.at + 20]!r}")
        found = unescape(m[1])
        return found if _SCHEME in found[:10] or ":" in found.split("/")[0] or not self.base else self.base + found

    def _name(self) -> Term | None:
        """An IRI or qualified name."""
        if self.text.startswith("<", self.at):
            return iri(self._iri())
        at = self.at
        if m := self._take(_QNAME):
            if (m[1] or "") not in self.prefixes:
                self.at = at
                raise TurtleError(f"unknown prefix {m[1] or ''!r}")
            return iri(self.prefixes[m[1] or ""] + re.sub(r"\\(.)", r"\1", m[2]))
        return None

    def _fresh(self) -> Term:
        self.n += 1
        return iri(f"_:_{self.scope}{self.n}")

    def _node(self) -> Term | None:
        """What may be subject or object: a name, a blank node, a list."""
        self._skip()
        if m := self._take(_BLANK):
            return iri(f"_:{self.scope}{'x' * bool(self.scope)}{m[1]}")
        if self._symbol("["):
            found = self._fresh()
            if not self._symbol("]"):
                self._predicates(found)
                self._need("]")
            return found
        if self._symbol("("):
            items = []
            while not self._symbol(")"):
                items.append(self._object())
            found = iri(RDF + "nil")
            for item in reversed(items):
                cell = self._fresh()
                self.out += [(cell, iri(RDF + "first"), item), (cell, iri(RDF + "rest"), found)]
                found = cell
            return found
        return self._name()

    def _subject(self) -> Term:
        found = self._node()
        if found is None:
            raise TurtleError(f"subject expected at {self.text[self.at : self.at + 20]!r}")
        return found

    def _predicates(self, subject: Term) -> None:
        while True:
            self._skip()
            at = self.at
            if (w := self._take(_WORD)) and w[0] == "a" and not self.text.startswith(":", self.at):
                predicate = iri(TYPE)
            else:
                self.at = at
                predicate = self._name()
                if predicate is None:
                    raise TurtleError(f"predicate expected at {self.text[at : at + 20]!r}")
            while True:
                self.out.append((subject, predicate, self._object()))
                if not self._symbol(","):
                    break
            if not self._symbol(";"):
                return
            while self._symbol(";"):
                pass
            self._skip()
            if self.text[self.at : self.at + 1] in (".", "]", ""):
                return

    def _object(self) -> Term:
        self._skip()
        m = self._take(_LONG) or self._take(_SHORT)
        if m:
            lex = unescape(m[1] if m[1] is not None else m[2])
            if lang := self._take(_LANG):
                return literal(lex, lang=lang[1])
            if self._symbol("^^"):
                kind = self._name()
                if kind is None:
                    raise TurtleError("datatype expected")
                return literal(lex, datatype=kind.lex)
            return literal(lex)
        for pattern, kind in ((_DOUBLE, DOUBLE), (_DECIMAL, DECIMAL), (_INTEGER, INTEGER)):
            if m := self._take(pattern):
                return Term(kind, m[0])
        at = self.at
        if (w := self._take(_WORD)) and w[0] in ("true", "false") and not self.text.startswith(":", self.at):
            return Term(BOOLEAN, w[0])
        self.at = at
        found = self._node()
        if found is None:
            raise TurtleError(f"object expected at {self.text[at : at + 20]!r}")
        return found


def _row(t: Term) -> dict:
    return {"type": t.type, "lex": t.lex, "sub": t.sub}


def parse(text: str, scope: str = "") -> tuple[list[tuple[Term, Term, Term]], list[tuple[int, str]]]:
    """All triples and errors of a text; scope tells its blank nodes from another's."""
    p = Parser(text, scope)
    return list(p), p.errors


def _frame(parsers: Iterator[Parser]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for p in parsers:
        for s, pred, o in p:
            rows.append((_row(s), _row(pred), _row(o), None))
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=["s", "p", "o", "error"])
                rows = []
        rows += [(None, None, None, f"{line}: {message}") for line, message in p.errors]
    if rows:
        yield pd.DataFrame(rows, columns=["s", "p", "o", "error"])


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """TRIPLES of N-Triples files, one statement a line; blank nodes keep their names over all files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            rows: list[tuple] = []
            for text, file in zip(lines["value"], lines["file"]):
                parser = Parser(text)
                rows += [(_row(s), _row(p), _row(o), None) for s, p, o in parser]
                rows += [(None, None, None, f"{file}: {message} in {text[:80]!r}") for _, message in parser.errors]
            if rows:
                yield pd.DataFrame(rows, columns=["s", "p", "o", "error"])

    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).mapInPandas(run, TRIPLES)


def read_turtle(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """TRIPLES of Turtle files, each parsed as a whole; blank nodes are told apart by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            yield from _frame(Parser(text, f"f{scope}") for scope, text in zip(files["scope"], files["value"]))

    files = spark.read.text(paths, wholetext=True).select("value", F.substring(F.sha2(F.col("_metadata.file_path"), 256), 1, 32).alias("scope"))
    return files.mapInPandas(run, TRIPLES)


def ntriples(triples: DataFrame) -> DataFrame:
    """(s, p, o) term columns as lines of N-Triples, column `value`."""
    return triples.select(F.concat_ws(" ", rendered(F.col("s")), rendered(F.col("p")), rendered(F.col("o")), F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def abbreviated(triples: DataFrame) -> DataFrame:
    """Turtle, a line for each subject with `;` and `,`; a subject's triples are gathered, so use N-Triples where one may have very many."""
    objects = triples.groupBy("s", "p").agg(F.array_sort(F.collect_list(rendered(F.col("o")))).alias("o"))
    lines = objects.select("s", F.concat(rendered(F.col("p")), F.lit(" "), F.array_join("o", ", ")).alias("po"))
    return lines.groupBy("s").agg(F.array_sort(F.collect_list("po")).alias("po")).select(F.concat(rendered(F.col("s")), F.lit(" "), F.array_join("po", " ; "), F.lit(" .")).alias("value"))
