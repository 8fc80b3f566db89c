"""Table functions: user code that gives rows of terms for rows of terms.

A function takes a Term (or None) for each input and yields tuples of Terms.  It
runs as a Python UDTF under a lateral join, where the rows are, so nothing is
gathered; its terms need not be in any dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwell.terms import TERM, Term


def lateral(df: DataFrame, function: Callable, inputs: Sequence[Column], outputs: Sequence[str]) -> DataFrame:
    """df joined with what the function gives for each of its rows."""

    class Run:
        def eval(self, *args):
            given = [None if a is None else Term(a["type"], a["lex"], a["sub"]) for a in args]
            for row in function(*given):
                yield tuple(None if t is None else (t.type, t.lex, t.sub) for t in row)

    fields = ", ".join(f"`{n}` {TERM}" for n in outputs)
    run = F.udtf(Run, returnType=fields)
    named = [f"__in{k}" for k in range(len(inputs))]
    before = df.columns
    ready = df.select("*", *[c.alias(n) for c, n in zip(inputs, named)])
    out = ready.lateralJoin(run(*[F.col(n).outer() for n in named]))
    return out.select(*before, *outputs)
