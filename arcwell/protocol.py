"""A line protocol over a store, for a client on the other side of a pipe.

Each request is one line.  A query answers `ok`, a header, a line for each row with
its cells escaped and between spaces, and `\\.`; an error answers `error` and a
message.  Other requests: `explain <query>`, `insert data { ... }`, `commit`,
`rollback`, `exit`.  Rows are streamed from the executors partition by partition,
so the driver never holds a whole result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from arcwell.store import Store
from arcwell.terms import Term, render


def escaped(cell: str) -> str:
    """Backslash, space and line end behind a backslash."""
    return cell.replace("\\", "\\\\").replace("\n", "\\n").replace(" ", "\\ ")


def answer(store: Store, line: str) -> Iterator[str]:
    """The lines of one request's answer."""
    request = line.strip()
    word = request.split(None, 1)[0].lower() if request else ""
    try:
        if word == "explain":
            lines = store.explain(request.split(None, 1)[1]).split("\n")
            yield from ("ok", "plan", *map(escaped, lines), "\\.")
        elif word == "insert":
            store.insert(request)
            yield from ("ok", "\\.")
        elif word in ("commit", "rollback"):
            getattr(store, word)()
            yield from ("ok", "\\.")
        else:
            df = store.query_terms(request)
            rows = df.toLocalIterator()
            first = next(rows, None)
            yield from ("ok", " ".join(df.columns))
            while first is not None:
                yield " ".join(escaped(render(None if c is None else Term(*c)) if c is None or isinstance(c, tuple) else str(c)) for c in first)
                first = next(rows, None)
            yield "\\."
    except Exception as e:  # noqa: BLE001  the client gets every failure as an answer
        yield from ("error", escaped(str(e).split("\n")[0]))


def serve(store: Store, requests: TextIO, answers: TextIO) -> None:
    """Answers until `exit` or the end of the requests."""
    for line in requests:
        if line.strip().lower() == "exit":
            return
        for out in answer(store, line):
            answers.write(out + "\n")
        answers.flush()
