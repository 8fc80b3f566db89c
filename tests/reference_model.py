"""Nested-loop evaluator over small graphs, to compare plans with."""

from __future__ import annotations

from collections import Counter

from arcwell.plans.parser import Group, Var, parse


def _bind(row: dict, what, value):
    if isinstance(what, Var):
        if what.name in row:
            return row if row[what.name] == value else None
        return row | {what.name: value}
    return row if what == value else None


def _truth(e, row) -> bool:
    if e.op == "&&":
        return _truth(e.args[0], row) and _truth(e.args[1], row)
    if e.op == "||":
        return _truth(e.args[0], row) or _truth(e.args[1], row)
    if e.op == "!":
        return not _truth(e.args[0], row)
    if e.op == "bound":
        return row.get(e.args[0]) is not None
    a, b = (row.get(x.args[0]) if x.op == "var" else x.args[0] for x in e.args)
    if a is None or b is None:
        return False
    return {"=": a == b, "!=": a != b, "<": a.lex < b.lex, "<=": a.lex <= b.lex, ">": a.lex > b.lex, ">=": a.lex >= b.lex}[e.op]


def solve(group: Group, triples) -> list[dict]:
    rows = [{}]
    for p in group.patterns:
        grown = []
        for row in rows:
            for s, q, o in triples:
                r = _bind(row, p.s, s)
                r = r if r is None else _bind(r, p.p, q)
                r = r if r is None else _bind(r, p.o, o)
                if r is not None:
                    grown.append(r)
        rows = grown
    for branches in group.unions:
        found = [r for b in branches for r in solve(b, triples)]
        rows = [a | b for a in rows for b in found if all(a[k] == b[k] for k in a.keys() & b.keys())]
    return [r for r in rows if all(_truth(e, r) for e in group.filters)]


def answer(text: str, triples) -> Counter:
    q = parse(text)
    names = q.output()
    rows = Counter(tuple(r.get(n) for n in names) for r in solve(q.where, sorted(set(triples), key=repr)))
    out: Counter = Counter()
    for row, n in rows.items():
        lex = tuple(None if t is None else t.lex for t in row)
        if q.mode in ("count", "duplicates"):
            out[(*lex, n)] += q.mode == "count" or n > 1
        else:
            out[lex] += 1 if q.mode in ("distinct", "reduced") else n
    return +out
