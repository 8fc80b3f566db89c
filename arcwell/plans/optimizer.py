"""Order of joins, and which slots may be counted away.

Catalyst's own reordering needs table statistics and is off by default, so
patterns are ordered here: exhaustively over connected sets up to EXACT patterns,
greedily beyond, by the sum of the sizes of intermediate results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from arcwell.plans.parser import Group, Pattern, Query, Star, Var

EXACT = 10


@dataclass(frozen=True)
class Size:
    """Estimated rows, and different values of each variable."""

    rows: float
    values: dict[str, float]

    def joined(self, other: Size) -> Size:
        rows = self.rows * other.rows
        for v in self.values.keys() & other.values.keys():
            rows /= max(1.0, self.values[v], other.values[v])
        values = {v: min(rows, *(s.values[v] for s in (self, other) if v in s.values)) for v in self.values.keys() | other.values.keys()}
        return Size(max(rows, 1.0), values)


def order(patterns: Sequence[Pattern | Star], size: Callable[[Pattern | Star], Size]) -> list[Pattern | Star]:
    """Left-deep order; patterns without a shared variable come last."""
    if len(patterns) < 2:
        return list(patterns)
    sizes = [size(p) for p in patterns]
    names = [set(p.variables()) for p in patterns]

    def cost(way: tuple[int, ...]) -> tuple[float, Size]:
        now, total = sizes[way[0]], 0.0
        for k in way[1:]:
            now = now.joined(sizes[k])
            total += now.rows
        return total, now

    def nexts(way: tuple[int, ...]) -> list[int]:
        left = [k for k in range(len(patterns)) if k not in way]
        seen = set().union(*(names[k] for k in way))
        return [k for k in left if names[k] & seen] or left

    if len(patterns) <= EXACT:
        best: dict[frozenset, tuple[float, tuple[int, ...]]] = {frozenset([k]): (0.0, (k,)) for k in range(len(patterns))}
        for _ in range(len(patterns) - 1):
            grown: dict[frozenset, tuple[float, tuple[int, ...]]] = {}
            for used, (_, way) in best.items():
                for k in nexts(way):
                    new = (*way, k)
                    c = cost(new)[0]
                    key = used | {k}
                    if key not in grown or c < grown[key][0]:
                        grown[key] = (c, new)
            best = grown
        way = min(best.values())[1]
    else:
        way = (min(range(len(patterns)), key=lambda k: sizes[k].rows),)
        while len(way) < len(patterns):
            way = (*way, min(nexts(way), key=lambda k: cost((*way, k))[0]))
    return [patterns[k] for k in way]


def used(query: Query) -> set[str]:
    """Variables that matter outside the pattern in which they stand alone."""
    names = set(query.output()) | {k[1:] for k, _ in query.order if k.startswith("?")}
    seen: dict[str, int] = {}

    def walk(group: Group) -> None:
        for f in group.filters:
            names.update(f.variables())
        for f in group.functions:
            names.update(x.name for x in f.inputs if isinstance(x, Var))
            names.update(f.outputs)
        for r in group.reaches:
            names.update(x.name for x in (r.start, r.end) if isinstance(x, Var))
        for p in group.patterns:
            for v in p.variables():
                seen[v] = seen.get(v, 0) + 1
        for g in [*(g for u in group.unions for g in u), *group.optionals]:
            walk(g)

    walk(query.where)
    return names | {v for v, n in seen.items() if n > 1}
