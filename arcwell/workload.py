"""Workloads: query templates, benchmark lists, update configurations, SQL translation."""

from __future__ import annotations

import re
import statistics
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwell.plans.parser import Query, Var, parse


def templates(text: str) -> Iterator[tuple[str, list[str], list[str]]]:
    """(name, projection, terms) of each line `?a ?b - term term term ...`; the comment before it is its name; @ stands for a constant to find."""
    name = ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line[0] == "#":
            name = line[1:].strip()
            continue
        head, _, body = line.partition(" - ")
        yield name, head.split(), body.split()


def template_query(terms: list[str], k: int) -> tuple[str, list[str]]:
    """The query for the k most frequent constants of a template's places @, and its pattern terms."""
    n, body = 0, []
    for t in terms:
        if t == "@":
            n += 1
            t = f"?at{n}"
        body.append(t)
    places = " ".join(f"?at{i + 1}" for i in range(n))
    return f"select count {places} where {{ {_triples(body)} }} order by desc(count) limit {k}", body


def _triples(terms: list[str]) -> str:
    return " . ".join(" ".join(terms[i : i + 3]) for i in range(0, len(terms), 3))


def expand(run_terms: Callable[[str], DataFrame], render: Callable, projection: list[str], terms: list[str], k: int = 10) -> list[str]:
    """Queries of a template with its k most frequent constants; k bounds what reaches the driver."""
    text, body = template_query(terms, k)
    out = []
    for row in run_terms(text).collect():
        given = {f"?{c}": render(row[c]) for c in row.asDict() if c.startswith("at")}
        out.append(f"select distinct {' '.join(projection)} where {{ {_triples([given.get(t, t) for t in body])} }}")
    return out


def star(predicates: list[str], center: str = "?x") -> str:
    """A star query over predicates."""
    return f"select * where {{ {' . '.join(f'{center} <{p}> ?v{k}' for k, p in enumerate(predicates))} }}"


def chain(predicates: list[str]) -> str:
    """A chain query over predicates."""
    return f"select * where {{ {' . '.join(f'?v{k} <{p}> ?v{k + 1}' for k, p in enumerate(predicates))} }}"


@dataclass(frozen=True)
class Benchmark:
    engine: str
    database: str
    queries: dict[str, str]


def benchmark_list(text: str) -> Benchmark:
    """Engine line, database line, then `NAME path` lines; # starts a comment."""
    lines = [x for line in text.splitlines() if (x := line.split("#")[0].strip())]
    return Benchmark(lines[0], lines[1], dict(x.split(None, 1) for x in lines[2:]))


@dataclass(frozen=True)
class UpdateConfig:
    initial: int
    chunk: int
    chunks: int
    threads: int
    delay_model: int
    query_model: int
    queries: tuple[str, ...]


def update_config(text: str) -> UpdateConfig:
    """Six integers with # comments behind them, then queries a line each."""
    lines = [x for line in text.splitlines() if (x := line.split("#")[0].strip())]
    return UpdateConfig(*(int(x.split()[0]) for x in lines[:6]), tuple(lines[6:]))


def timed(run: Callable[[str], DataFrame], queries: dict[str, str], passes: int = 5) -> dict[str, float]:
    """Best seconds of each query over the passes; results go to the noop sink."""
    out = {}
    for name, text in queries.items():
        seconds = []
        for _ in range(passes):
            began = time.perf_counter()
            run(text).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        out[name] = min(seconds)
    return out


def q_errors(estimates: list[tuple[float, float]]) -> float:
    """Median of max(estimate/true, true/estimate)."""
    return statistics.median(max(e, 1) / max(t, 1) if e > t else max(t, 1) / max(e, 1) for e, t in estimates)


def to_sql(text: str, id_of: Callable) -> str:
    """A query of patterns and (in)equality filters as SQL over facts(s, p, o) and strings(id, value).

    One alias of facts for each pattern, a representative column for each variable.
    """
    query: Query = parse(text)
    if query.where.unions or query.where.optionals or query.where.functions or query.where.reaches:
        raise ValueError("only patterns and filters have SQL here")
    place: dict[str, str] = {}
    where = []
    for k, pattern in enumerate(query.where.patterns):
        for slot, what in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
            column = f"f{k}.{slot}"
            if not isinstance(what, Var):
                i = id_of(what)
                where.append(f"{column} = {-1 if i is None else i}")
            elif what.name in place:
                where.append(f"{column} = {place[what.name]}")
            else:
                place[what.name] = column
    for e in query.where.filters:
        if e.op not in ("=", "!=", "in") or any(a.op not in ("var", "const") for a in e.args):
            raise ValueError(f"filter {e.op} has no SQL here")
        left, *rest = [place[a.args[0]] if a.op == "var" else str(-1 if (i := id_of(a.args[0])) is None else i) for a in e.args]
        where.append(f"{left} IN ({', '.join(rest) or 'NULL'})" if e.op == "in" else f"{left} {'=' if e.op == '=' else '<>'} {rest[0]}")
    columns = ", ".join(f"{place[v]} AS {re.sub(r'[^0-9A-Za-z_]', '_', v)}" for v in query.output())
    tables = ", ".join(f"facts f{k}" for k in range(len(query.where.patterns)))
    body = f"FROM {tables}" + (f" WHERE {' AND '.join(where)}" if where else "")
    if query.mode in ("count", "duplicates"):
        groups = ", ".join(place[v] for v in query.output())
        return f"SELECT {columns}, count(*) AS count {body} GROUP BY {groups}" + (" HAVING count(*) > 1" if query.mode == "duplicates" else "")
    return f"SELECT {'DISTINCT ' if query.mode in ('distinct', 'reduced') else ''}{columns} {body}"


def analyzed(store, text: str) -> DataFrame:
    """(step, expected, observed) of each pattern of the outermost group and of each join in the planned order; one count a step."""
    from arcwell.operators import solutions as op
    from arcwell.plans import optimizer

    said = lambda p: " ".join(f"?{x.name}" if isinstance(x, Var) else x.lex for x in (p.s, p.p, p.o))
    steps, rows, size = [], None, None
    for p in optimizer.order(list(parse(text).where.patterns), store.size):
        found, own = store.scan(p), store.size(p)
        steps.append((said(p), own.rows, 0 if found is None else found.count()))
        if found is None:
            break
        rows, size = (found, own) if rows is None else (op.join(rows, found), size.joined(own))
        if rows is not found:
            steps.append(("join " + said(p), size.rows, rows.count()))
    return store.spark.createDataFrame(steps, "step string, expected double, observed long")


def run_updates(store, triples: DataFrame, config: UpdateConfig) -> list[tuple[int, float]]:
    """Commits term triples as an initial load and chunks, in the configuration's proportions, and runs its queries after each; (commit, seconds) of all.

    A triple's commit follows from its hash, so sizes are those of the configuration up
    to chance and nothing is sorted or numbered.
    """
    share = config.initial / max(1, config.initial + config.chunk * config.chunks)
    place = F.pmod(F.xxhash64(F.struct("s", "p", "o")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    commit = F.when(place < share, 0).otherwise(1 + F.floor((place - share) / max(1 - share, 1e-9) * config.chunks)).cast("int")
    out = []
    for k in range(1 + config.chunks):
        began = time.perf_counter()
        store.add(triples.where(commit == k))
        out.append((k, time.perf_counter() - began))
        for text in config.queries:
            store.query(text).write.format("noop").mode("overwrite").save()
    return out


def missing_and_extra(store, triples: DataFrame) -> tuple[int, int]:
    """How many triples a store lacks of what was committed, and how many it has besides."""
    want, have = triples.select("s", "p", "o").distinct(), store.triples()
    return want.exceptAll(have).count(), have.exceptAll(want).count()
