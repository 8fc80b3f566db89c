"""A persistent store: dictionary-encoded triples on Parquet, with uncommitted and committed inserts.

    <path>/v<N>/terms      id, type, lex, sub by h, a hash of lex
    <path>/v<N>/odd        terms whose id is not the hash of the term, if there are any
    <path>/v<N>/facts      s, o, created by p
    <path>/v<N>/stats      p, n, subjects, objects: counts by predicate for the join order
    <path>/v<N>/meta       the clock when the version was written, the number of values of h, and `hashed`
    <path>/v<N>/delta-<k>-<x>/ the same tables of one committed insert, in use once its stats are complete
    <path>/CURRENT         the number N, replaced last when a store is rewritten

Facts are a set: an insert writes only those that the store lacks, so a scan reads
base and deltas and has nothing to drop.  The first load of an empty store is its base.
One writer commits at a time.  The clock counts commits and never goes back; a fact
keeps the time of its first commit through compaction.
Predicates partition the facts, so a pattern with a constant one reads only its
files; within them rows are sorted by subject for the row groups' statistics.  The
dictionary is partitioned by a hash of the text and sorted by it, so a constant is
looked up in one part of it, and all constants of a query at once.

An id is a hash of the term, so that triples become ids row by row, without a join.
Terms with equal hashes are found when they are written and get ids above all hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.operators.solutions import match
from arcwell.plans.compile import Options, plan
from arcwell.plans.optimizer import Size
from arcwell.plans.parser import Pattern, Var, constants, parse
from arcwell.sources import turtle
from arcwell.terms import TERM, Term, hash_part, rendered, term

TERMS = "id long, type int, lex string, sub string, h int"
FACTS = "s long, p long, o long, created long"
STATS = "p long, n long, subjects long, objects long"
ODD = "id long, type int, lex string, sub string"
#: Bits of a term's hash, most terms of equal hashes in one commit, and triples that one task writes.
ID_BITS, MOST_ODD, TASK_ROWS = 62, 100_000, 4_000_000
#: Bytes from which a dictionary is not shuffled for a small result.
LARGE = 32 << 20


def hashed(kind: Column, lex: Column, sub: Column) -> Column:
    """A term's id unless its hash is another term's too."""
    return F.shiftrightunsigned(F.xxhash64(kind, lex, sub), 64 - ID_BITS)


def _key(df: DataFrame, slot: str) -> list[Column]:
    return [F.col(f"{slot}.type").alias("type"), F.col(f"{slot}.lex").alias("lex"), F.col(f"{slot}.sub").alias("sub")]


class Store:
    """Implements the graph protocol of arcwell.plans.compile on ids."""

    def __init__(self, spark: SparkSession, path: str, as_of: int | None = None, term_parts: int = 16):
        """term_parts: how many parts the dictionary of a new store has; a part should stay below some GB."""
        self.spark, self.path, self.as_of = spark, path.rstrip("/"), as_of
        self.options = Options()
        self.pending: list[tuple[Term, Term, Term]] = []
        self.path_index = None
        self.graph_index = None
        self._ids: dict[Term, int | None] = {}
        self._sizes: dict[int | None, tuple[float, float, float, float]] = {}
        if not self._exists("CURRENT"):
            self._term_parts = term_parts
            self._rewrite(lambda at: self._encode(spark.createDataFrame([], f"s {TERM}, p {TERM}, o {TERM}"), False, at, 0), 0)

    # files

    def _hadoop(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        fs, at = self._hadoop(name)
        return fs.exists(at)

    def _list(self, name: str) -> list[str]:
        fs, at = self._hadoop(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        fs, at = self._hadoop(name)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, name: str) -> str:
        fs, at = self._hadoop(name)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    @property
    def version(self) -> str:
        return self._text("CURRENT")

    def _meta(self) -> tuple[int, int]:
        """The clock when the version was written, and the dictionary's parts."""
        clock, parts = self._text(f"{self.version}/meta").split()[:2]
        return int(clock), int(parts)

    def _deltas(self) -> list[str]:
        return [f"{self.version}/{n}" for n in self._list(self.version) if n.startswith("delta-") and self._exists(f"{self.version}/{n}/stats/_SUCCESS")]

    def _forget(self) -> None:
        self._ids, self._sizes = {}, {}

    def state(self) -> tuple:
        """What the store holds: its version, the deltas in use, and as of when."""
        return self.path, self.version, tuple(self._deltas()), self.as_of

    # reading

    def terms(self) -> DataFrame:
        """The dictionary; a term that a delta brings is in no other part."""
        parts = [f"{self.path}/{self.version}/terms", *(f"{self.path}/{d}/terms" for d in self._deltas())]
        return self._dictionary(parts)

    def _dictionary(self, parts: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(TERMS).parquet(p).select("id", "type", "lex", "sub", "h") for p in parts])

    def facts(self) -> DataFrame:
        """All triples as ids, each once; `store_state` says of which state, for indexes built of them."""
        state = self.state()
        base = self.spark.read.schema(FACTS).parquet(f"{self.path}/{self.version}/facts").select("s", "p", "o", "created")
        deltas = [f"{self.path}/{d}/facts" for d in self._deltas()]
        base = reduce(DataFrame.unionByName, [base, *(self.spark.read.schema(FACTS).parquet(d).select("s", "p", "o", "created") for d in deltas)])
        if self.as_of is not None:
            base = base.where(F.col("created") <= self.as_of)
        out = base.select("s", "p", "o")
        out.store_state = state
        return out

    def triples(self) -> DataFrame:
        """(s, p, o) as term columns."""
        return self.decode(self.facts(), ["s", "p", "o"])

    def id_of(self, t: Term) -> int | None:
        """Id of a term, None if the store has none."""
        if t not in self._ids:
            self.lookup([t])
        return self._ids[t]

    def lookup(self, terms: list[Term]) -> dict[Term, int | None]:
        """Ids of several terms by one pass over the parts of the dictionary that may hold them."""
        todo = [t for t in dict.fromkeys(terms) if t not in self._ids]
        if todo:
            n = self._meta()[1]
            words = self.terms().where(F.col("h").isin(*{hash_part(t.lex, n) for t in todo}))
            words = words.where(F.col("lex").isin(*{t.lex for t in todo})) if len(todo) < 1000 else words.join(self.spark.createDataFrame([(t.lex,) for t in todo], "lex string").distinct(), "lex", "left_semi")
            by = {Term(r["type"], r["lex"], r["sub"]): r["id"] for r in words.select("type", "lex", "sub", "id").collect()}
            self._ids |= {t: by.get(t) for t in todo}
        return {t: self._ids[t] for t in terms}

    def name_of(self, number: int) -> Term | None:
        row = self.terms().where(F.col("id") == number).first()
        return None if row is None else Term(row["type"], row["lex"], row["sub"])

    def known(self, t: Term) -> bool:
        return self.id_of(t) is not None

    def terms_where(self, condition: Callable[[Column], Column]) -> DataFrame:
        """Ids of the terms that meet a condition, the dictionary filtered before any join."""
        return self.terms().where(condition(term(F.col("type"), F.col("lex"), F.col("sub")))).select("id")

    def decode(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the named id columns as term columns; null stays null."""
        columns, settled = df.columns, df if getattr(df, "settled", False) else None
        for n in names:
            words = self.terms()
            if settled is not None:
                words = words.join(settled.select(F.col(n).alias("id")).distinct(), "id", "left_semi")
            words = words.select(F.col("id").alias("__id"), term(F.col("type"), F.col("lex"), F.col("sub")).alias("__term"))
            df = df.join(words, F.col(n) == F.col("__id"), "left").withColumn(n, F.col("__term")).select(*columns)
        return df

    def settled(self, df: DataFrame) -> DataFrame:
        """An aggregated result, written first where the dictionary is large: Spark then knows its size, and takes a small one to the dictionary instead of shuffling that."""
        if int(str(self.terms()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < LARGE:
            return df
        at = f"{self.path}/results/{uuid.uuid4().hex}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.settled = True
        return out

    def scan(self, pattern: Pattern) -> DataFrame | None:
        slots: dict = {}
        for slot, what in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o)):
            if isinstance(what, Var):
                slots[slot] = what.name
            elif (i := self.id_of(what)) is None:
                return None
            else:
                slots[slot] = F.col(slot) == i
        return match(self.facts(), slots)

    def equals(self, df: DataFrame, column: str, t: Term) -> Column:
        """Whether a column holds a term."""
        i = self.id_of(t)
        return F.lit(False) if i is None else F.col(column) == i

    def statistics(self):
        from arcwell.stats import Statistics

        return Statistics(self.facts())

    def _counts(self, p: int | None) -> tuple[float, float, float, float]:
        """Triples, subjects, objects and predicates of one predicate or of all, from the tables written with the facts."""
        if p not in self._sizes:
            parts = [f"{self.path}/{self.version}/stats", *(f"{self.path}/{d}/stats" for d in self._deltas())]
            rows = self.spark.read.schema(STATS).parquet(*parts)
            if p is not None:
                rows = rows.where(F.col("p") == p)
            n, subjects, objects, predicates = rows.agg(F.sum("n"), F.sum("subjects") if p is not None else F.max("subjects"), F.sum("objects") if p is not None else F.max("objects"), F.count_distinct("p")).first()
            self._sizes[p] = tuple(max(1.0, float(x or 0)) for x in (n, subjects, objects, predicates))
        return self._sizes[p]

    def size(self, pattern: Pattern) -> Size:
        """Exact triples and estimated different values of a predicate; constants divide by these."""
        p = None if isinstance(pattern.p, Var) else self.id_of(pattern.p)
        if p is None and not isinstance(pattern.p, Var):
            return Size(1.0, {v: 1.0 for v in pattern.variables()})
        rows, subjects, objects, predicates = self._counts(p)
        for what, different in ((pattern.s, subjects), (pattern.o, objects)):
            if not isinstance(what, Var):
                rows = max(1.0, rows / different)
        places = ((pattern.s, subjects), (pattern.p, predicates), (pattern.o, objects))
        return Size(rows, {x.name: max(1.0, min(d, rows)) for x, d in places if isinstance(x, Var)})

    def vertices(self, pattern: Pattern) -> dict[str, list[DataFrame]]:
        return {}

    # queries

    def _graph(self, text: str):
        """The store itself, or with its indexes around it where they help this query.

        An index of another state lacks vertices or has other ids, and is not used.  All
        constants of the query are looked up at once.
        """
        self.lookup(list(constants(parse(text).where)))
        indexes = [i for i in (self.path_index, self.graph_index) if i is not None] if self.options.indexes else []
        now = self.state() if indexes else None
        indexes = [i for i in indexes if i.of == now]
        if not indexes:
            return self
        from arcwell.indexes import Indexed

        return Indexed(self, parse(text), indexes)

    def query(self, text: str) -> DataFrame:
        """Rows of lexical forms."""
        return plan(self._graph(text), text, self.options).texts()

    def query_terms(self, text: str) -> DataFrame:
        return plan(self._graph(text), text, self.options).terms()

    def explain(self, text: str, physical: bool = False) -> str:
        """The logical plan, and Spark's one if asked for."""
        p = plan(self._graph(text), text, self.options)
        df = p.texts()
        out = "\n".join(p.tree)
        return out + "\n\n" + df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if physical else out

    def register_table_function(self, name: str, function: Callable) -> None:
        self.options.table_functions[name] = function

    def register_function(self, name: str, function: Callable[..., Column]) -> None:
        self.options.functions[name] = function

    # writing

    def _encode(self, triples: DataFrame, more: bool, at: str, created: int, known: list[str] | None = None) -> None:
        """Writes new terms and new facts of term triples at a folder; with more, those that the store has keep their ids and are left out.

        known: texts of all the terms, where the driver has them, so that only their
        parts of the dictionary are read.
        """
        parts = self._meta()[1] if self._exists("CURRENT") else self._term_parts
        slots = triples.select(F.explode(F.array("s", "p", "o")).alias("t"))
        words = slots.select(hashed(F.col("t.type"), F.col("t.lex"), F.col("t.sub")).alias("id"), *_key(slots, "t")).distinct().withColumn("h", F.pmod(F.xxhash64("lex"), F.lit(parts)).cast("int"))
        old = self.terms() if more else None
        if more:
            same = old
            if known is not None and len(known) < 1000:
                same = old.where(F.col("h").isin(*{hash_part(x, parts) for x in known}) & F.col("lex").isin(*set(known))) if known else old.limit(0)
            words = words.join(same, (words["h"] == same["h"]) & (words["type"] == same["type"]) & (words["lex"] == same["lex"]) & words["sub"].eqNullSafe(same["sub"]), "left_anti")
        # each task of the aggregate writes its share of every part
        words.sortWithinPartitions("h", "lex").write.partitionBy("h").parquet(f"{self.path}/{at}/terms")
        odd = self._odd() if more else None
        if (new := self._apart(at, old, odd)) is not None:
            odd = new if odd is None else odd.unionByName(new)
        out = triples
        for slot in "spo":
            t = F.col(slot)
            i = hashed(t["type"], t["lex"], t["sub"])
            if odd is None:
                out = out.withColumn(f"{slot}_id", i)
            else:
                named = odd.select(F.col("id").alias("__odd"), term(F.col("type"), F.col("lex"), F.col("sub")).alias("__term"))
                out = out.join(named, t.eqNullSafe(F.col("__term")), "left").withColumn(f"{slot}_id", F.coalesce("__odd", i)).drop("__odd", "__term")
        facts = out.select(F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))
        if more:
            facts = facts.join(Store(self.spark, self.path).facts(), ["s", "p", "o"], "left_anti")
        self._write_facts(facts, at, triples.count(), created)

    def _odd(self) -> DataFrame | None:
        """Terms whose id is not their hash; None if there are none."""
        if not self._text(f"{self.version}/meta").endswith("hashed"):
            return self.terms().where(F.col("id") != hashed(F.col("type"), F.col("lex"), F.col("sub"))).drop("h")
        parts = [f"{self.path}/{d}/odd" for d in (self.version, *self._deltas()) if self._exists(f"{d}/odd/_SUCCESS")]
        return self.spark.read.schema(ODD).parquet(*parts) if parts else None

    def _apart(self, at: str, old: DataFrame | None, odd: DataFrame | None) -> DataFrame | None:
        """Gives new terms whose hash is another term's ids above all hashes; returns these, None if there are none."""
        terms = self._dictionary([f"{self.path}/{at}/terms"])
        clash = terms.groupBy("id").count().where("count > 1").select("id")
        if old is not None:
            clash = clash.union(terms.join(old, "id", "left_semi").select("id"))
        # two terms of 3e8 have equal hashes with a chance of 1 %
        ids = [r["id"] for r in clash.distinct().limit(MOST_ODD + 1).collect()]
        if not ids:
            return None
        some = terms.join(self.spark.createDataFrame([(i,) for i in ids], "id long"), "id", "left_semi").limit(MOST_ODD + 1).collect()
        if len(some) > MOST_ODD:
            raise ValueError(f"more than {MOST_ODD} new terms have equal hashes")
        top = None if odd is None else odd.agg(F.max("id")).first()[0]
        first = max(1 << ID_BITS, 0 if top is None else top + 1)
        rows = [(first + k, r["type"], r["lex"], r["sub"], r["h"]) for k, r in enumerate(some)]
        self.spark.createDataFrame(rows, TERMS).select("id", "type", "lex", "sub").coalesce(1).write.parquet(f"{self.path}/{at}/odd")
        rest = terms.join(self.spark.createDataFrame([(i,) for i in ids], "id long"), "id", "left_anti")
        every = rest.select("id", "type", "lex", "sub", "h").unionByName(self.spark.createDataFrame(rows, TERMS))
        every.sortWithinPartitions("h", "lex").write.partitionBy("h").parquet(f"{self.path}/{at}/terms-apart")
        fs, before = self._hadoop(f"{at}/terms")
        fs.delete(before, True)
        if not fs.rename(self._hadoop(f"{at}/terms-apart")[1], before):
            raise RuntimeError("the dictionary was not written")
        return self.spark.read.schema(ODD).parquet(f"{self.path}/{at}/odd")

    def _write_facts(self, facts: DataFrame, at: str, rows: int, created: int | None = None) -> None:
        """Different facts by predicate and their counts. rows: an upper bound of their number. created: their time, None if they have one each."""
        # one shuffle: a range of (p, s, o) has all copies of a fact, few predicates, and a share of a hot one
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
        ranged = facts.repartitionByRange(tasks, "p", "s", "o") if rows > TASK_ROWS else facts.repartitionByRange("p", "s", "o")
        if created is not None:
            ranged = ranged.distinct().withColumn("created", F.lit(created).cast("long"))
        ranged.sortWithinPartitions("p", "s", "o").write.partitionBy("p").parquet(f"{self.path}/{at}/facts")
        written = self.spark.read.schema(FACTS).parquet(f"{self.path}/{at}/facts")
        written.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects")).coalesce(1).write.parquet(f"{self.path}/{at}/stats")

    def _rewrite(self, write: Callable[[str], None], clock: int) -> None:
        """A new version that write(folder) fills; it replaces the old one last."""
        parts = self._meta()[1] if self._exists("CURRENT") else self._term_parts
        at = "v" + uuid.uuid4().hex
        write(at)
        if not self._exists(f"{at}/stats/_SUCCESS"):
            raise RuntimeError("the store was not written")
        self._put(f"{at}/meta", f"{clock} {parts} hashed")
        self._put("CURRENT", at)
        self._forget()

    def _replace(self, write: Callable[[str], None], clock: int) -> None:
        old = self.version
        self._rewrite(write, clock)
        fs, at = self._hadoop(old)
        fs.delete(at, True)

    def _now(self) -> int:
        """Time of the next commit."""
        return self._meta()[0] + 1 + len(self._deltas())

    def load(self, paths: str | list[str], ntriples: bool | None = None) -> DataFrame:
        """Adds the triples of files and returns the errors found in them, column `error`."""
        names = [paths] if isinstance(paths, str) else paths
        lines = all(p.endswith((".nt", ".ntriples")) for p in names) if ntriples is None else ntriples
        # parsed once
        at = f"{self.path}/load-{uuid.uuid4().hex}"
        (turtle.read_ntriples if lines else turtle.read_turtle)(self.spark, names).write.parquet(f"{at}/rows")
        rows = self.spark.read.schema(turtle.TRIPLES).parquet(f"{at}/rows")
        rows.where(F.col("error").isNotNull()).select("error").write.parquet(f"{at}/errors")
        self.add(rows.where(F.col("s").isNotNull()).select("s", "p", "o"))
        fs, staged = self._hadoop(f"{at.removeprefix(self.path + '/')}/rows")
        fs.delete(staged, True)
        return self.spark.read.schema("error string").parquet(f"{at}/errors")

    def add(self, triples: DataFrame, known: list[str] | None = None) -> None:
        """Commits (s, p, o) term columns: as the base of an empty store, else as one delta of what the store lacks."""
        rows, now = triples.select("s", "p", "o"), self._now()
        if not self._deltas() and self.spark.read.schema(STATS).parquet(f"{self.path}/{self.version}/stats").isEmpty():
            self._replace(lambda at: self._encode(rows, False, at, now), now)
        else:
            self._encode(rows, True, f"{self.version}/delta-{now:06d}-{uuid.uuid4().hex[:8]}", now, known)
        self._forget()

    def insert(self, text: str) -> int:
        """insert data { turtle } or plain Turtle, seen by queries after commit(); returns the number of its triples.

        Raises on the first error, and then inserts nothing.
        """
        body = text.strip()
        if body.lower().startswith("insert"):
            head, _, rest = body.partition("{")
            if head.lower().split() != ["insert", "data"] or not rest.rstrip().endswith("}"):
                raise ValueError("insert data { ... } expected")
            body = rest.rstrip()[:-1]
        body = body.rstrip()
        if body and not body.endswith("."):
            body += " ."
        found, errors = turtle.parse(body, scope="i" + uuid.uuid4().hex[:8])
        if errors:
            raise ValueError(f"line {errors[0][0]}: {errors[0][1]}")
        self.pending += found
        return len(found)

    def rollback(self) -> None:
        """Forgets all inserts since the last commit."""
        self.pending = []

    def commit(self) -> None:
        if not self.pending:
            return
        rows = [tuple((t.type, t.lex, t.sub) for t in x) for x in self.pending]
        self.add(self.spark.createDataFrame(rows, f"s {TERM}, p {TERM}, o {TERM}"), [t.lex for x in self.pending for t in x])
        self.pending = []

    def compact(self) -> None:
        """Merges base and deltas into a new version, which keeps ids and times; the old one stays readable until it is replaced."""
        whole = Store(self.spark, self.path)
        base = [f"{self.path}/{d}/facts" for d in (self.version, *self._deltas())]
        facts = reduce(DataFrame.unionByName, [self.spark.read.schema(FACTS).parquet(d).select("s", "p", "o", "created") for d in base])

        def write(at: str) -> None:
            whole.terms().hint("rebalance", "h").sortWithinPartitions("h", "lex").write.partitionBy("h").parquet(f"{self.path}/{at}/terms")
            if (odd := whole._odd()) is not None:
                odd.write.parquet(f"{self.path}/{at}/odd")
            self._write_facts(facts, at, facts.count())

        self._replace(write, self._now() - 1)

    def dump(self, path: str, abbreviated: bool = False) -> None:
        """All triples as N-Triples, or as Turtle with `;` and `,`."""
        if abbreviated:
            turtle.abbreviated(self.triples()).write.mode("overwrite").text(path)
        else:
            turtle.write_ntriples(self.triples(), path)

    def export_relational(self, path: str) -> None:
        """facts, strings, and the facts by predicate, for other engines."""
        self.facts().write.mode("overwrite").parquet(f"{path}/facts")
        self.terms().select("id", rendered(term(F.col("type"), F.col("lex"), F.col("sub"))).alias("value")).write.mode("overwrite").parquet(f"{path}/strings")
        self.facts().select(F.col("s").alias("subject"), F.col("o").alias("object"), "p").write.mode("overwrite").partitionBy("p").parquet(f"{path}/properties")
