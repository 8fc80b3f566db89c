import random
from collections import Counter

import pytest

from arcwell.indexes import GraphIndex, PathIndex, canonical
from arcwell.plans.compile import Options, plan, query
from arcwell.store import Store
from arcwell.terms import BOOLEAN, CUSTOM, DECIMAL, DOUBLE, INTEGER, LANGUAGE, STRING, TERM, Term, iri, literal
from reference_model import answer

EX = "http://ex/"
GRAPH = [
    (iri("a"), iri("knows"), iri("b")),
    (iri("b"), iri("knows"), iri("c")),
    (iri("c"), iri("knows"), iri("a")),
    (iri("a"), iri("knows"), iri("a")),
    (iri("knows"), iri("label"), literal("knows")),
    (iri("a"), iri("label"), literal("x")),
    (iri("b"), iri("label"), literal("x", lang="en")),
    (iri("c"), iri("label"), Term(STRING, "x")),
    (iri("a"), iri("age"), Term(INTEGER, "5")),
    (iri("b"), iri("age"), Term(INTEGER, "05")),
    (iri("c"), iri("age"), Term(DECIMAL, "12.5")),
    (iri("d"), iri("age"), Term(DOUBLE, "1e1")),
    (iri("d"), iri("ok"), Term(BOOLEAN, "true")),
    (iri("d"), iri("born"), literal("2000-01-01", datatype="http://dt/date")),
    (iri("_:n"), iri("label"), literal("héé ß")),
    (iri("e"), iri("likes"), iri("_:n")),
    (iri("e"), iri("label"), literal("")),
    (iri("z1"), iri("apart"), iri("z2")),
]
QUERIES = [
    "select ?x ?y where { ?x <knows> ?y }",
    "select ?x where { ?x <knows> ?x }",
    "select ?x ?p ?y where { ?x ?p ?y }",
    "select distinct ?p where { ?x ?p ?y }",
    "select count ?p where { ?x ?p ?y }",
    "select duplicates ?x where { ?x ?p ?y }",
    "select ?a ?c where { ?a <knows> ?b . ?b <knows> ?c }",
    "select ?a ?b ?c where { ?a <knows> ?b . ?b <knows> ?c . ?c <knows> ?a }",
    "select count ?l where { ?a <knows> ?b . ?b <label> ?l }",
    "select ?a ?z where { ?a <age> ?g . ?z <apart> ?w }",
    "select ?x ?g ?l where { { ?x <age> ?g } union { ?x <label> ?l } }",
    "select ?x ?g where { { ?x <age> ?g } union { ?x <none> ?g } . ?x <knows> ?y }",
    "select ?p ?l where { ?x ?p ?y . ?p <label> ?l }",
    "select ?x where { ?x <age> ?g . filter(?g < \"1\") }",
    "select ?x ?y where { ?x <label> ?l . ?y <label> ?l . filter(?x != ?y) }",
    "select ?x ?y where { ?x <knows> ?y . filter(!(?x = ?y) && !(?x = <b> || ?y = <b>)) }",
    "select * where { ?x <likes> [ <label> ?l ] }",
    "select ?q where { ?x <missing> ?y }",
    "select ?x ?nothing where { ?x <knows> <b> }",
    "select ?x where { { ?x <age> ?g } union { ?x <label> ?l } . filter(bound(?g)) }",
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    rows = [tuple((t.type, t.lex, t.sub) for t in x) for x in GRAPH + GRAPH[:3]]
    s.add(spark.createDataFrame(rows, f"s {TERM}, p {TERM}, o {TERM}"))
    return s


def got(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("text", QUERIES)
def test_against_model(store, text):
    assert got(store.query(text)) == answer(text, GRAPH)


def test_options_change_no_result(store, tmp_path):
    store.path_index = PathIndex.build(store.facts(), str(tmp_path / "rp"), max_length=2, most_ratio=2.0, reverse=True)
    store.graph_index = GraphIndex.build(store.facts(), str(tmp_path / "rg"), max_edges=2, least=1)
    try:
        for text in QUERIES[6:10] + QUERIES[15:17]:
            assert got(store.query(text)) == answer(text, GRAPH), text
    finally:
        store.path_index = store.graph_index = None
    for text in QUERIES[4:10]:
        assert got(query(store, text, Options(reorder=False, aggregate=False))) == answer(text, GRAPH)


def test_random_patterns(store):
    rng = random.Random(5)
    names = ["?a", "?b", "?c", "<a>", "<b>"]
    for _ in range(12):
        body = " . ".join(f"{rng.choice(names)} {rng.choice(['<knows>', '<label>', '<age>', '?p'])} {rng.choice(names)}" for _ in range(rng.randint(1, 3)))
        mode = rng.choice(["", "distinct", "count", "duplicates"])
        text = f"select {mode} ?a ?b where {{ {body} }}"
        assert got(store.query(text)) == answer(text, GRAPH), text


EXPRESSIONS = {
    'lang(?v) = "en"': {"b"},
    'langMatches(?v, "en")': {"b"},
    'datatype(?v) = "http://www.w3.org/2001/XMLSchema#string"': {"knows", "a", "b", "c", "_:n", "e"},
    'str(?v) = "x"': {"a", "b", "c"},
    '?v = "x"': {"a"},
    '?v != "x"': {"knows", "b", "c", "_:n", "e"},
    '?v = "unknown"': set(),
    'sameTerm(?v, "x"@en)': {"b"},
    "isLiteral(?v) && isBlank(?x)": {"_:n"},
    "isIRI(?x) && ?v = \"\"": {"e"},
    'regex(?v, "h.*")': {"_:n"},
    'regex(?v, "h")': set(),
    'regex(?v, "(")': set(),
    'in(?v, "x", "x"@en)': {"a", "b"},
    "!bound(?nothing)": {"knows", "a", "b", "c", "_:n", "e"},
    "?nothing < ?v": set(),
    "!(?nothing < ?v)": {"knows", "a", "b", "c", "_:n", "e"},
    '<urn:none>(?v) = "x"': set(),
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(store, text):
    found = {r[0] for r in store.query(f"select ?x where {{ ?x <label> ?v . filter({text}) }}").collect()}
    assert found == EXPRESSIONS[text]


def test_numbers(store):
    ask = lambda e, **o: {r[0] for r in query(store, f"select ?x where {{ ?x <age> ?v . filter({e}) }}", Options(**o)).collect()}
    assert ask('?v + 1 = "6"') == {"a", "b"} and ask('?v * 2 = "25"') == {"c"} and ask('?v / 0 = "inf"') == {"a", "b", "c", "d"}
    assert ask('?v / 3 = "1.66667"') == {"a", "b"} and ask('?v * 1000000 = "1.25e+07"') == {"c"} and ask('-?v = "-10"') == {"d"}
    assert ask("?v = 5") == {"a"} and ask("?v > 6") == set() and ask("?v >= 10", typed=True) == {"c", "d"} and ask("?v <= 5", typed=True) == {"a", "b"}


def test_general_format(spark):
    from pyspark.sql import functions as F

    from arcwell.functions.expr import atof, general_format

    rng = random.Random(3)
    values = [0.0, 1.0, -1.5, 100000.0, 1e6, 999999.5, 1e-4, 9.99e-5, 1e100, -2e-300, 123456789.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", general_format(F.col("v"))).collect()
    assert [(v, t) for v, t in rows if t != "%g" % v] == []
    texts = {"12abc": 12.0, " -1.5e3xyz": -1500.0, "abc": 0.0, "": 0.0, ".5": 0.5, "+7": 7.0, "1e": 1.0}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", atof(F.col("t"))).collect()
    assert dict(map(tuple, found)) == texts


def test_order(store):
    ask = lambda o: [r[0] for r in store.query(f"select ?v where {{ {{ ?x <label> ?v }} union {{ ?x <age> ?v }} union {{ ?x <apart> ?w }} }} order by {o}").collect()]
    up = ask("?v")
    assert up == [None, "", "héé ß", "knows", "x", "x", "x", "05", "5", "12.5", "1e1"]
    assert ask("desc(?v)") == up[::-1]
    assert store.query("select count ?p where { ?x ?p ?y } order by desc(count) ?p limit 2").collect() == [("label", 6), ("age", 4)]


def test_count_groups_by_order_variables(store):
    rows = store.query("select count ?p where { ?x ?p ?y . filter(?p = <knows>) } order by ?x").collect()
    assert [tuple(r) for r in rows] == [("knows", 2), ("knows", 1), ("knows", 1)]


def test_insert_rollback_commit_compact(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.insert('insert data { <a> <p> "1" , "2" ; <q> <b> }')
    s.rollback()
    s.commit()
    assert s.facts().count() == 0
    s.insert('<a> <p> "1" , "2"')
    s.commit()
    s.insert('<a> <p> "2" , "3" . _:x <p> <a>')
    s.commit()
    assert s.facts().count() == 4 and Store(spark, s.path, as_of=1).facts().count() == 2
    assert s.terms().count() == s.terms().select("id").distinct().count() == s.terms().select("type", "lex", "sub").distinct().count()
    before = got(s.query("select ?x ?v where { ?x <p> ?v }"))
    s.compact()
    assert got(s.query("select ?x ?v where { ?x <p> ?v }")) == before and s._deltas() == []
    with pytest.raises(ValueError):
        s.insert("<a> <p> oops")
    assert s.name_of(s.id_of(literal("3"))) == literal("3") and s.id_of(literal("4")) is None
    s.export_relational(str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/properties")).count() == 4


def test_load_and_dump(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix e: <http://e/> .\ne:a e:p "1"@en , 2 .\nbroken\ne:a e:p 2 .\n')
    s = Store(spark, str(tmp_path / "s"))
    assert s.load([str(tmp_path / "a.ttl")]).count() == 1
    s.dump(str(tmp_path / "out.nt"))
    t = Store(spark, str(tmp_path / "t"))
    t.load([str(tmp_path / "out.nt")], ntriples=True)
    assert sorted(map(repr, t.triples().collect())) == sorted(map(repr, s.triples().collect())) and t.facts().count() == 2


def test_locks(spark, store, tmp_path):
    from arcwell.txn import Box, BulkOperation, Conflict, LockTable, cover

    locks = LockTable()
    locks.acquire("a", Box(s=(1, 5)), shared=True)
    locks.acquire("b", Box(s=(5, 9)), shared=True)
    with pytest.raises(Conflict):
        locks.acquire("c", Box(s=(9, 9), p=(3, 3)))
    locks.acquire("c", Box(s=(10, 10)))
    locks.release("b")
    locks.acquire("c", Box(s=(9, 9), p=(3, 3)))
    facts = store.facts()
    boxes = cover(facts, 5)
    assert len(boxes) <= 5
    for r in facts.collect():
        assert any(b.meets(Box((r[0], r[0]), (r[1], r[1]), (r[2], r[2]))) for b in boxes)
    s, locks = Store(spark, str(tmp_path / "l")), LockTable()
    one, two = BulkOperation(s, locks), BulkOperation(s, locks)
    one.lock(Box())
    two.insert(iri("a"), iri("p"), literal("x"))
    with pytest.raises(Conflict):
        two.commit()
    one.abort()
    two.commit()
    assert s.facts().count() == 1


def test_table_function_after_its_input(store):
    def split(t, sep):
        for part in t.lex.split(sep.lex):
            yield (literal(part),)

    store.register_table_function("split", split)
    text = 'select ?x ?w where { filter <urn:arcwell:tableFunction>("split", "2", ?l, " ", ?w) ?x <label> ?l . filter(isBlank(?x)) }'
    assert got(store.query(text)) == Counter({("_:n", "héé"): 1, ("_:n", "ß"): 1})


def test_reaches(store):
    assert got(store.query("select distinct ?y where { <b> reaches ?y via <knows> }")) == Counter({("a",): 1, ("b",): 1, ("c",): 1})


def test_canonical():
    assert canonical([(0, 1, 7), (1, 2, 8)])[0] == canonical([(2, 0, 7), (0, 1, 8)])[0] != canonical([(0, 1, 7), (0, 2, 8)])[0]


def test_explain(store):
    text = store.explain("select count ?p where { ?x ?p ?y }", physical=True)
    assert "counted" in text and "Scan parquet" in text


def test_broadcast_off(store, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text in QUERIES[6:9]:
            assert got(store.query(text)) == answer(text, GRAPH)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from arcwell.streaming.ingest import insert_stream
    from arcwell.terms import iri_column, literal_column

    spark.createDataFrame([(1, "click"), (2, "view")], "id long, kind string").write.parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "in"))
    shape = lambda b: b.select(iri_column(F.concat(F.lit("event/"), F.col("id").cast("string"))).alias("s"), iri_column(F.lit("kind")).alias("p"), literal_column(F.col("kind")).alias("o"))
    insert_stream(s, rows, shape, str(tmp_path / "c")).awaitTermination(120)
    assert got(s.query("select ?x where { ?x <kind> \"view\" }")) == Counter({("event/2",): 1})


def test_workload(store):
    from arcwell import workload
    from arcwell.terms import render

    ((name, projection, terms),) = workload.templates("# t1\n?x - ?x <knows> ?y ?y <label> @\n")
    found = workload.expand(store.query_terms, render, projection, terms, 2)
    assert name == "t1" and len(found) == 2 and all(got(store.query(q)) == answer(q, GRAPH) for q in found)
    b = workload.benchmark_list("# c\nengine\ndb\nA1 q/a1\n")
    assert b.queries == {"A1": "q/a1"}
    c = workload.update_config("10 # initial\n2\n3\n1\n0\n1\nselect ?x where { ?x ?p ?y }\n")
    assert (c.initial, c.chunks, len(c.queries)) == (10, 3, 1)
    sql = workload.to_sql("select count ?l where { ?a <knows> ?b . ?b <label> ?l . filter(?a != ?b) }", store.id_of)
    store.facts().createOrReplaceTempView("facts")
    rows = store.spark.sql(sql)
    assert sorted(r["count"] for r in rows.collect()) == sorted(k[-1] for k in answer("select count ?l where { ?a <knows> ?b . ?b <label> ?l . filter(?a != ?b) }", GRAPH).elements())


def test_statistics(store):
    from arcwell import stats

    facts = store.facts()
    rows = [tuple(r) for r in facts.collect()]
    s = stats.Statistics(facts)
    assert s.join_size("o", "s") == sum(a[2] == b[0] for a in rows for b in rows)
    knows = store.id_of(iri("knows"))
    assert s.cardinality(p=knows) == 4
    sets = stats.characteristic_sets(facts)
    nodes = {x for r in rows for x in (r[0], r[2])}
    assert sum(r["count"] for r in sets.collect()) == len(nodes)
    assert stats.superset_count(sets, [knows]) == 3 and stats.superset_count(sets, [knows, stats.outgoing(knows)]) == 3
    label, age = store.id_of(iri("label")), store.id_of(iri("age"))
    pairs = {(r["p1"], r["p2"]): r["count"] for r in stats.pair_stats(facts, False).collect()}
    assert pairs[min(label, age), max(label, age)] == 3
    assert stats.star_estimate(stats.star_sets(facts), [knows, age]) == pytest.approx(4.0)
    classes = stats.schema_classes(facts)
    assert sum(n for _, n in classes) == len({r[0] for r in rows})
    edges = stats.class_edges(facts, classes)
    assert "digraph" in stats.dot(edges)


def test_indexes_of_an_earlier_state_are_not_used(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert("insert data { " + " ".join(f"<a{k}> <p> <b{k}> ." for k in range(3)) + " ".join(f" <b{k}> <q> <c> ." for k in range(20)) + " }")
    store.commit()
    text = "select ?x ?y where { ?x <p> ?y . ?y <q> ?z }"
    store.path_index = PathIndex.build(store.facts(), str(tmp_path / "p"), max_length=2, most_ratio=2.0)
    store.graph_index = GraphIndex.build(store.facts(), str(tmp_path / "g"), max_edges=2, least=1)
    assert store._graph(text) is not store and store.query(text).count() == 3
    store.insert("insert data { <n> <p> <m> . <m> <q> <c> }")
    store.commit()
    assert store.query(text).count() == 4
    store.path_index.of = store.state()
    assert store.query(text).count() == 3  # what the old list would leave
    store.compact()
    assert store._graph(text) is store and store.query(text).count() == 4


def test_clock_survives_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for k in range(2):
        s.insert(f"<a> <p> <b{k}>")
        s.commit()
    s.compact()
    s.insert("<a> <p> <b2> , <b0>")
    s.commit()
    at = lambda t: sorted(r[0] for r in Store(spark, s.path, as_of=t).query("select ?o where { <a> <p> ?o }").collect())
    assert [at(t) for t in (0, 1, 2, 3)] == [[], ["b0"], ["b0", "b1"], ["b0", "b1", "b2"]]
    s.compact()
    assert [at(t) for t in (1, 2, 3)] == [["b0"], ["b0", "b1"], ["b0", "b1", "b2"]] and s._deltas() == []
    s.insert("<c> <p> <b0>")
    s.commit()
    assert at(4) == at(3) and Store(spark, s.path, as_of=3).facts().count() == 3 and s.facts().count() == 4


def test_scans_have_nothing_to_drop(spark, tmp_path):
    """Deltas are disjoint, so a pattern is a union of scans without an aggregate, and an insert writes only what is new."""
    s = Store(spark, str(tmp_path / "s"))
    for text in ("<a> <p> <b> , <c>", "<a> <p> <c> , <d>", "<x> <p> <c> . <a> <p> <b>"):
        s.insert(text)
        s.commit()
    assert s.facts().count() == s.facts().distinct().count() == 4 and len(s._deltas()) == 2
    tree = s.explain("select ?x ?y where { ?x <p> ?y }", physical=True)
    assert "Aggregate" not in tree.split("Join")[0] and "union" in tree.lower()
    assert "groupBy" not in tree and s._counts(s.id_of(iri("p")))[0] == 4


def test_dictionary_parts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), term_parts=5)
    s.add(spark.createDataFrame([((0, f"é{k}", None), (0, "p", None), (1, f"v {k}", None)) for k in range(60)], "s struct<type:int,lex:string,sub:string>, p struct<type:int,lex:string,sub:string>, o struct<type:int,lex:string,sub:string>"))
    from arcwell.terms import hash_part

    found = s.terms().collect()
    assert len(found) == 121 and all(r["h"] == hash_part(r["lex"], 5) for r in found)
    wanted = [Term(0, "é7", None), Term(1, "v 8", None), Term(1, "none", None), Term(0, "v 8", None)]
    ids = s.lookup(wanted)
    assert [ids[w] is None for w in wanted] == [False, False, True, True]


def test_optional_in_all_modes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.insert("<a> <p> <x> , <y> . <b> <p> <x> . <c> <p> <z> . <x> <q> <k1> , <k2> , <k3> . <y> <q> <k1>")
    s.commit()
    facts = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")]
    right = {"x": ["k1", "k2", "k3"], "y": ["k1"]}
    left = [(v, w, k) for v, w in facts for k in right.get(w, [None])]
    ask = lambda mode, names: got(s.query(f"select {mode} {names} where {{ ?v <p> ?w . optional {{ ?w <q> ?k }} }}"))
    assert ask("", "?v ?w ?k") == Counter(left)
    assert ask("count", "?v") == Counter((v, n) for v, n in Counter(v for v, _, _ in left).items())
    assert ask("duplicates", "?v") == Counter((v, n) for v, n in Counter(v for v, _, _ in left).items() if n > 1)
    assert ask("distinct", "?v ?k") == Counter(set((v, k) for v, _, k in left))
    assert got(s.query("select count ?v ?k where { ?v <p> <z> . optional { ?u <q> ?k } }")) == Counter({("c", "k1", 2): 1, ("c", "k2", 1): 1, ("c", "k3", 1): 1})
    assert got(s.query("select count ?v ?k where { ?v <p> <z> . optional { ?u <none> ?k } }")) == Counter({("c", None, 1): 1})


def test_reaches_begins_at_the_bound_end(spark, tmp_path):
    """A long chain beside a short way: only the bound end's part is searched."""
    s = Store(spark, str(tmp_path / "s"))
    s.insert(" . ".join([f"<n{k}> <next> <n{k + 1}>" for k in range(40)] + ["<a> <next> <b>", "<b> <next> <c>", "<c> <next> <a>", "<d> <next> <b>", "<d> <is> <start>"]))
    s.commit()
    s.options.most_steps = 4  # a closure of the chain would need 40
    assert got(s.query("select ?y where { <a> reaches ?y via <next> }")) == Counter({("a",): 1, ("b",): 1, ("c",): 1})
    assert got(s.query("select ?y where { ?y reaches <c> via <next> }")) == Counter({("a",): 1, ("b",): 1, ("c",): 1, ("d",): 1})
    assert got(s.query("select ?y where { ?x <is> <start> . ?x reaches ?y via <next> }")) == Counter({("a",): 1, ("b",): 1, ("c",): 1})
    with pytest.raises(RuntimeError):
        s.query("select ?x ?y where { ?x reaches ?y via <next> }")


def test_lines_of_ntriples_fail_alone(spark, tmp_path):
    from arcwell.sources.turtle import read_ntriples

    (tmp_path / "a.nt").write_text('<a> <p> <b>\n<c> <p> "good" .\n# a comment\n\n<d> <p> "open .\n<e> <p> <f> .\n')
    rows = read_ntriples(spark, [str(tmp_path / "a.nt")]).collect()
    assert {r["s"]["lex"] for r in rows if r["s"]} >= {"c", "e"} and sum(r["error"] is not None for r in rows) == 2
    assert all("a.nt" in r["error"] for r in rows if r["error"])


def test_locks_are_taken_together(spark, tmp_path):
    from arcwell.txn import Box, BulkOperation, Conflict, LockTable

    locks = LockTable()
    locks.acquire("a", Box(s=(5, 5)))
    with pytest.raises(Conflict):
        locks.acquire("b", [Box(s=(1, 1)), Box(s=(5, 9))])
    locks.acquire("c", Box(s=(1, 1)))  # b holds nothing
    s = Store(spark, str(tmp_path / "s"))
    one, two = BulkOperation(s, locks), BulkOperation(s, locks)
    one.insert_turtle("_:x <p> <a> .")
    two.insert_turtle("_:x <p> <b> .")
    one.commit()
    two.commit()
    assert s.query("select distinct ?x where { ?x <p> ?y }").count() == 2


def test_paths_in_both_directions_and_over_any_predicate(spark, tmp_path):
    """Ids as large as a store makes them: no step is taken for another."""
    facts = [(5, 1 << 33, 6), (6, (1 << 33) + 100_000_000, 7), (8, 1 << 33, 6), (7, 50_000_000, 9)]
    index = PathIndex.build(spark.createDataFrame(facts, "s long, p long, o long"), str(tmp_path / "i"), max_length=2, most_ratio=2.0, reverse=True, any_predicate=True)
    from arcwell.indexes import ANY

    steps = {(s, p, o) for s, p, o in facts} | {(o, ~p, s) for s, p, o in facts} | {(s, ANY, o) for s, _, o in facts}
    want = {}
    for s, p, o in steps:
        want.setdefault((p,), set()).add(o)
        for s2, p2, o2 in steps:
            if s2 == o and p2 != ~p:
                want.setdefault((p, p2), set()).add(o2)
    assert index.counts == {p: len(v) for p, v in want.items()}
    for path, nodes in want.items():
        assert sorted(r[0] for r in index.vertices(path).collect()) == sorted(nodes)
    assert "PartitionFilters: [isnotnull(part" in index.vertices(next(iter(want)))._jdf.queryExecution().toString()


def test_shapes_list_vertices_not_embeddings(spark, tmp_path):
    """Many subjects of few objects: two of them that share one are as many pairs as the square; lists and supports stay exact."""
    import random

    from arcwell.indexes import occurring

    hub = spark.range(300_000).selectExpr("id + 100 as s", "1L as p", "id % 2 as o").union(spark.sql("select 0L, 2L, 7L union all select 1L, 2L, 8L"))
    index = GraphIndex.build(hub, str(tmp_path / "hub"), max_edges=2, least=1, most_embeddings=1000)
    pair = next(s for s in index.shapes.values() if s.code == canonical([(0, 1, 1), (2, 1, 1)])[0])  # 4.5e10 embeddings
    assert pair.support == 2 and sorted(pair.counts) == [2, 300_000, 300_000]
    random.seed(5)
    facts = sorted({(random.randrange(7), random.choice((100, 200)), random.randrange(7)) for _ in range(26)})
    df = spark.createDataFrame(facts, "s long, p long, o long").cache()
    for code in ([(0, 1, 100), (1, 2, 200), (3, 1, 100)], [(0, 1, 100), (1, 2, 200), (2, 3, 200), (4, 2, 100)], [(0, 1, 100), (1, 0, 200)], [(0, 1, 100), (1, 2, 100), (2, 0, 200)], [(0, 1, 100), (1, 2, 200), (0, 2, 100), (2, 3, 200), (4, 3, 100)]):
        found = [{}]
        for a, b, p in code:
            found = [e | {a: s, b: o} for e in found for s, q, o in facts if q == p and e.get(a, s) == s and (e | {a: s}).get(b, o) == o]
        want = [sorted({e[k] for e in found}) for k in range(1 + max(max(e[:2]) for e in code))]
        assert [sorted(r["v"] for r in rows.collect()) for rows in occurring(df, code, 10**6)] == want
    assert occurring(df, [(0, 1, 100), (1, 2, 100), (2, 0, 200)], 3) is None


def test_terms_with_equal_hashes_stay_apart(spark, tmp_path, monkeypatch):
    """Hashes of five bits: base, deltas and a compacted store give what the model gives."""
    from arcwell import store as module

    monkeypatch.setattr(module, "ID_BITS", 5)
    s = Store(spark, str(tmp_path / "s"))
    rows = [(f"n{k}", "p" if k % 2 else "q", f"m{k % 7}") for k in range(60)]
    for some in (rows[:30], rows[20:50], rows[40:]):
        s.insert(" . ".join(f"<{a}> <{p}> <{b}>" for a, p, b in some))
        s.commit()
    for _ in range(2):
        ids = [r["id"] for r in s.terms().collect()]
        assert len(ids) == len(set(ids)) == 69
        assert sorted((r["s"]["lex"], r["p"]["lex"], r["o"]["lex"]) for r in s.triples().collect()) == sorted(rows)
        assert got(s.query("select ?a where { ?a <p> <m3> }")) == Counter((a,) for a, p, b in rows if (p, b) == ("p", "m3"))
        s.compact()
    s.insert("<n1> <p> <m1> , <m2>")
    s.commit()
    assert s.facts().count() == 61 and s.facts().distinct().count() == 61


def test_triples_become_ids_without_a_join(spark, tmp_path, monkeypatch):
    """The base load joins nothing: hot predicates and objects meet in no task."""
    joins = []
    plain = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, *a, **b: joins.append(1) or plain(self, *a, **b))
    s = Store(spark, str(tmp_path / "s"))
    s.add(spark.range(3000).selectExpr("struct(0 as type, concat('s', id % 1500) as lex, cast(null as string) as sub) as s", "struct(0 as type, 'p' as lex, cast(null as string) as sub) as p", "struct(1 as type, 'hot' as lex, cast(null as string) as sub) as o"))
    assert not joins and s.facts().count() == 1500 and s.terms().count() == 1502


def test_small_results_do_not_shuffle_a_large_dictionary(store, monkeypatch):
    from arcwell import store as module

    text = "select count ?y where { ?x <knows> ?y } order by desc(count) ?y"
    want = store.query(text).collect()
    monkeypatch.setattr(module, "LARGE", 0)
    found = store.query(text)
    assert found.collect() == want and len(want) > 1
    assert "BroadcastHashJoin [id" in found._jdf.queryExecution().executedPlan().toString()


def test_spread_joins(spark, store, monkeypatch):
    """Joins that make more than they get: the same rows, in cells of a bounded size, over as many tasks as the rows ask for."""
    import dataclasses

    from pyspark.sql import functions as F

    from arcwell.operators import solutions as op
    from arcwell.plans import optimizer

    monkeypatch.setattr(op, "CELL", 2)
    monkeypatch.setattr(op, "TASK_PAIRS", 500)
    a = spark.range(300).selectExpr("id as x", "if(id < 250, 0, id % 7) as n").union(spark.sql("select 5L, cast(null as bigint)"))
    b = spark.range(200).selectExpr("id % 150 as y", "if(id < 90, 0, id % 5) as n")
    cells = op.spread(a, b, ["n"])
    assert Counter(map(tuple, cells.collect())) == Counter(map(tuple, a.join(b, "n").collect()))
    sizes = [r[0] for r in cells.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert cells.rdd.getNumPartitions() > 20 and max(sizes) < 0.25 * sum(sizes)
    some = op.linked(a, b, ["n"])
    assert Counter(map(tuple, some.collect())) == Counter(map(tuple, a.join(b, "n").select("x", "y").distinct().collect()))
    # a plan takes them where its estimates say so
    monkeypatch.setattr(optimizer.Size, "joined", lambda self, other: dataclasses.replace(self, rows=1e9, values=self.values | other.values))
    for text in ("select ?a ?x ?b where { ?a <knows> ?x . ?b <knows> ?x }", "select distinct ?a ?b where { ?a <knows> ?x . ?b <knows> ?x . filter(?a != ?b) }", "select distinct ?a where { ?a <knows> ?x . ?b <knows> ?x }", "select count ?x where { ?a <knows> ?x . ?b <knows> ?x }", "select distinct ?a ?x ?l where { ?a <knows> ?x . ?b <knows> ?x . ?a <label> ?l }"):
        assert got(store.query(text)) == answer(text, GRAPH)
        assert "spread join" in store.explain(text)
