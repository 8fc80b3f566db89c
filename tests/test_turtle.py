from arcwell.sources.turtle import parse, read_ntriples, read_turtle, write_ntriples, abbreviated
from arcwell.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, STRING, TYPE, Term, iri, literal, render

TEXT = r'''
@prefix e: <http://e/> .
@base <http://b/> .
e:a a e:C ; e:p "x" , "y"@en-GB , "z"^^<http://www.w3.org/2001/XMLSchema#string> , 1 , -2.5 , 1e3 , true ; .
<rel> e:q """long
"quoted" é \U0001F600""" .
_:n e:q [ e:r e:s ] .
[ e:t "u" ] .
( 1 2 ) e:list () .
'''


def test_everything():
    found, errors = parse(TEXT)
    assert errors == []
    a = iri("http://e/a")
    p = iri("http://e/p")
    assert (a, iri(TYPE), iri("http://e/C")) in found
    assert [o for s, q, o in found if (s, q) == (a, p)] == [literal("x"), literal("y", lang="en-GB"), Term(STRING, "z"), Term(INTEGER, "1"), Term(DECIMAL, "-2.5"), Term(DOUBLE, "1e3"), Term(BOOLEAN, "true")]
    assert (iri("http://b/rel"), iri("http://e/q"), literal('long\n"quoted" é 😀')) in found
    assert sum(q == iri(RDF + "first") for _, q, _ in found) == 2


def test_recovers_at_the_next_line():
    found, errors = parse("<a> <b> <c> .\n<a> <b> oops .\n<d> <e> \"f\" .\n<x> <y> u:z .\n")
    assert [s.lex for s, _, _ in found] == ["a", "d"] and [line for line, _ in errors] == [2, 4]


def test_render_round_trip():
    for t in (iri("http://x/a>b\\c"), literal('q"\\\n\t'), literal("x", lang="de"), literal("1", datatype="http://dt"), Term(INTEGER, "01"), iri("_:n")):
        assert parse(f"<s> <p> {render(t)} .")[0][0][2] == t


def test_files(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <p> "1" .\nbad line\n<b> <p> _:x .\n')
    rows = read_ntriples(spark, str(tmp_path / "a.nt")).collect()
    assert sorted(r["s"]["lex"] for r in rows if r["s"]) == ["a", "b"] and sum(r["error"] is not None for r in rows) == 1
    (tmp_path / "b.ttl").write_text(TEXT)
    whole = read_turtle(spark, [str(tmp_path / "b.ttl")])
    assert whole.where("error is not null").count() == 0 and whole.count() == len(parse(TEXT)[0])
    triples = whole.select("s", "p", "o")
    write_ntriples(triples, str(tmp_path / "out.nt"))
    again = read_ntriples(spark, str(tmp_path / "out.nt")).select("s", "p", "o")
    assert again.exceptAll(triples).count() == 0 and again.count() == triples.count()
    lines = "\n".join(r[0] for r in abbreviated(triples).collect())
    assert len(parse(lines)[0]) == triples.distinct().count() and not parse(lines)[1]
