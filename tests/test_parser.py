import pytest

from arcwell.plans.parser import Expr, Pattern, Term, Var, parse
from arcwell.terms import DECIMAL, DOUBLE, INTEGER, LANGUAGE, TYPE, iri, literal
from arcwell.plans.parser import ParseError

ACCEPTED = [
    "select ?x where { ?x <p> ?y }",
    "SELECT DISTINCT $x WHERE { $x a <C> . }",
    "select * { ?x <p> ?y . ?y <q> \"a\"@en }",
    "prefix u: <http://u/> select ?n where { ?p a u:P ; u:by [ u:name \"C\" ] ; u:name ?n }",
    "select count ?p where { { ?x a <T> } union { ?x <r> [] ; a <T> } ?x ?p []. filter in(?p, <a>, <b>) }",
    "select duplicates ?x where { ?x <p> ?y } order by desc(count) ?x limit 3",
    "select ?a where { ?a [] ?c filter (?a != ?c) } # comment",
    "select ?a where { ?a <p> ?b . filter(?a<?b&&?b>3) }",
    "select ?a where { ?t reaches \"x\" via <sub> . ?t <p> ?a }",
    "select ?a where { ?t <p> ?a . filter(?t reaches <x> via <sub>) }",
    "select ?a where { ?a <p> 1 , 2.5 , 1e3 , true ; <q> 'x' ; . }",
    "select reduced ?a where { ?a <p> ?b . optional { ?b <q> ?c } } limit 2 offset 1",
]
REJECTED = ["", "select where { }", "select ?x from <g> where { ?x <p> ?y }", "select ?x where { ?x <p> }", "select ?x where { ?x <p> ?y", "select ?x where { ?x u:p ?y }", "select ?x where { ?x <p> ?y } limit 0", "ask { ?x <p> ?y }", "select ?x where { ?x <p> ?y } extra"]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepts(text):
    parse(text)


@pytest.mark.parametrize("text", REJECTED)
def test_rejects(text):
    with pytest.raises(ParseError):
        parse(text)


def test_tree():
    q = parse('select ?x where { ?x a <C> ; <p> "v"^^<http://www.w3.org/2001/XMLSchema#integer> . filter(1 + 2 * 3 <= -?x || !bound(?x)) }')
    assert q.where.patterns == (Pattern(Var("x"), iri(TYPE), iri("C")), Pattern(Var("x"), iri("p"), Term(INTEGER, "v")))
    (e,) = q.where.filters
    assert e.op == "||" and e.args[0].op == "<=" and e.args[1] == Expr("!", (Expr("bound", ("x",)),))
    assert e.args[0].args[0].op == "+" and e.args[0].args[0].args[1].op == "*"


def test_literals():
    q = parse('select * { ?x <p> "a\\n\\u00e9"@de , 2.5 , 1e3 , """long "quoted" text""" }')
    assert [p.o for p in q.where.patterns] == [Term(LANGUAGE, "a\né", "de"), Term(DECIMAL, "2.5"), Term(DOUBLE, "1e3"), literal('long "quoted" text')]


def test_star_is_alphabetical_and_without_blank_nodes():
    assert parse("select * { ?b <p> [ <q> ?a ] . _:n <r> ?c }").output() == ("a", "b", "c")


def test_and_is_split():
    assert len(parse("select ?x { ?x <p> ?y . filter(?x = ?y && ?y = 1 && (?x = 2 || ?x = 3)) }").where.filters) == 3
