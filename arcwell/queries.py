"""Registered queries over the relational fixture, each with the SQL that gives the same rows.

Most are text of the query language on the graph of the tables; a second set builds
a store of a part of that graph and reads it back through ids, deltas, indexes and
statistics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell import stats
from arcwell.indexes import ANY, GraphIndex, PathIndex
from arcwell.plans.compile import Options, query
from arcwell.sources.relational import RelationalGraph
from arcwell.store import Store
from arcwell.terms import Term, iri, literal
from arcwell.txn import BulkOperation, Conflict, LockTable, cover
from arcwell.workload import UpdateConfig, analyzed, missing_and_extra, run_updates

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE_SQL: dict[str, str] = {}


def _ask(name: str, text: str, sql: str | None, options: Options | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(RelationalGraph(spark, sf_dir), text, options)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _store(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


CHAIN = "select count ?name where { ?o <o_cust> ?c . ?c <c_nation> ?n . ?n <n_region> ?r . ?r <r_name> ?name } order by desc(count)"
CHAIN_SQL = 'SELECT r_name AS name, count(*) AS "count" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name'
MONEY = "cast(cast({} AS decimal(18,2)) AS varchar)"

# scans
_ask("scan_p", "select ?n ?name where { ?n <n_name> ?name }", "SELECT 'nation/' || n_nationkey AS n, n_name AS name FROM nation")
_ask("scan_po", 'select ?c where { ?c <c_mktsegment> "BUILDING" }', "SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
_ask("scan_sp", "select ?s where { <customer/5> <c_mktsegment> ?s }", "SELECT c_mktsegment AS s FROM customer WHERE c_custkey = 5")
_ask("scan_spo", "select ?r where { <nation/3> <n_region> ?r . ?r <r_name> ?x . <nation/3> <n_region> ?r }", "SELECT 'region/' || n_regionkey AS r FROM nation WHERE n_nationkey = 3")
_ask("scan_spo_existence", "select ?name where { <nation/0> <n_region> <region/0> . ?r <r_name> ?name }", "SELECT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0)")
_ask("scan_p_var", "select ?p ?v where { <customer/7> ?p ?v }", f"SELECT 'c_name' AS p, c_name AS v FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'c_nation', 'nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'c_acctbal', {MONEY.format('c_acctbal')} FROM customer WHERE c_custkey = 7")
_ask("scan_o_var_predicate", "select ?s ?p where { ?s ?p <nation/4> }", "SELECT 'customer/' || c_custkey AS s, 'c_nation' AS p FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'supplier/' || s_suppkey, 's_nation' FROM supplier WHERE s_nationkey = 4")
_ask("scan_unknown_constant", "select ?x where { ?x <no_such_predicate> ?y }", "SELECT r_name AS x FROM region WHERE false")
_ask("agg_pair", "select count ?c where { ?o <o_cust> ?c }", "SELECT 'customer/' || o_custkey AS c, count(*) AS \"count\" FROM orders GROUP BY o_custkey")
_ask("agg_full", "select count ?p where { ?s ?p ?o . filter in(?p, <c_name>, <o_cust>, <l_part>, <s_nation>) }", "SELECT 'c_name' AS p, count(*) AS \"count\" FROM customer UNION ALL SELECT 'o_cust', count(*) FROM orders UNION ALL SELECT 'l_part', count(*) FROM lineitem UNION ALL SELECT 's_nation', count(*) FROM supplier")

# joins
_ask("chain3", "select ?c ?r where { ?c <c_nation> ?n . ?n <n_region> ?g . ?g <r_name> ?r }", "SELECT 'customer/' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_ask("chain4", CHAIN, CHAIN_SQL)
_ask("star3", "select ?name ?seg ?bal where { ?c <c_name> ?name ; <c_mktsegment> ?seg ; <c_acctbal> ?bal }", f"SELECT c_name AS name, c_mktsegment AS seg, {MONEY.format('c_acctbal')} AS bal FROM customer")
_ask("star5", "select ?o ?st ?pr ?d ?t where { ?o <o_orderstatus> ?st ; <o_orderpriority> ?pr ; <o_orderdate> ?d ; <o_totalprice> ?t ; <o_cust> <customer/1> }", f"SELECT 'order/' || o_orderkey AS o, o_orderstatus AS st, o_orderpriority AS pr, strftime(o_orderdate, '%Y-%m-%d') AS d, {MONEY.format('o_totalprice')} AS t FROM orders WHERE o_custkey = 1")
_ask("snowflake", "select count ?brand ?reg where { ?l <l_part> ?p ; <l_supp> ?s . ?p <p_brand> ?brand . ?s <s_nation> ?n . ?n <n_region> ?g . ?g <r_name> ?reg }", 'SELECT p_brand AS brand, r_name AS reg, count(*) AS "count" FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY p_brand, r_name')
_ask("triangle", "select count ?n where { ?l <l_order> ?o ; <l_supp> ?s . ?o <o_cust> ?c . ?c <c_nation> ?n . ?s <s_nation> ?n }", "SELECT 'nation/' || c_nationkey AS n, count(*) AS \"count\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY c_nationkey")
_ask("cycle_pairs", "select distinct ?a ?b where { ?a <s_nation> ?n . ?b <s_nation> ?n . filter(?a != ?b) }", "SELECT 'supplier/' || a.s_suppkey AS a, 'supplier/' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
_ask("cross_small", "select distinct ?r ?s where { ?x <r_name> ?r . ?c <c_mktsegment> ?s }", "SELECT DISTINCT r_name AS r, c_mktsegment AS s FROM region, customer")
_ask("repeat_var", "select ?x where { ?x ?p ?x }", "SELECT r_name AS x FROM region WHERE false")

# duplicates
_ask("distinct_segments", "select distinct ?s where { ?c <c_mktsegment> ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
_ask("distinct_star_all", "select distinct * where { ?c <c_mktsegment> ?seg ; <c_nation> <nation/2> }", "SELECT 'customer/' || c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_nationkey = 2")
_ask("reduced_priorities", "select reduced ?p where { ?o <o_orderpriority> ?p }", "SELECT DISTINCT o_orderpriority AS p FROM orders")
_ask("count_priorities", "select count ?p ?st where { ?o <o_orderpriority> ?p ; <o_orderstatus> ?st }", 'SELECT o_orderpriority AS p, o_orderstatus AS st, count(*) AS "count" FROM orders GROUP BY 1, 2')
_ask("duplicates_customers", "select duplicates ?c where { ?o <o_cust> ?c ; <o_orderstatus> \"P\" }", "SELECT 'customer/' || o_custkey AS c, count(*) AS \"count\" FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")

# order and limit
_ask("order_asc", "select ?name where { ?s <s_name> ?name } order by ?name limit 7", "SELECT s_name AS name FROM supplier ORDER BY s_name LIMIT 7")
_ask("order_desc", "select ?t ?o where { ?o <o_totalprice> ?t ; <o_cust> <customer/2> } order by desc(?t) ?o limit 5", f"SELECT {MONEY.format('o_totalprice')} AS t, 'order/' || o_orderkey AS o FROM orders WHERE o_custkey = 2 ORDER BY t DESC, o LIMIT 5")
_ask("order_count_limit", "select count ?b where { ?l <l_part> ?p . ?p <p_brand> ?b } order by desc(count) ?b limit 5", 'SELECT p_brand AS b, count(*) AS "count" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5')
_ask("order_unbound_key", "select ?name where { ?r <r_name> ?name } order by ?nothing ?name limit 3", "SELECT r_name AS name FROM region ORDER BY r_name LIMIT 3")
_ask("offset_limit", "select ?name where { ?n <n_name> ?name } order by ?name limit 4 offset 3", "SELECT n_name AS name FROM nation ORDER BY n_name LIMIT 4 OFFSET 3")
_ask("project_unbound", "select ?name ?none where { ?r <r_name> ?name }", "SELECT r_name AS name, cast(NULL AS varchar) AS none FROM region")

# unions
_ask("union2", "select ?x where { { ?x <c_nation> <nation/1> } union { ?x <s_nation> <nation/1> } }", "SELECT 'customer/' || c_custkey AS x FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 1")
_ask("union4_join", 'select distinct ?c where { { ?o <o_cust> ?c . ?o <o_orderstatus> "P" } union { ?c <c_mktsegment> "MACHINERY" } union { ?c <c_nation> <nation/3> } union { ?c <c_nation> <nation/5> . ?c <c_mktsegment> "FURNITURE" } . ?c <c_name> ?n }', "SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_nationkey = 3 OR (c_nationkey = 5 AND c_mktsegment = 'FURNITURE') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_ask("union_missing_var", "select ?n ?r ?s where { { ?n <n_region> ?r } union { ?n <r_name> ?s } }", "SELECT 'nation/' || n_nationkey AS n, 'region/' || n_regionkey AS r, NULL AS s FROM nation UNION ALL SELECT 'region/' || r_regionkey, NULL, r_name FROM region")
_ask("union_empty_branch", "select ?n where { { ?x <r_name> ?n } union { ?x <no_such> ?n } }", "SELECT r_name AS n FROM region")
_ask("nested_group", "select ?n where { { ?x <n_name> ?n . { ?x <n_region> <region/2> } } }", "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
_ask("union_count", "select count ?n where { { ?x <c_nation> ?n } union { ?x <s_nation> ?n } }", "SELECT 'nation/' || k AS n, count(*) AS \"count\" FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")

# filters
_ask("filter_eq", 'select ?c where { ?c <c_mktsegment> ?s . filter(?s = "HOUSEHOLD") }', "SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
_ask("filter_ne_const", 'select count ?s where { ?c <c_mktsegment> ?s . filter(?s != "HOUSEHOLD") }', "SELECT c_mktsegment AS s, count(*) AS \"count\" FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1")
_ask("filter_ne_var", "select count ?a where { ?l <l_order> ?o ; <l_supp> ?s . ?o <o_cust> ?c . ?c <c_nation> ?a . ?s <s_nation> ?b . filter(?a != ?b) }", "SELECT 'nation/' || c_nationkey AS a, count(*) AS \"count\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey")
_ask("filter_in", 'select ?n where { ?x <n_name> ?n ; <n_region> ?r . filter in(?r, <region/0>, <region/4>) }', "SELECT n_name AS n FROM nation WHERE n_regionkey IN (0, 4)")
_ask("filter_in_empty", "select ?n where { ?x <n_name> ?n . filter in(?n) }", "SELECT n_name AS n FROM nation WHERE false")
_ask("filter_and_or_not", 'select ?c where { ?c <c_mktsegment> ?s ; <c_nation> ?n . filter((?s = "BUILDING" || ?s = "AUTOMOBILE") && !(?n = <nation/0>)) }', "SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_nationkey <> 0")
_ask("filter_two_valued_not", "select ?name where { ?x <r_name> ?name . filter(!(?unbound < ?name)) }", "SELECT r_name AS name FROM region")
_ask("filter_lex_lt", 'select ?p ?z where { ?p <p_size> ?z . filter(?z < "3") }', "SELECT 'part/' || p_partkey AS p, cast(p_size AS varchar) AS z FROM part WHERE cast(p_size AS varchar) < '3'")
_ask("filter_lex_ge", 'select ?n where { ?x <n_name> ?n . filter(?n >= "NATION_2") }', "SELECT n_name AS n FROM nation WHERE n_name >= 'NATION_2'")
_ask("filter_typed_lt", "select ?p ?z where { ?p <p_size> ?z . filter(?z <= 5) }", "SELECT 'part/' || p_partkey AS p, cast(p_size AS varchar) AS z FROM part WHERE p_size <= 5", Options(typed=True))
_ask("arith_add", 'select ?p where { ?p <p_size> ?z . filter(?z + 1 = "11") }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size + 1 = 11")
_ask("arith_sub", 'select ?p where { ?p <p_size> ?z . filter(?z - 20 = "-5") }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size - 20 = -5")
_ask("arith_mul", 'select ?p where { ?p <p_size> ?z . filter(?z * 2 = "14") }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size * 2 = 14")
_ask("arith_div", 'select ?p where { ?p <p_size> ?z . filter(?z / 4 = "2.5") }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size = 10")
_ask("arith_div_zero", 'select ?c where { ?c <c_acctbal> ?a . filter(?a / 0 = "inf") }', "SELECT 'customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 0")
_ask("arith_neg", 'select ?p where { ?p <p_size> ?z . filter(-?z = "-7") }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size = 7")
_ask("str_of_iri", 'select ?n where { ?x <n_name> ?n . filter(str(?x) = "nation/6") }', "SELECT n_name AS n FROM nation WHERE n_nationkey = 6")
_ask("lang", 'select ?d where { ?d <text> ?t . filter(lang(?t) = "de") }', "SELECT 'document/' || doc_id AS d FROM documents WHERE lang = 'de'")
_ask("langmatches", 'select count ?s where { ?d <text> ?t ; <source> ?s . filter langMatches(?t, "fr") }', "SELECT source AS s, count(*) AS \"count\" FROM documents WHERE lang = 'fr' GROUP BY source")
_ask("datatype", 'select ?d where { ?d <quality> ?q . filter(datatype(?q) = "http://www.w3.org/2001/XMLSchema#integer") }', "SELECT 'document/' || doc_id AS d FROM labels")
_ask("datatype_custom", 'select count ?p where { ?o <o_orderdate> ?d ; <o_orderpriority> ?p . filter(datatype(?d) = "http://www.w3.org/2001/XMLSchema#date") }', 'SELECT o_orderpriority AS p, count(*) AS "count" FROM orders GROUP BY 1')
_ask("isiri", "select count ?p where { <nation/8> ?p ?v . filter isIRI(?v) }", "SELECT 'n_region' AS p, cast(1 AS bigint) AS \"count\"")
_ask("isliteral", "select ?v where { <nation/8> ?p ?v . filter isLiteral(?v) }", "SELECT n_name AS v FROM nation WHERE n_nationkey = 8")
_ask("sameterm", "select ?a where { ?a <c_nation> ?n . ?b <s_nation> ?m . ?b <s_name> ?w . filter(sameTerm(?n, ?m) && ?b = <supplier/1>) }", "SELECT 'customer/' || c_custkey AS a FROM customer WHERE c_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)")
_ask("bound", "select ?n where { { ?n <n_region> ?r } union { ?n <r_name> ?s } . filter(bound(?s)) }", "SELECT 'region/' || r_regionkey AS n FROM region")
_ask("regex", 'select ?n where { ?x <r_name> ?n . filter regex(?n, "A.*A") }', "SELECT r_name AS n FROM region WHERE regexp_full_match(r_name, 'A.*A')")
_ask("regex_flags", 'select ?n where { ?x <r_name> ?n . filter regex(?n, "a.*a", "i") }', "SELECT r_name AS n FROM region WHERE regexp_full_match(r_name, 'A.*A')")
_ask("call_registered", 'select ?n where { ?x <r_name> ?n . filter(<urn:arcwell:lower>(?n) = "asia") }', "SELECT r_name AS n FROM region WHERE lower(r_name) = 'asia'", Options(functions={"urn:arcwell:lower": F.lower}))
_ask("call_unknown", 'select ?n where { ?x <r_name> ?n . filter(<urn:none>(?n) = "asia" || ?n = "ASIA") }', "SELECT r_name AS n FROM region WHERE r_name = 'ASIA'")

# grammar
_ask("anon_node", "select ?n where { ?c <c_name> ?n ; <c_nation> [] ; <c_mktsegment> \"BUILDING\" . }", "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
_ask("nested_blank", 'select ?n where { ?c <c_name> ?n ; <c_nation> [ <n_region> [ <r_name> "ASIA" ] ] }', "SELECT c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_ask("prefix", "prefix c: <c_> select ?n where { <customer/9> c:name ?n }", "SELECT c_name AS n FROM customer WHERE c_custkey = 9")
_ask("pred_obj_lists", "select ?x where { ?x <n_region> ?r ; <n_name> ?n , ?n . ?x :n_region <region/1> }", "SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1")
_ask("missing_dots", "select ?x where { ?x <n_region> <region/1> ?x <n_name> ?n }", "SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 1")
_ask("variable_predicate_join", "select distinct ?p where { ?c <c_name> ?n . ?c ?p <nation/2> }", "SELECT 'c_nation' AS p")
_ask("optional", "select ?n ?d where { ?n <source> \"src1\" . optional { ?n <quality> ?d } }", "SELECT 'document/' || documents.doc_id AS n, cast(quality AS varchar) AS d FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src1'")


def _doubled(t: Term | None):
    if t is not None:
        for k in ("a", "b"):
            yield (Term(t.type, f"{t.lex}-{k}", t.sub),)


_ask("table_function", 'select ?n ?m where { ?x <r_name> ?n . filter <urn:arcwell:tableFunction>("doubled", "1", ?n, ?m) }', "SELECT r_name AS n, r_name || '-' || k AS m FROM region, (SELECT 'a' AS k UNION ALL SELECT 'b')", Options(table_functions={"doubled": _doubled}))


_ask("optional_count", "select count ?name where { ?c <c_nation> ?n . ?n <n_name> ?name . optional { ?s <s_nation> ?n } }", 'SELECT n_name AS name, count(*) AS "count" FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name')
_ask("optional_count_unmatched", "select count ?n ?m where { ?n <n_name> ?m . optional { ?o <o_cust> ?n } }", "SELECT 'nation/' || n_nationkey AS n, n_name AS m, 1::BIGINT AS \"count\" FROM nation")
_ask("optional_duplicates", "select duplicates ?name where { ?n <n_name> ?name . optional { ?s <s_nation> ?n } }", 'SELECT n_name AS name, count(*) AS "count" FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 2')
_ask("optional_distinct", "select distinct ?name ?seg where { ?n <n_name> ?name . optional { ?c <c_nation> ?n ; <c_mktsegment> ?seg . ?o <o_cust> ?c . filter(?seg < \"C\") } }", "SELECT DISTINCT n_name AS name, c_mktsegment AS seg FROM nation LEFT JOIN (SELECT * FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment < 'C') ON c_nationkey = n_nationkey")
_ask("optional_unshared", 'select ?r ?n where { ?x <r_name> ?r . optional { ?y <n_name> ?n . filter(?n < "NATION_2") } }', "SELECT r_name AS r, n_name AS n FROM region LEFT JOIN (SELECT n_name FROM nation WHERE n_name < 'NATION_2') ON true")
_ask("optional_unshared_empty", 'select count ?r ?n where { ?x <r_name> ?r . optional { ?y <n_name> ?n . filter(?n = "none") } }', "SELECT r_name AS r, NULL::VARCHAR AS n, 1::BIGINT AS \"count\" FROM region")
_ask("null_order", "select ?name ?s where { ?n <n_name> ?name . optional { ?s <s_nation> ?n . filter(?s = <supplier/1> || ?s = <supplier/2>) } } order by desc(?s) ?name limit 7", "SELECT n_name AS name, 'supplier/' || s_suppkey AS s FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey IN (1, 2)) ON s_nationkey = n_nationkey ORDER BY s DESC NULLS LAST, name LIMIT 7")
_ask("typed_constant", 'select ?p where { ?p <p_size> "7"^^<http://www.w3.org/2001/XMLSchema#integer> }', "SELECT 'part/' || p_partkey AS p FROM part WHERE p_size = 7")
_ask("untyped_constant", 'select count ?p where { { ?p <p_size> "7" } union { ?p <p_brand> ?b . ?p <p_size> 7 } }', "SELECT 'part/' || p_partkey AS p, 1::BIGINT AS \"count\" FROM part WHERE p_size = 7")
_ask("reaches_from_end", "select count ?n where { ?c reaches <region/1> via <n_region> . ?c <n_name> ?n }", 'SELECT n_name AS n, 1::BIGINT AS "count" FROM nation WHERE n_regionkey = 1')


# stores: a part of the graph in ids


def folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a temporary one where none is named and all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="arcwell-store-")


PART = ["r_name", "n_name", "n_region", "c_nation", "c_mktsegment", "s_nation"]


def build(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None) -> Store:
    store = Store(spark, folder(spark))
    store.add(RelationalGraph(spark, sf_dir).triples(predicates or PART))
    return store


_built: dict[tuple, str] = {}


def built(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None) -> Store:
    """A store that is only read: built once in an application for the same tables and predicates."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(predicates or PART))
    if key not in _built:
        _built[key] = build(spark, sf_dir, predicates).path
    return Store(spark, _built[key])


PART_ROWS = "SELECT 'region/' || r_regionkey AS s, 'r_name' AS p, r_name AS o FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'n_name', n_name FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'n_region', 'region/' || n_regionkey FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'c_nation', 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 's_nation', 'nation/' || s_nationkey FROM supplier"
STORE_CHAIN = "select count ?name where { ?c <c_nation> ?n . ?n <n_region> ?r . ?r <r_name> ?name }"
STORE_CHAIN_SQL = 'SELECT r_name AS name, count(*) AS "count" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name'


@_store("store_triples", PART_ROWS)
def store_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).triples().select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@_store("store_chain", STORE_CHAIN_SQL)
def store_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).query(STORE_CHAIN)


@_store("store_text_filter", "SELECT n_name AS n, 'nation/' || n_nationkey AS x FROM nation WHERE n_name < 'NATION_2'")
def store_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).query('select ?x ?n where { ?x <n_name> ?n . filter(?n < "NATION_2") }')


@_store("delta_read", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 3 UNION ALL SELECT 'ATLANTIS'")
def delta_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["n_name", "n_region"])
    store.insert('insert data { <nation/900> <n_region> <region/1> ; <n_name> "ATLANTIS" . <nation/3> <n_region> <region/1> }')
    store.commit()
    return store.query("select distinct ?n where { ?x <n_region> <region/1> ; <n_name> ?n . filter(?x != <nation/3>) }")


@_store("delta_rollback", "SELECT n_name AS n FROM nation")
def delta_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["n_name"])
    store.insert('<nation/900> <n_name> "ATLANTIS"')
    store.rollback()
    store.commit()
    return store.query("select ?n where { ?x <n_name> ?n }")


@_store("compact", "SELECT r_name AS n FROM region UNION ALL SELECT 'NOWHERE'")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["r_name"])
    for _ in range(2):
        store.insert('<region/9> <r_name> "NOWHERE"')
        store.commit()
    store.compact()
    return store.query("select ?n where { ?x <r_name> ?n }")


@_store("as_of", "SELECT r_name AS n FROM region")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["r_name"])
    store.insert('<region/9> <r_name> "NOWHERE"')
    store.commit()
    return Store(spark, store.path, as_of=1).query("select ?n where { ?x <r_name> ?n }")


@_store("bulk_operation", "SELECT r_name AS n FROM region UNION ALL SELECT 'BULK'")
def bulk_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["r_name"])
    locks = LockTable()
    for name, done in (("BULK", True), ("LOST", False)):
        op = BulkOperation(store, locks)
        op.insert(iri("region/9"), iri("r_name"), literal(name))
        op.commit() if done else op.abort()
    return store.query("select ?n where { ?x <r_name> ?n }")


@_store("turtle_roundtrip", PART_ROWS)
def turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir)
    path = folder(spark)
    store.dump(path + "/dump.nt")
    again = Store(spark, path + "/store")
    again.load([path + "/dump.nt"])
    return again.triples().select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@_store("result_sink", "SELECT '<region/' || r_regionkey || '> \"' || r_name || '\"' AS line FROM region")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcwell.plans.compile import plan

    return plan(RelationalGraph(spark, sf_dir), "select ?x ?n where { ?x <r_name> ?n }").rendered()


def _names(store: Store) -> dict[int, str]:
    """Names of a store's few predicates."""
    found = store.facts().select("p").distinct().join(store.terms(), F.col("p") == F.col("id")).select("p", "lex").collect()
    return {r["p"]: r["lex"] for r in found}


def _named(names: dict[int, str]):
    pairs = [F.lit(x) for i, n in names.items() for x in (i, n)]
    return F.create_map(*pairs)


@_store("cset_counts", "SELECT predicates, count(*) AS \"count\" FROM (SELECT s, array_to_string(list_sort(list(DISTINCT p)), ',') AS predicates FROM (" + PART_ROWS + ") GROUP BY s) GROUP BY predicates")
def cset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    names = _named(_names(store))
    sets = stats.characteristic_sets(store.facts(), incoming=False)
    return sets.select(F.array_join(F.array_sort(F.transform("predicates", lambda p: names[p])), ",").alias("predicates"), "count")


@_store("cset_superset", "SELECT count(*) AS n FROM customer")
def cset_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    ids = [store.id_of(iri(p)) for p in ("c_nation", "c_mktsegment")]
    return spark.createDataFrame([(stats.superset_count(stats.characteristic_sets(store.facts(), False), ids),)], "n long")


@_store("pair_stats", "SELECT a.p AS p1, b.p AS p2, count(DISTINCT a.s) AS \"count\" FROM (" + PART_ROWS + ") a JOIN (" + PART_ROWS + ") b ON a.s = b.s AND a.p < b.p GROUP BY 1, 2")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    names = _named(_names(store))
    a, b = names[F.col("p1")], names[F.col("p2")]
    return stats.pair_stats(store.facts(), incoming=False).select(F.least(a, b).alias("p1"), F.greatest(a, b).alias("p2"), "count")


@_store("pattern_counts", "SELECT p, count(*) AS \"count\", count(DISTINCT o) AS objects FROM (" + PART_ROWS + ") GROUP BY p")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    names = _named(_names(store))
    return stats.Statistics(store.facts()).pairs("p", "o").groupBy("p").agg(F.sum("count").alias("count"), F.count("*").alias("objects")).select(names[F.col("p")].alias("p"), "count", "objects")


@_store("join_size", "SELECT cast(count(*) AS bigint) AS n FROM (" + PART_ROWS + ") a JOIN (" + PART_ROWS + ") b ON a.o = b.s")
def join_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(stats.Statistics(built(spark, sf_dir).facts()).join_size("o", "s"),)], "n long")


@_store("star_estimate", "SELECT cast(count(*) AS double) AS n FROM customer")
def star_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    ids = [store.id_of(iri(p)) for p in ("c_nation", "c_mktsegment")]
    return spark.createDataFrame([(stats.star_estimate(stats.star_sets(store.facts()), ids),)], "n double")


@_store("schema_classes", "SELECT 'c_mktsegment,c_nation' AS predicates, count(*) AS \"count\" FROM customer UNION ALL SELECT 'n_name,n_region', count(*) FROM nation UNION ALL SELECT 'r_name', count(*) FROM region UNION ALL SELECT 's_nation', count(*) FROM supplier")
def schema_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    names = _names(store)
    rows = [(",".join(sorted(names[p] for p in c)), n) for c, n in stats.schema_classes(store.facts())]
    return spark.createDataFrame(rows, "predicates string, count long")


@_store("path_vlist_2", "SELECT DISTINCT 'region/' || n_regionkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_vlist_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir)
    index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=2.0)
    ids = tuple(store.id_of(iri(p)) for p in ("c_nation", "n_region"))
    return store.decode(index.vertices(ids), ["v"]).select(F.col("v.lex").alias("v"))


@_store("path_filtered_query", STORE_CHAIN_SQL)
def path_filtered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir)
    store.path_index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=2.0)
    return store.query(STORE_CHAIN)


@_store("multiway_star", "SELECT 'nation/' || n_nationkey AS n, n_name AS name, 'customer/' || c_custkey AS c, 'supplier/' || s_suppkey AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def multiway_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(RelationalGraph(spark, sf_dir), "select ?n ?name ?c ?s where { ?n <n_region> <region/1> ; <n_name> ?name . ?c <c_nation> ?n . ?s <s_nation> ?n }")


@_store("graph_support", "SELECT least(count(DISTINCT c_custkey), count(DISTINCT n_nationkey), count(DISTINCT n_regionkey)) AS support FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcwell.indexes import canonical

    store = build(spark, sf_dir, ["n_region", "c_nation"])
    index = GraphIndex.build(store.facts(), folder(spark), max_edges=2, least=1)
    a, b = (store.id_of(iri(p)) for p in ("c_nation", "n_region"))
    return spark.createDataFrame([(index.shapes[canonical([(0, 1, a), (1, 2, b)])[0]].support,)], "support long")


@_store("graph_filtered_query", STORE_CHAIN_SQL)
def graph_filtered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["r_name", "n_region", "c_nation"])
    store.graph_index = GraphIndex.build(store.facts(), folder(spark), max_edges=2, least=1)
    return store.query(STORE_CHAIN)


@_store("reaches", "SELECT DISTINCT r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 1")
def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(RelationalGraph(spark, sf_dir), "select ?name where { ?r <r_name> ?name . <nation/1> reaches ?r via <n_region> }")


# stores over the large tables, and several commits

FACT_PREDICATES = ["l_order", "l_part", "l_returnflag", "o_cust", "o_orderpriority", "c_nation"]
FACT_ROWS = "SELECT 'l_order' AS p, 'order/' || l_orderkey AS o FROM lineitem UNION ALL SELECT 'l_part', 'part/' || l_partkey FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'o_cust', 'customer/' || o_custkey FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'c_nation', 'nation/' || c_nationkey FROM customer"


@_store("store_lineitem_chain", "SELECT o_orderpriority AS priority, 'nation/' || c_nationkey AS n, count(*) AS \"count\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def store_lineitem_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, FACT_PREDICATES).query("select count ?priority ?n where { ?l <l_order> ?o . ?o <o_orderpriority> ?priority . ?o <o_cust> ?c . ?c <c_nation> ?n }")


@_store("store_lineitem_star", "SELECT 'part/' || l_partkey AS part, count(*) AS \"count\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def store_lineitem_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, FACT_PREDICATES).query('select count ?part where { ?l <l_part> ?part ; <l_returnflag> "R" ; <l_order> ?o . ?o <o_orderpriority> "1-URGENT" } order by desc(count) ?part limit 20')


@_store("store_lineitem_counts", "SELECT p, count(*) AS \"count\", count(DISTINCT o) AS objects FROM (" + FACT_ROWS + ") GROUP BY p")
def store_lineitem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = built(spark, sf_dir, FACT_PREDICATES)
    names = _named(_names(store))
    return stats.Statistics(store.facts()).pairs("p", "o").groupBy("p").agg(F.sum("count").alias("count"), F.count("*").alias("objects")).select(names[F.col("p")].alias("p"), "count", "objects")


@_store("two_deltas_overlap", "SELECT 'customer/' || c_custkey AS c, 'nation/' || c_nationkey AS n FROM customer")
def two_deltas_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that overlap in a third of their rows: a scan has each fact once."""
    whole = RelationalGraph(spark, sf_dir).triples(["c_nation"])
    part = F.pmod(F.xxhash64("s"), F.lit(3))
    store = Store(spark, folder(spark))
    for some in ((0, 1), (1, 2), (2, 0)):
        store.add(whole.where(part.isin(*some)))
    return store.query("select ?c ?n where { ?c <c_nation> ?n }")


@_store("as_of_after_compact", "SELECT time, count(*) AS n FROM (SELECT c_custkey % 3 AS k FROM customer) JOIN (VALUES (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) AS x(time, k2) ON k = k2 GROUP BY time")
def as_of_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, compaction, a third one: each time sees what was there."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    node = lambda prefix, c: F.struct(F.lit(iri("x").type).alias("type"), F.concat(F.lit(prefix), c.cast("string")).alias("lex"), F.lit(None).cast("string").alias("sub"))
    store = Store(spark, folder(spark))
    for k in range(3):
        rows = customers.where(F.col("c_custkey") % 3 == k)
        store.add(rows.select(node("customer/", F.col("c_custkey")).alias("s"), node("c_nation", F.lit("")).alias("p"), node("nation/", F.col("c_nationkey")).alias("o")))
        if k == 1:
            store.compact()
    parts = [Store(spark, store.path, as_of=t).query("select ?c where { ?c <c_nation> ?n }").agg(F.lit(t).alias("time"), F.count("*").alias("n")) for t in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@_store("isblank", "SELECT 'BLANK' AS n UNION ALL SELECT r_name FROM region WHERE r_name < 'ASIB'")
def isblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = build(spark, sf_dir, ["r_name"])
    store.insert('_:x <r_name> "BLANK"')
    store.commit()
    return store.query('select ?n where { ?x <r_name> ?n . filter(isBlank(?x) || ?n < "ASIB") }')


@_store("lock_conflict", "SELECT r_name AS n FROM region UNION ALL SELECT 'FIRST' UNION ALL SELECT 'SECOND'")
def lock_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second writer meets a lock, has none of its own then, and succeeds once the first has ended."""
    store, locks = build(spark, sf_dir, ["r_name"]), LockTable()
    first, second = BulkOperation(store, locks), BulkOperation(store, locks)
    first.insert(iri("region/9"), iri("r_name"), literal("FIRST"))
    second.insert(iri("region/9"), iri("r_name"), literal("SECOND"))
    first.lock(first.boxes()[0])
    try:
        second.commit()
        raise RuntimeError("no conflict")
    except Conflict:
        first.commit()
        second.commit()
    return store.query("select ?n where { ?x <r_name> ?n }")


TURTLE = """@base <http://base/> .
@prefix e: <http://e/> .
PREFIX f: <http://f/>
<a> a e:Thing ; e:says "one \\"two\\" \\u00e9"@en , '''long
text'''  ; f:n 5 , 1.5 , 2e3 , true .
e:b f:list ( "x" [ f:deep "y" ] ) .
bad line here
_:k e:says "blank" ; f:typed "7"^^f:kind .
"""


@_store("turtle_document", "SELECT * FROM (VALUES ('http://base/a', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://e/Thing'), ('http://base/a', 'http://e/says', 'one \"two\" é'), ('http://base/a', 'http://e/says', 'long' || chr(10) || 'text'), ('http://base/a', 'http://f/n', '5'), ('http://base/a', 'http://f/n', '1.5'), ('http://base/a', 'http://f/n', '2e3'), ('http://base/a', 'http://f/n', 'true'), ('blank', 'http://f/deep', 'y'), ('blank', 'http://e/says', 'blank'), ('blank', 'http://f/typed', '7'), ('error', NULL, NULL)) AS x(s, p, o)")
def turtle_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, prefixes, a, lists of objects and predicates, literals of all kinds, blank nodes, escapes, and a bad line."""
    at = folder(spark)
    spark.createDataFrame([(TURTLE,)], "value string").coalesce(1).write.text(at + "/in")
    store = Store(spark, at + "/store")
    errors = store.load([at + "/in"], ntriples=False).select(F.lit("error").alias("s"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("o"))
    found = store.triples().select("s.lex", F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))
    found = found.where(~F.col("p").rlike("(#first|#rest|/list)$"))
    return found.select(F.when(F.col("lex").startswith("_:"), F.lit("blank")).otherwise(F.col("lex")).alias("s"), "p", "o").union(errors)


@_store("path_vlist_reverse", "SELECT DISTINCT 'customer/' || c_custkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_vlist_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From regions against the direction of both predicates."""
    store = build(spark, sf_dir)
    index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=2.0, reverse=True)
    ids = tuple(~store.id_of(iri(p)) for p in ("n_region", "c_nation"))
    return store.decode(index.vertices(ids), ["v"]).select(F.col("v.lex").alias("v"))


@_store("path_vlist_any", "SELECT n_name AS v FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION SELECT 'region/' || n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def path_vlist_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step over a predicate, one over any."""
    store = build(spark, sf_dir)
    index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=2.0, any_predicate=True)
    return store.decode(index.vertices((store.id_of(iri("c_nation")), ANY)), ["v"]).select(F.col("v.lex").alias("v"))


@_store("path_pruned", "WITH t AS (" + PART_ROWS + "), ends AS (SELECT p, count(DISTINCT o) AS n FROM t GROUP BY p) SELECT p AS path, n FROM ends UNION ALL SELECT * FROM (SELECT a.p || ',' || b.p AS path, count(DISTINCT b.o) AS n FROM t a JOIN t b ON a.o = b.s GROUP BY a.p, b.p HAVING count(DISTINCT b.o) < 0.99 * (SELECT n FROM ends WHERE ends.p = b.p))")
def path_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that pruning keeps, and the length of their lists."""
    store = build(spark, sf_dir)
    index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=0.99)
    names = _names(store)
    return spark.createDataFrame([(",".join(names[p] for p in path), n) for path, n in index.counts.items()], "path string, n long")


@_store("multiway_star_lists", "SELECT 'nation/' || n_nationkey AS n, n_name AS name, 'customer/' || c_custkey AS c, 'supplier/' || s_suppkey AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def multiway_star_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star whose inputs the vertex lists of both indexes reduce first."""
    store = build(spark, sf_dir, ["n_region", "n_name", "c_nation", "s_nation"])
    store.path_index = PathIndex.build(store.facts(), folder(spark), max_length=2, most_ratio=0.8)
    store.graph_index = GraphIndex.build(store.facts(), folder(spark), max_edges=2, least=1)
    return store.query("select ?n ?name ?c ?s where { ?n <n_region> <region/1> ; <n_name> ?name . ?c <c_nation> ?n . ?s <s_nation> ?n }")


@_store("expected_observed", "SELECT '?c c_nation ?n' AS step, count(*) AS observed FROM customer UNION ALL SELECT '?n n_region region/1', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'join ?c c_nation ?n', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def expected_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyzed(build(spark, sf_dir, ["n_region", "c_nation"]), "select * where { ?c <c_nation> ?n . ?n <n_region> <region/1> }")
    # which pattern a join adds is the planner's choice
    return found.select(F.when(F.col("step").startswith("join"), F.lit("join ?c c_nation ?n")).otherwise(F.col("step")).alias("step"), "observed")


@_store("update_harness", "SELECT count(*) AS n, 0::BIGINT AS missing, 0::BIGINT AS extra FROM customer")
def update_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An initial load and three chunks with a query between, then compared with what was committed."""
    store, rows = Store(spark, folder(spark)), RelationalGraph(spark, sf_dir).triples(["c_nation"])
    run_updates(store, rows, UpdateConfig(40, 20, 3, 1, 0, 0, ("select count ?n where { ?c <c_nation> ?n }",)))
    missing, extra = missing_and_extra(store, rows)
    return spark.createDataFrame([(store.facts().count(), missing, extra)], "n long, missing long, extra long")


@_store("turtle_abbreviated", PART_ROWS)
def turtle_abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump with `;` and `,` read back."""
    store, at = build(spark, sf_dir), folder(spark)
    store.dump(at + "/dump", abbreviated=True)
    again = Store(spark, at + "/store")
    again.load([at + "/dump"], ntriples=False)
    return again.triples().select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@_store("term_lookup", "SELECT 'nation/' || n_nationkey AS name, 'nation/' || n_nationkey AS back FROM nation UNION ALL SELECT 'nation/none', NULL")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to ids by one pass, and ids to names."""
    store = build(spark, sf_dir, ["n_region"])
    names = [r["lex"] for r in store.terms().where(F.col("lex").startswith("nation/")).select("lex").collect()] + ["nation/none"]
    ids = store.lookup([iri(n) for n in names])
    rows = spark.createDataFrame([(n, ids[iri(n)]) for n in names], "name string, back long")
    return store.decode(rows, ["back"]).select("name", F.col("back.lex").alias("back"))


@_store("relational_export", "SELECT '<customer/' || c_custkey || '>' AS s, '\"' || c_mktsegment || '\"' AS o FROM customer")
def relational_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate's table of an export, its ids resolved by the exported strings."""
    store, at = build(spark, sf_dir, ["c_mktsegment", "c_nation"]), folder(spark)
    store.export_relational(at)
    facts, strings = spark.read.parquet(at + "/properties"), spark.read.parquet(at + "/strings")
    rows = facts.where(F.col("p") == store.id_of(iri("c_mktsegment")))
    return rows.join(strings.toDF("subject", "s"), "subject").join(strings.toDF("object", "o"), "object").select("s", "o")


@_store("stream_insert", "SELECT 'nation/' || c_nationkey AS n, count(*) AS \"count\" FROM customer GROUP BY 1")
def stream_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows, committed batch by batch."""
    from arcwell.streaming.ingest import insert_stream

    kind = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    at = folder(spark)
    store = Store(spark, at + "/store")
    node = lambda prefix, c: F.struct(F.lit(iri("x").type).alias("type"), F.concat(F.lit(prefix), c.cast("string")).alias("lex"), F.lit(None).cast("string").alias("sub"))
    triples = lambda rows: rows.select(node("customer/", F.col("c_custkey")).alias("s"), node("c_nation", F.lit("")).alias("p"), node("nation/", F.col("c_nationkey")).alias("o"))
    insert_stream(store, spark.readStream.schema(kind).parquet(f"{sf_dir}/custome[r].parquet"), triples, at + "/checkpoint").awaitTermination()
    return store.query("select count ?n where { ?c <c_nation> ?n }")


@_store("lock_cover", "SELECT count(*) AS n, count(*) AS inside, true AS few FROM customer")
def lock_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over the ids of a predicate hold all its triples."""
    facts = build(spark, sf_dir, ["c_nation"]).facts()
    boxes = cover(facts, 8)
    held = F.lit(False)
    for b in boxes:
        held = held | (F.col("s").between(*b.s) & F.col("p").between(*b.p) & F.col("o").between(*b.o))
    return facts.agg(F.count("*").alias("n"), F.count_if(held).alias("inside")).withColumn("few", F.lit(1 < len(boxes) <= 8))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(RelationalGraph(spark, sf_dir), CHAIN)


#: What bench.py times.
HEADLINE = ["scan_po", "agg_pair", "chain3", "chain4", "star3", "snowflake", "triangle", "filter_ne_var", "union4_join", "order_count_limit", "distinct_segments", "langmatches", "cross_small", "store_chain", "store_lineitem_chain", "store_lineitem_counts", "two_deltas_overlap", "cset_counts", "path_filtered_query"]
