"""Some registered queries against DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from arcwell.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["scan_p_var", "chain4", "triangle", "duplicates_customers", "union_missing_var", "filter_typed_lt", "optional", "table_function", "order_count_limit", "delta_read", "path_filtered_query", "pair_stats"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = db.execute(ORACLE_SQL[name])
    places = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[k] for k in places)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
