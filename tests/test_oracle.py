"""Every query of the warehouse against its SQL, on whole tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from rillhouse import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    assert ordered(got) == ordered(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry_module.queries()) == set(QUERIES)
    assert set(entry_module.oracle_sql()) == set(ORACLE)


# Row counts at sf0.01 that the bindings are meant to give.
COUNTS = {
    "trade_order_pre_process": 110_345,
    "trade_order_detail": 60_000,
    "trade_cancel_detail": 20_488,
    "trade_pay_detail_all": 60_200,
    "trade_pay_detail_success": 19_856,
    "trade_cart_add": 3_950,
    "log_dirty": 298,
    "log_error": 1_950,
    "log_start": 971,
    "log_page": 8_731,
    "log_display": 13_581,
    "log_action": 8_732,
    "traffic_unique_visitor": 2_640,
    "traffic_user_jump": 2_982,
}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_known_counts(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() == COUNTS[name]
