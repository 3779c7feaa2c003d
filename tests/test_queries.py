"""Every query of the engine against its SQL: at the smallest scale, and those of few rows at the next one too.

The golden ones, on published or generated values alone, are checked here and are not registered.
"""

import math
import os

import duckdb
import pytest

from tierwright import queries as own
from tierwright import registry

SF, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = own.queries() | registry.GOLDEN
SQL = own.oracle_sql() | registry.GOLDEN_SQL
#: Those whose values hang on how many rows there are.
AT_BOTH = ("written_rates", "rate_reportable", "wilson_by_type", "windowed_rates", "folded_updates", "order_totals", "stale_months", "rules_accuracy", "source_frontier", "exact_frontier", "share_written", "typed_prices", "model_profile", "described_documents")


def views(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.fixture(scope="module")
def db():
    return {sf: views(sf) for sf in (SF, NEXT)}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("sf, name", [*((SF, n) for n in sorted(QUERIES)), *((NEXT, n) for n in AT_BOTH)])
def test_query_equals_sql(spark, db, sf, name):
    got = QUERIES[name](spark, sf)
    want = db[sf].sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(plain(r[i]) for i in place)) for r in want.fetchall())


def test_registered_queries_read_given_tables():
    """Each has SQL that names a table of the input."""
    tables = [n.split(".")[0] for n in os.listdir(SF)]
    for name, sql in own.oracle_sql().items():
        assert any(f" {t}" in sql.replace("\n", " ").replace("(", " ") for t in tables), name
    assert set(own.queries()) == set(own.oracle_sql()) and not set(own.queries()) & set(registry.GOLDEN)
