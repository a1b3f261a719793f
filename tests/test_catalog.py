"""Catalogue queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tierscope.plans import catalog, more_sql, oracle

SLOW = {"run_records", "ceiling_curve", "random_avg_ceiling_curve", "restoration_curve", "random_avg_curve", "normalized_curve", "crossing_bytes", "traversal_frequency", "masked_search_expanded", "masked_search_stats", "beam_sweep_broken_nav", "masked_search_full", "masked_search_bsp", "h1_ratio", "tier_contributions", "never_visited_fraction", "restore_policies"}
SQL = oracle.oracle_sql() | more_sql.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", [n for n in SQL if n not in SLOW])
def test_query_equals_sql(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_its_schema(spark):
    out = entry.entry(spark)
    assert out.dtypes == [("query_id", "bigint"), ("fraction", "double"), ("absence_ceiling", "double")]
    got = {(r[1], r[2]) for r in out.collect() if r[1] in (0.0, 1.0)}
    assert got == {(0.0, 0.0), (1.0, 1.0)}


def test_every_query_is_registered():
    assert set(SQL) <= set(catalog.queries()) <= set(entry.queries())
