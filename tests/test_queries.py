"""Every registered query with SQL equals DuckDB on the smallest tables; the others give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from histospark.plans import catalog

#: Many rounds of small jobs; tests/test_operators.py and tests/test_network.py hold their results against brute force on small graphs.
SLOW = {"bridges", "terminal_mst", "spanning_tree", "chain_contraction", "prune_branches", "lobule_segmentation", "segments_to_mask"}
#: The smallest tables hold half a slide, in which these find nothing; tests/test_operators.py has cases with results.
MAY_BE_EMPTY = {"instances", "vessels"}


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, db, name):
    got = catalog.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    found = db.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_query_runs(spark, data, name):
    rows = catalog.QUERIES[name](spark, data).collect()
    assert rows or name in MAY_BE_EMPTY


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
