"""Every registered query against its DuckDB SQL, at the smallest scale."""

import decimal

import duckdb
import pytest

from tallyglass.plans import catalog, image_queries, report_queries, source_queries, stats_queries, tabular_queries, text_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    answer = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in answer.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in answer.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in order) for r in got), key=str) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 1
