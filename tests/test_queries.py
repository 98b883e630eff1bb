"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            v = v.item() if hasattr(v, "item") else v
            row.append(None if v is None or (isinstance(v, float) and math.isnan(v)) else v)
        out.append(tuple(row))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(x, (int, float)) for x in g) else g == w


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(df.columns) > 0
    if "same" in df.columns:
        assert df.where("not same").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
