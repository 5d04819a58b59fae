"""Every genomics query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lociform.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame, names):
    return sorted(tuple(map(plain, row)) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    a, b = rows(got, names), rows(want, names)
    for x, y in zip(a, b):
        assert all(p == q or abs(float(p) - float(q)) <= 2e-6 * max(1, abs(float(q))) for p, q in zip(x, y) if p != q), (x, y)


def test_every_fit_is_registered():
    assert len(catalog.FITS) == 6 and set(catalog.FITS) <= set(catalog.QUERIES) and not set(catalog.FITS) & set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.FITS))
def test_iterative_query(spark, name):
    got = catalog.FITS[name](spark, FOLDER).toPandas()
    if name.startswith("reml_") and name != "reml_effects":
        assert got["converged"].all() and (got["theta"] >= 0).all() and got["h2"].between(0, 1).all()
    if name == "sparse_reml":
        assert len(got) and (got["beta"] != 0).all()
    if name == "relax_groups":
        assert abs(got.groupby("variant_idx")["w"].sum() - 1).max() < 1e-9
