"""Every query with SQL against another engine, over the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from geoquill.plans import registry

DATA = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def plain(value):
    if value is None or value != value:
        return (0, "")
    if isinstance(value, (bool, int, float, decimal.Decimal)):
        return (1, round(float(value), 6))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return (2, str(value))
    return (2, str(value))


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, engine, name):
    got = registry.queries()[name](spark, str(DATA))
    want = engine.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_fitted_classifier_is_rated_on_held_out_slices(spark):
    got = registry.queries()["f05_fit_patch_classifier"](spark, str(DATA)).collect()
    assert {r["split"] for r in got} == {"test", "eval"} and sum(r["country"] is None for r in got) == 2
    for split in ("test", "eval"):
        part = [r for r in got if r["split"] == split]
        whole = next(r for r in part if r["country"] is None)
        assert whole["n"] == sum(r["n"] for r in part if r["country"]) and 0 <= whole["accuracy"] <= 1 and whole["loss"] > 0
