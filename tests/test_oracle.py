"""Every catalogue query with a SQL twin must give the same rows on the smallest test tables."""

from __future__ import annotations

import math
import os

import pytest

from tilewright.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _text(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0 if value else 0.0)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(catalogue.ORACLES[name])
    wanted = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(wanted)
    assert _rows(df.columns, df.collect()) == _rows(wanted, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_twin_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
