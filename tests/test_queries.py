"""Every registered query with SQL against DuckDB on the same tables; the others for rows and a stable schema."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from materia import plans, registry

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    said = duck.sql(registry.ORACLES[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in said.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    first, again = registry.QUERIES[name](spark, sf_dir), registry.QUERIES[name](spark, sf_dir)
    rows = sorted(map(repr, first.collect()))
    assert first.columns == again.columns and rows == sorted(map(repr, again.collect()))
    assert rows or name == "x11_table_repair"  # few texts are so repetitive
