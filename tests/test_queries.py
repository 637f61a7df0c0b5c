"""Every query with an oracle against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from jumpmark.plans import blocks, catalog, choices, oracles, payloads, reports, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(float(v), 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in r)) for r in rows)


ORACLES = oracles.ORACLE_SQL | choices.ORACLE_SQL | tables.ORACLE_SQL | payloads.ORACLE_SQL | reports.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got.select(*cols).collect()) == plain(want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.QUERIES)
