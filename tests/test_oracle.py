"""Every registered query of the library against its SQL in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from landheat.plans import file_queries, queries  # noqa: F401  file_queries registers its own
from tests.conftest import SF

TABLES = [n.removesuffix(".parquet") for n in sorted(os.listdir(SF))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    return str(v)


def lines(columns, rows):
    return sorted("|".join(plain(v) for _, v in sorted(zip(columns, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert lines(df.columns, df.collect()) == lines(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"train_and_evaluate"}))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
