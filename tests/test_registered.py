"""Every registered query against its SQL counterpart, on the smallest tables."""

import decimal
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from newsloom.plans.registered import QUERIES
from newsloom.plans.registered_sql import ORACLE


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def shown(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.6f}"
    if isinstance(value, int):
        return f"{value}.000000"
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_only_text_operators_may_lack_sql():
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", name) for name in without)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cursor = oracle.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
