"""Every registered query of the engine against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from odlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df):
    df = df.convert_dtypes()[sorted(df.columns)].astype(str)
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_parity(spark, oracle, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    theirs = oracle.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
