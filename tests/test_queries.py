"""Every registered query against its DuckDB oracle at sf0.01 (the driver's check:
row count, column names, order-insensitive value hash), plus the entry smoke."""
import os

import duckdb
import pytest

import __spark_entry__ as se
from lexiframe.plans import QUERIES
from tools.check_oracle import TABLES, digest, type_diffs

from conftest import SF001, SF01

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF01, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert df.columns == ["Sentiment", "n_rows", "n_nonempty", "n_tokens"]
    assert sum(r["n_rows"] for r in rows) == 87


def test_every_key_has_an_oracle_or_is_documented():
    no_sql = set(KEYS) - set(se.oracle_sql())
    assert not no_sql


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = se.queries()[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    sql = se.oracle_sql().get(key)
    if sql is None:
        assert rows and len(df.columns) > 0
        return
    rel = con.sql(sql)
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, orows)[0]
    assert type_diffs(dict(df.dtypes), dict(zip(rel.columns, [str(t) for t in rel.types]))) == []


@pytest.mark.parametrize("key", ["union_corpora", "split_valid_floor", "bucket_batches", "encode"])
def test_queries_run_at_smallest_scale(spark, key):
    assert se.queries()[key](spark, SF001).count() >= 0
