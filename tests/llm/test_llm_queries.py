"""Registered queries of the subpackage: names, result columns and oracles."""
import os

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF001
from lexiframe.llm.queries import ORACLE_SQL, QUERIES
from tools.check_oracle import TABLES, digest, type_diffs

COLUMNS = {
    "op1_top_k": ["query_id", "rank", "vec_id", "score"],
    "op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_html_text": ["page_id", "url", "text", "n_chars"],
    "op4_near_duplicates": ["doc_id", "class_id"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_token_counts": ["doc_id", "n_tokens"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
    "op11_suffix_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}

OWN_ROWS = {  # queries with other than one row a document or page
    "op13_whitening": lambda spark: 16 * spark.read.parquet(f"{SF001}/embeddings.parquet").count(),
}


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(se.queries()) and set(ORACLE_SQL) <= set(se.oracle_sql())


@pytest.mark.parametrize("key", sorted(set(COLUMNS) - set(ORACLE_SQL)))
def test_whole_table(spark, key):
    df = QUERIES[key](spark, SF001)
    assert df.columns[:len(COLUMNS[key])] == COLUMNS[key]
    if key not in OWN_ROWS:
        table = "pages" if key.startswith("op3_") else "documents"
        assert df.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()
    else:
        assert df.count() == OWN_ROWS[key](spark)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    df = QUERIES[key](spark, SF001)
    rel = con.sql(ORACLE_SQL[key])
    assert df.columns == COLUMNS[key]
    assert not type_diffs(dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types))))
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]
