"""Registered queries: one for each operator, and those with SQL against DuckDB."""

import importlib
import re
from pathlib import Path

import duckdb
import pytest

from logspark.llm.oracle import ORACLE
from logspark.llm.queries import QUERIES

TESTDATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TESTDATA).exists(), reason="no test tables")
entry = importlib.import_module("__spark_entry__")


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in Path(TESTDATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in cursor.description)
    names = [c[0] for c in cursor.description]
    expected = [tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()]
    df = QUERIES[name](spark, TESTDATA)
    assert sorted(df.columns) == columns
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name,columns", [
    ("op1_quality_pu", "doc_id held_out score predicted"),
    ("op4_rp_forest", "vec_id n_links component_id kept"),
    ("op5_bpe_segment_tree", "doc_id n_tokens ids_sha256 decoded_sha256"),
    ("op9_run_index", "doc_id n_bytes n_removed n_spans kept_sha256"),
    ("op10_simple8b", "doc_id start n_tokens ids_crc32"),
    ("op12_feast_whitening", "vec_id component n deviation whitened explained identity_error"),
    ("op13_merkle_manifest", "doc_id leaf subroot root proof_sha256 folded_root verified")])
def test_columns(spark, name, columns):
    df = QUERIES[name](spark, TESTDATA)
    table = "embeddings" if columns.startswith("vec_id") else "documents"
    each = 4 if "component" in columns.split() else 1
    assert df.columns == columns.split()
    assert df.count() == each * spark.read.parquet(f"{TESTDATA}/{table}.parquet").count()
