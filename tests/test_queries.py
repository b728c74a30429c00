"""Every registered query against its SQL twin, and some again over many small segments."""

import importlib
from pathlib import Path

import duckdb
import pytest

from logspark.operators import dedup
from logspark.plans import adapters as A
from logspark.plans import catalog as Q
from logspark.plans.oracle import ORACLE

TESTDATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TESTDATA).exists(), reason="no test tables")
entry = importlib.import_module("__spark_entry__")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in Path(TESTDATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def run(name):
        cursor = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        kinds = {c[0]: str(c[1]) for c in cursor.description}
        rows = [dict(zip(columns, r)) for r in cursor.fetchall()]
        return kinds, rows
    return run


def ordered(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(Q.QUERIES) == set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, TESTDATA)
    kinds, expected = sql(name)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    assert ordered([r.asDict() for r in df.collect()], sorted(kinds)) == ordered(expected, sorted(kinds))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


@pytest.mark.parametrize("name", ["q01_incremental_scan", "q05c_exclude_by_table", "q07_greedy_chunks",
                                  "q09d_results", "q18_obsolete"])
def test_query_without_broadcasts(spark, sql, name):
    """As at scale: every join is a shuffle join, and skewed sides are split."""
    before = {k: spark.conf.get(k, None) for k in SHUFFLED}
    for key, value in SHUFFLED.items():
        spark.conf.set(key, value)
    try:
        rows = [r.asDict() for r in entry.queries()[name](spark, TESTDATA).collect()]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    kinds, expected = sql(name)
    assert ordered(rows, sorted(kinds)) == ordered(expected, sorted(kinds))


@pytest.mark.parametrize("span", [1, 7, 64])
def test_dedup_over_small_segments(spark, sql, span):
    columns = ("container_id", "seq", "ts_raw", "message", "run_len")
    rows = dedup.collapse_repeats(A.event_logs(spark, TESTDATA, span)).collect()
    assert ordered([r.asDict() for r in rows], columns) == ordered(sql("q04_run_dedup")[1], columns)


@pytest.mark.parametrize("name,logs,filters,limit", [
    ("q07_greedy_chunks", lambda s: A.event_logs(s, TESTDATA, 32), A.EVENT_FILTERS, Q.EVENT_CHUNK),
    ("q07b_greedy_chunks_documents", lambda s: A.doc_logs(s, TESTDATA, 3), A.DOC_FILTERS, Q.DOC_CHUNK),
    ("q07c_greedy_chunks_conversations", lambda s: A.conversation_logs(s, TESTDATA, 2), {}, Q.DOC_CHUNK),
])
def test_chunks_over_small_segments(spark, sql, name, logs, filters, limit):
    rows = [r.asDict() for r in Q._chunked(logs(spark), filters, limit).collect()]
    columns = sorted(rows[0])
    assert ordered(rows, columns) == ordered(sql(name)[1], columns)


def same(spark, sql, name):
    kinds, expected = sql(name)
    rows = [r.asDict() for r in entry.queries()[name](spark, TESTDATA).collect()]
    assert ordered(rows, sorted(kinds)) == ordered(expected, sorted(kinds))


@pytest.mark.parametrize("name", ["q15_executive_request", "q24_alert"])
def test_one_executive_request_over_all(spark, sql, monkeypatch, name):
    """Also where the analyses are more than the context: before, they were packed into several."""
    monkeypatch.setattr(Q, "EXECUTIVE_CONTEXT", 5000)
    same(spark, sql, name)


def test_latest_per_name_of_large_keys(spark, tmp_path):
    """Event ids beyond a segment's span: before, the segment was not the one of the SQL."""
    duckdb.execute(f"""COPY (SELECT * REPLACE (event_id * 5000 AS event_id)
        FROM '{TESTDATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    expected = duckdb.execute(entry.oracle_sql()["q23_latest_per_name"].replace(
        "FROM events", f"FROM '{tmp_path}/events.parquet'"))
    columns = [c[0] for c in expected.description]
    got = entry.queries()["q23_latest_per_name"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_log_files_do_not_grow_with_containers(spark, sql):
    """Before, there was a folder and a file for each container."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(shared.glob("log-files-*"))
    same(spark, sql, "q03d_log_files")
    (new,) = set(shared.glob("log-files-*")) - known
    assert len(list(new.rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_collected_lines_tell_their_container(spark, tmp_path):
    from logspark.sources.logs import owned_line, owner_and_line, read_log_files

    lines = [("a", 0, "t x | y"), ("a b", 1, ""), ("a", 2, None), ("é", 3, "t é | "), ("a", 4, "t z")]
    df = spark.createDataFrame(lines, "owner string, seq int, line string").coalesce(1).orderBy("seq")
    df.select(owned_line("owner", "line").alias("value")).write.text(str(tmp_path / "logs"))
    read = read_log_files(spark, str(tmp_path / "logs"), *owner_and_line()).orderBy("segment", "seq")
    assert [(r.container_id, r.message) for r in read.collect()] == [
        ("a", "x | y"), ("a b", ""), ("a", ""), ("é", "é | "), ("a", "z")]


def test_a_batch_of_stream_runs_is_written_by_several_tasks(spark, tmp_path):
    """Before, each quarter of the events was written as one file by one task."""
    spark.read.parquet(f"{TESTDATA}/events.parquet").repartition(6).write.parquet(
        str(tmp_path / "t" / "events.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(shared.glob("stream-*"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = entry.queries()["q25c_stream_runs"](spark, str(tmp_path / "t")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    (new,) = set(shared.glob("stream-*")) - known
    assert len(list((new / "in").glob("part-*"))) > 4
    assert len(list((new / "checkpoint" / "commits").glob("[0-9]*"))) == 4
    expected = dedup.collapse_repeats(A.event_logs(spark, TESTDATA)).collect()
    columns = ("container_id", "seq", "ts_raw", "message", "run_len")
    assert ordered([r.asDict() for r in rows], columns) == ordered(
        [r.asDict() for r in expected], columns)
