from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.functions.patterns import PatternError
from logspark.model import CONTAINERS, SOURCE, STATE
from logspark.operators import cursor, dedup
from logspark.session import materialize, shared_folder
from logspark.sources import logs as L
from logspark.sources import tables as T
from logspark.sources.containers import list_containers
from logspark.streaming.incremental import scan_stream

NOW = datetime(2025, 6, 1, 12)


# ---- containers -----------------------------------------------------------------------------

def test_containers(spark):
    df = spark.createDataFrame([("1", "/web-1", "running", "i", {}), ("2", "/web-2", "exited", "i", {}),
                                ("3", "//db", "running", "i", {}), ("4", "", "running", "i", {})], CONTAINERS)
    assert [r.name for r in list_containers(df).orderBy(SOURCE).collect()] == ["web-1", "/db", ""]
    assert list_containers(df, include_all=True).count() == 4
    assert [r.name for r in list_containers(df, "eb", True).orderBy(SOURCE).collect()] == ["web-1", "web-2"]
    assert list_containers(df, "^/db$").count() == 1
    with pytest.raises(PatternError):
        list_containers(df, "[bad")


# ---- log files ------------------------------------------------------------------------------

def test_log_files_over_many_splits(spark, tmp_path):
    """Lines keep their order when a file is read in many pieces by many tasks."""
    expected = {}
    for name, n in (("web", 4000), ("db", 3), ("empty", 0)):
        lines = [f"2025-06-01T10:00:00Z {'x' * (i % 50)}{i}" if i % 7 else "" for i in range(n)]
        (tmp_path / f"{name}.log").write_bytes("".join(x + "\n" for x in lines).encode())
        expected[name] = [x.split(" ", 1)[1] if x else "" for x in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = L.read_log_files(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        got = {}
        for r in df.orderBy(SOURCE, "segment", "seq").collect():
            got.setdefault(r.container_id, []).append(r.message)
        assert got == {k: v for k, v in expected.items() if v}
        assert df.select(SOURCE, "segment", "seq").distinct().count() == 4003
        stats = dedup.dedup_stats(dedup.collapse_repeats(df)).collect()
        assert {r.name: r.original_count for r in stats} == {"web": 4000, "db": 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_raw_lines(spark):
    raw = [b"\x02\0\0\0\0\0\0\x202025-06-01T10:00:00Z framed", b"NoSpace", b"", b"2025-06-01T10:00:00Z cr\r",
           b"Plain log"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "seq int, value binary")
    got = L.parse_lines(df.withColumn("value", F.col("value").cast("string"))).orderBy("seq").collect()
    at = datetime(2025, 6, 1, 10)
    assert [(r.ts_raw, r.ts, r.stream, r.stream_decoded, r.message) for r in got] == [
        ("2025-06-01T10:00:00Z", at, "stdout", "stderr", "framed"), ("", None, "stdout", None, "NoSpace"),
        ("", None, "stdout", None, ""), ("2025-06-01T10:00:00Z", at, "stdout", None, "cr"),
        ("Plain", None, "stdout", None, "log")]


def test_lines_of_texts(spark):
    df = spark.createDataFrame([("c", 5000, "x\ny"), ("c", 3, "a\n\nb")], "container_id string, id long, text string")
    got = L.split_lines(df, "text", "id").orderBy("segment", "seq").collect()
    assert [(r.segment, r.value) for r in got] == [(0, "a"), (0, ""), (0, "b"), (1, "x"), (1, "y")]


# ---- stored tables --------------------------------------------------------------------------

def test_state_json(spark, tmp_path):
    path = tmp_path / "state.json"
    assert T.read_state_json(spark, str(path)).count() == 0
    path.write_text("""{"version": "1", "last_updated": "2025-06-01T00:00:00Z", "containers": {
        "abc": {"name": "web", "last_scan": "2025-06-01T12:00:00.5+02:00"},
        "def": {"name": "db", "last_scan": "0001-01-01T00:00:00Z", "log_cursor": "c"}}}""")
    got = sorted(tuple(r) for r in T.read_state_json(spark, str(path)).collect())
    assert got == [("abc", "web", datetime(2025, 6, 1, 10, 0, 0, 500_000), ""),
                   ("def", "db", datetime(1, 1, 1), "c")]
    path.write_text("{broken")
    with pytest.raises(Exception):
        T.read_state_json(spark, str(path)).collect()


def test_state_json_round_trip(spark, tmp_path, monkeypatch):
    rows = [(f"c{i}", f"n/{i}", datetime(2025, 6, 1, 10, 0, i, 123_456), "x" * (i % 3)) for i in range(50)]
    state = spark.createDataFrame(rows, STATE)
    for limit in (1 << 16, 7):
        monkeypatch.setattr(T, "STATE_ROWS", limit)
        T.write_state_json(state, str(tmp_path / f"s{limit}"), NOW)
        assert sorted(map(tuple, T.read_state_json(spark, str(tmp_path / f"s{limit}")).collect())) == sorted(rows)


def test_versions(spark, tmp_path):
    table = T.VersionedTable(str(tmp_path / "t"), STATE)
    assert table.read(spark).count() == 0
    row = spark.createDataFrame([("a", "a", NOW, "")], STATE)
    assert table.write(row) == 0
    assert table.write(table.read(spark).unionByName(row), "s-0") == 1  # replaces the table it reads
    assert table.read(spark).count() == 2 and table.read(spark, redo="s-0").count() == 1
    (tmp_path / "t" / "v=2").mkdir()  # a write that did not finish
    assert table.read(spark).count() == 2
    assert table.write(row, "s-0") == 1  # the batch is done again
    assert table.read(spark).count() == 1
    assert table.write(row.limit(0)) == 2  # a reset in between
    assert table.write(row, "s-0") == 1 and table.read(spark).count() == 0
    for _ in range(5):
        table.write(row)
    assert table.versions(spark) == [5, 6, 7]


def test_texts_and_templates(spark, tmp_path):
    assert T.read_texts(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "my_app.md").write_text("Skip\nnoise\n")
    (tmp_path / "other.txt").write_text("no")
    assert [tuple(r) for r in T.read_texts(spark, str(tmp_path)).collect()] == [("my_app", "Skip\nnoise\n")]
    assert T.read_template(spark, str(tmp_path / "my_app.md"), "d") == "Skip\nnoise\n"
    assert T.read_template(spark, str(tmp_path / "none.md"), "d") == T.read_template(spark, None, "d") == "d"


def test_materialize(spark):
    df = spark.range(5).withColumn("t", F.lit(None).cast("timestamp_ntz"))
    out = materialize(df, "x")
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 5
    assert shared_folder(spark) in out.inputFiles()[0]


# ---- stream ---------------------------------------------------------------------------------

def lines(start, n, minute):
    return "".join(f"2025-06-01T11:{minute:02}:00Z m{i // 4}\n" for i in range(start, start + n))


def source(spark, folder):
    return L.scan_lines(spark.readStream, str(folder))


def test_stream_equals_batches(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    seen = []

    def handle(rows, batch_id):
        dedup.collapse_repeats(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        seen.append(batch_id)

    def run():
        scan_stream(source(spark, folder), str(tmp_path / "state"), str(tmp_path / "checkpoint"), handle,
                    lambda: NOW).awaitTermination()

    (folder / "web.log").write_text(lines(0, 10, 10))
    (folder / "old.log").write_text("2025-06-01T09:00:00Z before the first hour\n")
    run()
    state = {r.container_id: r.last_scan for r in T.VersionedTable(str(tmp_path / "state"), STATE).read(spark).collect()}
    assert state == {"web": datetime(2025, 6, 1, 11, 10)}
    first = spark.read.parquet(f"{out}/batch=0")
    batch = dedup.collapse_repeats(cursor.new_lines(L.read_log_files(spark, str(folder)),
                                                    spark.createDataFrame([], STATE), NOW))
    assert sorted(r.message for r in first.collect()) == sorted(r.message for r in batch.collect())
    assert sorted(r.message for r in first.collect()) == ["[REPEAT x4] m0", "[REPEAT x4] m1", "m2", "m2"]

    # the next scan: late rows behind the cursor are not read, runs do not reach into the last scan
    (folder / "sub-web.log").write_text("")
    (folder / "db.log").write_text(lines(8, 3, 30) + "untimed\n")
    run()
    assert seen == [0, 1]
    assert [r.message for r in spark.read.parquet(f"{out}/batch=1").orderBy("seq").collect()] == ["[REPEAT x3] m2", "untimed"]
    run()
    assert seen == [0, 1]  # nothing new, nothing done


def test_state_changes_between_batches(spark, tmp_path):
    """A reset between two batches holds, and a new checkpoint starts from the newest state."""
    folder = tmp_path / "in"
    folder.mkdir()
    table = T.VersionedTable(str(tmp_path / "state"), STATE)

    def run(checkpoint):
        scan_stream(source(spark, folder), table.path, str(tmp_path / checkpoint), lambda rows, _: rows.count(),
                    lambda: NOW).awaitTermination()

    def cursors():
        return {r.container_id: r.last_scan.minute for r in table.read(spark).collect()}

    (folder / "web.log").write_text(lines(0, 3, 10))
    run("one")
    assert cursors() == {"web": 10}
    table.write(table.read(spark).limit(0))
    (folder / "db.log").write_text(lines(0, 3, 20))
    run("one")
    assert cursors() == {"db": 20}
    (folder / "new.log").write_text(lines(0, 3, 30))
    run("two")  # reads all files again: what lies behind a cursor is not new
    assert cursors() == {"web": 10, "db": 20, "new": 30}


def test_long_files_make_bounded_segments(spark, tmp_path):
    import gzip

    (tmp_path / "web.log.gz").write_bytes(gzip.compress(lines(0, 1000, 10).encode()))
    df = L.place_lines(L.scan_lines(spark.read, str(tmp_path)), F.lit("web"), span=64)
    sizes = [r["count"] for r in df.groupBy("segment").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 64
    got = dedup.collapse_repeats(df).orderBy("segment", "seq").collect()
    assert [r.message for r in got] == [f"[REPEAT x4] m{i}" for i in range(250)]


def test_shuffle_size_follows_the_input():
    from logspark.session import settings_for

    assert settings_for(1 << 30)["spark.sql.shuffle.partitions"] == "200"
    assert settings_for(100 << 40)["spark.sql.shuffle.partitions"] == str(100 * 2048)
