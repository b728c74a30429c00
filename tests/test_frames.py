"""Log frames as a data source: reading, pushed start times, streams of files, writing."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual

from logspark.functions import parse as P
from logspark.operators import cursor
from logspark.sources import frames

NOON = datetime(2024, 5, 1, 12)


def frame(sid, text):
    payload = text if isinstance(text, bytes) else text.encode()
    return struct.pack(">B3xI", sid, len(payload)) + payload


def put(folder, name, *parts):
    (folder / name).write_bytes(b"".join(parts))


def rows(df):
    return [tuple(r) for r in df.orderBy("segment", "seq").select(
        "container_id", "ts_raw", "ts", "stream_decoded", "message").collect()]


def test_frames_become_rows(spark, tmp_path):
    put(tmp_path, "web", frame(1, "2024-05-01T12:00:00Z one\n"), frame(2, "trace\r\n\n"),
        frame(0, "2024-05-01T14:00:00,5+02:00 é\nnext"), frame(1, ""))
    put(tmp_path, ".web-unfinished", frame(1, "x"))
    assert rows(frames.read_frames(spark, str(tmp_path))) == [
        ("web", "2024-05-01T12:00:00Z", NOON, "stdout", "one"),
        ("web", "", None, "stderr", "trace"), ("web", "", None, "stderr", ""),
        ("web", "2024-05-01T14:00:00,5+02:00", datetime(2024, 5, 1, 12, 0, 0, 500000), None, "é"),
        ("web", "", None, None, "next"), ("web", "", None, "stdout", "")]


def test_a_cut_off_file_gives_what_there_is(spark, tmp_path):
    put(tmp_path, "a", frame(1, "whole\n"), frame(1, "cut-off-here")[:-5])
    put(tmp_path, "b", frame(1, "whole\n"), b"\x01\0\0")
    put(tmp_path, "c")
    assert [r[4] for r in rows(frames.read_frames(spark, str(tmp_path)))] == ["whole", "cut-off", "whole"]


def test_no_frames(spark, tmp_path):
    assert rows(frames.read_frames(spark, str(tmp_path / "missing"))) == []


@pytest.mark.parametrize("header", [b"\x03\0\0\0\0\0\0\1x", b"\x01\0\1\0\0\0\0\1x"])
def test_text_that_is_no_frame_is_refused(spark, tmp_path, header):
    put(tmp_path, "a", frame(1, "fine\n"), header)
    with pytest.raises(Exception, match="no frame header"):
        frames.read_frames(spark, str(tmp_path)).collect()


def test_times_are_those_of_the_column_function(eval_expr):
    lines = [t + " x" for t in (
        "2024-05-01T12:00:00Z", "2024-05-01T12:00:00.1234567Z", "2024-05-01T12:00:00,25-05:30",
        "2024-05-01T24:00:00Z", "2024-02-30T00:00:00Z", "2024-05-01T12:00:60Z", "0001-01-01T00:00:00Z",
        "2024-05-01T12:00:00+29:00", "2024-05-01T12:00:00+02:60", "2024-05-01T12:00:00", "2024-05-01",
        "2024-05-01T12:00:00.Z", "", "٢٠٢٤-05-01T12:00:00Z", "2024-05-01T12:00:00z")]
    lines += ["2024-05-01T12:00:00Z", "2024-05-01T12:00:00Z\n x", " 2024-05-01T12:00:00Z"]
    assert [frames.line_time(v) for v in lines] == eval_expr(
        lambda c: P.rfc3339(P.line_timestamp(F.col(c))), lines)


def test_a_start_time_is_pushed_to_the_files(spark, tmp_path):
    put(tmp_path, "a", *(frame(1, f"2024-05-01T{h:02d}:00:00Z h{h}\n") for h in range(24)),
        frame(1, "no time\n"))
    read = frames.read_frames(spark, str(tmp_path)).filter(F.col("ts") >= F.lit(NOON))
    assert [r[4] for r in rows(read)] == [f"h{h}" for h in range(12, 24)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan logspark-frames" in plan and ">=" not in plan
    after = frames.read_frames(spark, str(tmp_path)).filter(F.col("ts") > F.lit(NOON))
    assert len(rows(after)) == 11


def test_which_filters_are_taken():
    reader = frames.FrameReader("/none")
    at_least, later = GreaterThanOrEqual(("ts",), NOON), GreaterThan(("ts",), datetime(2024, 5, 2))
    other = [EqualTo(("value",), "x"), GreaterThanOrEqual(("_no",), 3)]
    assert list(reader.pushFilters([at_least, later, *other])) == [later, *other]
    assert reader.since == datetime(2024, 5, 2)


@pytest.mark.parametrize("lines,size", [(1, 1 << 20), (3, 1 << 20), (1 << 13, 1)])
def test_batches_are_bounded(tmp_path, monkeypatch, lines, size):
    monkeypatch.setattr(frames, "BATCH_LINES", lines)
    monkeypatch.setattr(frames, "BATCH_BYTES", size)
    put(tmp_path, "a", *(frame(1, f"line {i}\n") for i in range(7)))
    reader = frames.FrameReader(str(tmp_path))
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [v for b in batches for v in b.column("value").to_pylist()] == [f"line {i}" for i in range(7)]
    assert max(b.num_rows for b in batches) <= (1 if size == 1 else lines)


def test_segments_are_bounded(spark, tmp_path):
    put(tmp_path, "a", *(frame(1, f"line {i}\n") for i in range(7)))
    frames.register(spark)
    lines = frames.place_frames(spark.read.format(frames.NAME).load(str(tmp_path)), span=3)
    assert [r["count"] for r in lines.groupBy("segment").count().orderBy("segment").collect()] == [3, 3, 1]


def test_written_files_are_read_back(spark, tmp_path):
    values = [("x/1", i, ("stdout", "stderr", None)[i % 3], f"é {i}") for i in range(10)]
    values += [("y/1", 0, "stdout", None), ("y/1", 1, "other", "two")]
    df = spark.createDataFrame(values, "file string, seq int, stream string, value string")
    placed = df.repartition("file").sortWithinPartitions("file", "seq")
    for _ in range(2):  # a task that runs again replaces its files
        frames.write_frames(placed, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["1", "1"]
    read = frames.read_frames(spark, f"file:{tmp_path}/out",
                              F.regexp_extract("_path", "([^/]+)/[^/]+$", 1))
    assert [(r[0], r[3], r[4]) for r in rows(read)] == (
        [("x", s, v.partition(" ")[2]) for _, _, s, v in values[:10]]
        + [("y", "stdout", ""), ("y", None, "two")])


def test_files_that_arrive_are_streamed_once(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()

    def step():
        query = (frames.stream_frames(spark, str(logs)).writeStream.format("parquet")
                 .option("checkpointLocation", str(tmp_path / "checkpoint"))
                 .trigger(availableNow=True).start(out))
        query.awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(out).collect())

    put(logs, "001", frame(1, "a\n"), frame(2, "b\n"))
    assert step() == ["a", "b"]
    put(logs, "002", frame(1, "c\n"))
    assert step() == ["a", "b", "c"]
    assert step() == ["a", "b", "c"]


def test_frames_are_scanned_like_other_logs(spark, tmp_path):
    put(tmp_path, "web", *(frame(1, f"2024-05-01T{h:02d}:00:00Z h{h}\n") for h in range(24)))
    state = spark.createDataFrame(
        [("web", "web", datetime(2024, 5, 1, 20), "")],
        "container_id string, name string, last_scan timestamp_ntz, log_cursor string")
    new = cursor.new_lines(frames.read_frames(spark, str(tmp_path)), state, datetime(2024, 5, 2))
    assert {"h21", "h22", "h23"} <= {r["message"] for r in new.collect()}
    assert "h19" not in {r["message"] for r in new.collect()}
