"""Stores whose tables change together, keyed tables of deltas, history by day, zone maps."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.functions.classify import SERVICE_LABELS
from logspark.functions.tokens import byte_tokens
from logspark.model import KB_HISTORY, LOGS, RESPONSES, SOURCE, STATE
from logspark.operators import cursor, history
from logspark.plans import scan
from logspark.sources import store as S
from logspark.sources import zones as Z
from logspark.sources.store import Store, read_keyed, rewrite_parts, upsert_keyed

NOW = datetime(2025, 6, 10, 12)


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(snapshot, spark, name="t", *parts):
    return sorted(r.v for r in snapshot.read(spark, name, table(spark).schema, *parts).collect())


def put(store, spark, tag, **tables):
    change = store.begin(spark, tag)
    for name, rows in tables.items():
        change.replace(name, table(spark, *rows))
    change.commit()


def test_a_commit_shows_all_tables_together(spark, store):
    assert store.snapshot(spark).number == -1 and values(store.snapshot(spark), spark) == []
    put(store, spark, "one", t=[1, 2], u=[3])
    change = store.begin(spark, "two")
    change.replace("t", table(spark, 5))
    change.replace("u", table(spark, 6))
    before = store.snapshot(spark)
    assert (values(before, spark), values(before, spark, "u")) == ([1, 2], [3])
    change.commit()
    after = store.snapshot(spark)
    assert (values(after, spark), values(after, spark, "u")) == ([5], [6])
    assert values(before, spark) == [1, 2]  # an older snapshot stays readable
    assert store.vacuum(spark) == 2 and values(store.snapshot(spark), spark) == [5]


def test_the_same_tag_replaces_what_it_wrote(spark, store):
    put(store, spark, "one", t=[1])
    put(store, spark, "two", t=[2])
    put(store, spark, "two", t=[3])
    assert values(store.snapshot(spark), spark) == [3] and store.snapshot(spark).number == 1
    assert values(store.snapshot(spark, redo="two"), spark) == [1]
    put(store, spark, "three", t=[4])
    put(store, spark, "two", t=[9])  # others are built on it
    assert values(store.snapshot(spark), spark) == [4]


def test_many_commits_are_read_from_a_checkpoint(spark, store, monkeypatch):
    monkeypatch.setattr(S, "CHECKPOINT", 3)
    for i in range(8):
        change = store.begin(spark, f"s{i}")
        change.add("t", table(spark, i), part=str(i % 2))
        if i == 5:
            change.drop(*change.current("t", "0")[:2])
        change.commit()
    assert values(store.snapshot(spark), spark) == [1, 3, 4, 5, 6, 7]
    assert values(store.snapshot(spark), spark, "t", "0") == [4, 6]
    assert store.snapshot(spark).parts("t") == ["0", "1"]


class Stopped(Exception):
    pass


def responses(requests):
    content = F.struct(F.lit(0).alias("index"), F.struct(
        F.lit("assistant").alias("role"), F.lit("**Summary**: fine").alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"))
    return requests.select(
        "request_id", F.array(content).alias("choices"),
        F.lit(None).cast(RESPONSES["usage"].dataType).alias("usage"),
        F.lit(None).cast(RESPONSES["error"].dataType).alias("error"))


def test_a_scan_that_stops_anywhere_leaves_the_old_one(spark, logs_of, store, monkeypatch):
    """Stopped between any two writes, readers see all of the scan before; run again, all of this one."""
    def logs(hour):
        return logs_of([("web", 0, "t", "stdout", f"at {hour}"), ("db", 0, "t", "stdout", "x")]).withColumn(
            "ts", F.lit(NOW.replace(hour=hour, minute=30).isoformat(sep=" ")).cast("timestamp_ntz"))

    def view():
        now = store.snapshot(spark)
        state = read_keyed(now, spark, "state", SOURCE, STATE)
        return (sorted(str(r.last_scan) for r in state.collect()),
                sorted(r.scan_ts_raw for r in history.read_by_day(now, spark).collect()),
                sorted(e.part for e in now.entries if e.table in ("reports", "interactions")))

    def run(hour):
        options = scan.ScanOptions(now=NOW.replace(hour=hour + 1), scan_id=f"scan-{hour}",
                                   counter=byte_tokens(1.0))
        state = read_keyed(store.snapshot(spark, redo=options.scan_id), spark, "state", SOURCE, STATE)
        prepared = scan.prepare(logs(hour), state, options)
        requests, replies = scan.reduce_all(prepared, responses, options)
        scan.finish_together(prepared, requests, replies, options, store)

    run(9)
    old = view()
    assert len(old[0]) == 2 and len(old[2]) == 2
    writes, add, commit = [], S.Transaction.add, S.Transaction._write

    def stopping(call):
        def step(*args, **more):
            writes.append(1)
            if len(writes) > stop:
                raise Stopped
            return call(*args, **more)
        return step

    stop = 100
    monkeypatch.setattr(S.Transaction, "add", stopping(add))
    monkeypatch.setattr(S.Transaction, "_write", stopping(commit))
    for stop in range(6):
        writes.clear()
        with pytest.raises(Stopped):
            run(10)
        assert view() == old
    stop = 100
    writes.clear()
    run(10)
    new = view()
    assert len(writes) >= 6 and new != old
    assert len(new[0]) == 2 and len(new[1]) == 4 and len(new[2]) == 4
    run(10)  # finished again: the same
    assert view() == new


def state_rows(spark, *rows):
    return spark.createDataFrame([(c, c, t, "") for c, t in rows], STATE)


def test_keyed_table(spark, store):
    change = store.begin(spark, "one")
    upsert_keyed(change, "state", SOURCE, STATE, state_rows(spark, *((f"c{i}", NOW) for i in range(20))))
    change.commit()
    later = NOW + timedelta(hours=1)
    change = store.begin(spark, "two")
    upsert_keyed(change, "state", SOURCE, STATE, state_rows(spark, ("c1", later), ("new", later)),
                 removed=state_rows(spark, ("c2", None), ("c1", None), ("none", None)))
    change.commit()
    got = {r[SOURCE]: r.last_scan for r in read_keyed(
        store.snapshot(spark), spark, "state", SOURCE, STATE).collect()}
    assert got == {**{f"c{i}": NOW for i in range(20) if i != 2}, "c1": later, "new": later}


def test_deltas_cost_what_moved(spark, store):
    """Many scans that move few of many cursors: few rows are written, few deltas stay."""
    rng = random.Random(2)
    expected = {f"c{i}": NOW for i in range(1000)}
    written, moved = 0, 0
    for step in range(24):
        rows = expected if step == 0 else {f"c{rng.randrange(1000)}": NOW + timedelta(step) for _ in range(4)}
        gone = [] if step == 0 else [f"c{rng.randrange(1000)}"]
        change = store.begin(spark, f"s{step}")
        n = upsert_keyed(change, "state", SOURCE, STATE, state_rows(spark, *rows.items()),
                         state_rows(spark, *((c, None) for c in gone)) if gone else None)
        change.commit()
        if step:
            written, moved = written + n, moved + len(rows) + len(gone)
        expected = {c: t for c, t in expected.items() if c not in gone} | dict(rows)
    got = {r[SOURCE]: r.last_scan for r in read_keyed(
        store.snapshot(spark), spark, "state", SOURCE, STATE).collect()}
    assert got == expected
    assert written <= 6 * moved < 1000 and len(store.snapshot(spark).of("state")) <= 8


def entries_of(spark, *rows):
    return spark.createDataFrame(
        [(n, "" if t is None else t.isoformat() + "Z", t, s, "a") for n, t, s in rows], KB_HISTORY)


def analyses(spark, *names):
    return spark.createDataFrame([(n, "all fine") for n in names], "name string, analysis string")


def test_history_rewrites_days_that_run_out(spark, store):
    days = [NOW - timedelta(days=d) for d in range(12)]
    old = entries_of(spark, *((n, t, SERVICE_LABELS[2]) for n in ("web", "db") for t in days),
                     ("web", None, SERVICE_LABELS[0]))
    change = store.begin(spark, "import")
    history.import_by_day(change, old)
    change.commit()
    before = {e.folder for e in store.snapshot(spark).entries}
    change = store.begin(spark, "scan")
    gone = history.append_by_day(change, analyses(spark, "web"), NOW, 7)
    change.commit()
    now = store.snapshot(spark)
    assert gone == [(NOW - timedelta(days=d)).date().isoformat() for d in (11, 10, 9, 8)]
    assert len(before - {e.folder for e in now.entries}) == 4  # all others are as they were
    expected = history.append(old, analyses(spark, "web"), NOW, 7)
    assert sorted(map(repr, history.read_by_day(now, spark).collect())) == sorted(map(repr, expected.collect()))
    since = history.read_by_day(now, spark, since=NOW - timedelta(days=2))
    assert since.filter("scan_ts IS NULL").count() == 1 and since.count() == 8
    change = store.begin(spark, "scan 2")
    gone = history.append_by_day(change, analyses(spark, "db"), NOW, 7)
    change.commit()
    assert len(gone) == 4 and store.snapshot(spark).parts("history")[0] == "2025-06-03"


def test_parts_that_lose_nothing_stay(spark, store):
    put(store, spark, "one", t=[1, 2])
    change = store.begin(spark, "two")
    assert rewrite_parts(change, "t", table(spark).schema, ["", "x"], lambda df: df) == []
    assert rewrite_parts(change, "t", table(spark).schema, [""], lambda df: df.filter("v > 5")) == [""]
    change.commit()
    assert store.snapshot(spark).entries == ()


def test_intervals(spark):
    bad, warn, good = SERVICE_LABELS
    at = [NOW - timedelta(hours=h) for h in (9, 7, 5, 5, 3, 1)]
    rows = [("web", at[0], good), ("web", at[1], good), ("web", at[2], warn), ("web", at[3], bad),
            ("web", at[4], bad), ("web", at[5], good), ("web", None, bad), ("web", NOW + timedelta(1), bad),
            ("web", NOW - timedelta(40), bad), ("db", at[1], warn)]
    got = sorted(map(tuple, history.intervals(entries_of(spark, *rows), NOW, 30).collect()), key=repr)
    assert got == sorted([
        ("web", good, None, at[0], at[2], 2, 4 * 3600), ("web", bad, good, at[2], at[5], 3, 4 * 3600),
        ("web", good, bad, at[5], None, 1, 3600), ("db", warn, None, at[1], None, 1, 7 * 3600)], key=repr)


@pytest.fixture
def files(spark, tmp_path):
    """Ten files of an hour each with two containers, the last hours of ``old`` missing."""
    path = str(tmp_path / "logs")
    for hour in range(10):
        t = NOW - timedelta(hours=10 - hour)
        rows = [("new", "new", 0, hour, "", t, "stdout", f"n{hour}")]
        if hour < 4:
            rows.append(("old", "old", 0, hour, "", t, "stdout", f"o{hour}"))
        if hour == 7:
            rows.append(("mixed", "mixed", 0, hour, "", t, "stdout", "timed"))
        if hour == 8:
            rows.append(("mixed", "mixed", 0, hour, "", None, "stdout", "untimed"))
        spark.createDataFrame(rows, LOGS).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("cursors,opened", [
    ((("new", 2.5), ("old", 6.5), ("mixed", 1.5)), None),
    ((("new", 2.5), ("old", 5.5)), None), ((), None)])
def test_old_files_are_not_opened(spark, files, cursors, opened):
    state = state_rows(spark, *((c, NOW - timedelta(hours=h)) for c, h in cursors))
    every = spark.read.parquet(files)
    known = Z.zones(every)
    logs, own = Z.read_needed(spark, files, known, state, NOW, cursor.FIRST_SCAN)
    expected = cursor.new_lines(every, state, NOW).collect()
    assert sorted(map(repr, cursor.new_lines(logs, state, NOW).collect())) == sorted(map(repr, expected))
    assert own.count() == 0 and len(logs.inputFiles()) < len(every.inputFiles())


def test_new_files_get_zones(spark, files):
    """Without a zone map all files are new; with that of the scan before, those that came since."""
    state = state_rows(spark, ("new", NOW - timedelta(hours=2.5)), ("old", NOW), ("mixed", NOW))
    none = spark.createDataFrame([], Z.ZONES)
    first, own = Z.read_needed(spark, files, none, state, NOW, cursor.FIRST_SCAN)
    assert own.select("file").distinct().count() == 10 and len(first.inputFiles()) < 10
    spark.createDataFrame([("new", "new", 0, 99, "", NOW, "stdout", "later")], LOGS).coalesce(1).write.mode(
        "append").parquet(files)
    second, more = Z.read_needed(spark, files, own, state, NOW, cursor.FIRST_SCAN)
    assert more.select("file").distinct().count() == 1
    assert second.filter("message = 'later'").count() == 1
