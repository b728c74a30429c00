import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.functions.patterns import PatternError
from logspark.functions.render import KB_HEADER, kb_entry
from logspark.model import KB_HISTORY, STATE
from logspark.operators import cursor, history
from logspark.operators import state as S

NOW = datetime(2025, 6, 1, 12)
LOGS = "container_id string, name string, segment long, seq long, ts_raw string, ts timestamp_ntz"


def state(spark, *rows):
    return spark.createDataFrame([(c, n, t, "") for c, n, t in rows], STATE)


def logs(spark, *rows):
    """(container, seq, time): the timestamp text follows from the time."""
    return spark.createDataFrame(
        [(c, c, 0, s, t if isinstance(t, str) else t.isoformat() + "Z",
          None if isinstance(t, str) else t) for c, s, t in rows], LOGS)


def ids(df):
    return sorted(r[0] for r in df.select("container_id").collect())


# ---- reading since the cursor ---------------------------------------------------------------

def ago(**kw):
    return NOW - timedelta(**kw)


def test_start_times(spark):
    st = state(spark, ("known", "known", ago(hours=5)), ("new", "other", ago(days=9)))
    rows = logs(spark, ("known", 0, ago(hours=6)), ("known", 1, ago(hours=5)), ("known", 2, ago(hours=4)),
                ("first", 0, ago(minutes=61)), ("first", 1, ago(minutes=60)), ("first", 2, NOW))
    got = {(r.container_id, r.seq) for r in cursor.new_lines(rows, st, NOW).collect()}
    assert got == {("known", 1), ("known", 2), ("first", 1), ("first", 2)}
    strict = {(r.container_id, r.seq) for r in cursor.new_lines(rows, st, NOW, strict=True).collect()}
    assert strict == {("known", 2), ("first", 2)}
    back = cursor.new_lines(rows, st, NOW, timedelta(hours=10))
    assert back.count() == 6
    until = cursor.new_lines(rows, st, NOW, until=ago(hours=4))
    assert {(r.container_id, r.seq) for r in until.collect()} == {("known", 1), ("known", 2)}


def test_untimed_rows(spark):
    """A row without a time goes where the row before it goes, over the borders of segments too."""
    rows = logs(spark, ("a", 0, ago(days=3)), ("a", 1, "old"), ("a", 2, ago(minutes=9)), ("a", 3, "in"),
                ("a", 4, "new"), ("b", 0, "first"))
    known = state(spark, ("a", "a", ago(minutes=30)))
    for span in (1, 2, 100):
        cut = rows.withColumn("segment", F.expr(f"seq div {span}"))
        got = cursor.new_lines(cut, known, NOW)
        assert sorted((r.container_id, r.seq) for r in got.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 0)]
        back = cursor.new_lines(cut, known, NOW, timedelta(minutes=10))
        assert sorted((r.container_id, r.seq) for r in back.collect()) == [("a", 2), ("a", 3), ("a", 4)]
    everything = cursor.new_lines(rows, state(spark, ("a", "a", datetime(1, 1, 1))), NOW)
    assert everything.filter("container_id = 'a'").count() == 5


def test_empty_and_reset_state(spark):
    rows = logs(spark, ("a", 0, ago(days=300)), ("a", 1, NOW))
    assert cursor.new_lines(rows, state(spark), NOW).count() == 1
    zero = state(spark, ("a", "a", datetime(1, 1, 1)))
    assert cursor.new_lines(rows, zero, NOW).count() == 2


def test_floor_reaches_the_scan(spark, tmp_path):
    logs(spark, *[("a", i, ago(days=i)) for i in range(100)]).write.parquet(str(tmp_path / "l"))
    df = cursor.new_lines(spark.read.parquet(str(tmp_path / "l")),
                          state(spark, ("a", "a", ago(days=3))), NOW)
    assert df.count() == 4
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(ts),GreaterThanOrEqual(ts,ScalarSubquery" in plan


# ---- moving the cursor ----------------------------------------------------------------------

def times(df):
    return {r.container_id: r.last_scan for r in df.collect()}


def test_last_row_wins_over_later_time(spark):
    assert times(cursor.last_times(logs(spark, ("a", 0, NOW), ("a", 1, ago(days=1))))) == {"a": ago(days=1)}


def test_last_row_without_or_with_bad_time(spark):
    rows = logs(spark, ("none", 0, NOW), ("none", 1, ""), ("bad", 0, NOW), ("bad", 1, "Plain"))
    assert times(cursor.last_times(rows)) == {"none": datetime(1, 1, 1)}
    assert times(cursor.last_times(rows, empty_resets=False)) == {}


def test_upsert(spark):
    st = state(spark, ("a", "old", ago(days=2)), ("idle", "idle", ago(days=9)))
    rows = logs(spark, ("a", 0, NOW), ("b", 0, NOW), ("bad", 0, "Plain"))
    moved = cursor.last_times(rows)
    assert times(cursor.advance(st, moved)) == {"a": NOW, "idle": ago(days=9), "b": NOW}
    failed = spark.createDataFrame([("a", "a")], "container_id string, name string")
    assert times(cursor.advance(st, moved, failed)) == {"a": ago(days=2), "idle": ago(days=9), "b": NOW}


# ---- state views ----------------------------------------------------------------------------

@pytest.mark.parametrize("pattern,left", [
    ("^ingest", ["0f01", "77aa"]), ("^77", ["0f01", "9c20"]), ("zebra", ["0f01", "77aa", "9c20"]),
    ("", None), ("[a-z]", []), ("Ingest", ["0f01", "77aa", "9c20"]), (r"ingest\.eu", ["0f01", "77aa", "9c20"]),
    ("(?i)MAIL|^0", ["9c20"]),
])
def test_reset(spark, pattern, left):
    st = state(spark, ("0f01", "queue", NOW), ("77aa", "mailer", NOW), ("9c20", "ingest-eu", NOW))
    if left is None:
        with pytest.raises(ValueError):
            S.reset_matching(st, pattern)
        return
    assert ids(S.reset_matching(st, pattern)) == left
    assert S.row_count(S.matching(st, pattern)).first()[0] == 3 - len(left)


def test_reset_errors_and_others(spark):
    st = state(spark, ("a", "web", NOW))
    with pytest.raises(ValueError):
        S.reset_matching(st, "")
    with pytest.raises(PatternError):
        S.reset_matching(st, "[invalid")
    assert S.reset_all(st).count() == 0
    assert ids(S.remove(st, "a")) == [] and ids(S.remove(st, "b")) == ["a"]


def test_listing(spark):
    st = spark.createDataFrame([("0123456789abcdef", "w", NOW, "c"), ("z", "x", datetime(1, 1, 1), ""),
                                ("y", "x", None, None)], STATE)
    got = sorted(tuple(r) for r in S.listing(st).collect())
    assert got == [("0123456789ab", "w", "2025-06-01 12:00:00", "c"), ("y", "x", "Never", "-"),
                   ("z", "x", "Never", "-")]


# ---- history --------------------------------------------------------------------------------

def entry(name, ts, text="t"):
    return (name, "raw", ts, "🟢 Healthy", text)


@pytest.mark.parametrize("days", [1, 30, 365])
def test_retention(spark, days):
    """An entry is kept to the very second its age reaches the limit; one without a time always."""
    rng = random.Random(days)
    ages = [timedelta(seconds=rng.randrange(days * 2 * 86_400)) for _ in range(40)]
    ages += [timedelta(days=days), timedelta(days=days, seconds=1)]
    rows = [entry("a", NOW - age, str(i)) for i, age in enumerate(ages)] + [entry("a", None, "untimed")]
    kept = history.prune(spark.createDataFrame(rows, KB_HISTORY), NOW, days)
    assert {r.analysis for r in kept.collect()} == {"untimed"} | {
        str(i) for i, age in enumerate(ages) if age <= timedelta(days=days)}
    for bad in (0, 366):
        with pytest.raises(ValueError):
            history.prune(kept, NOW, bad)


def test_append_prunes_scanned_services_only(spark):
    old = spark.createDataFrame([entry("a", ago(days=40)), entry("idle", ago(days=40))], KB_HISTORY)
    results = spark.createDataFrame([("a", "an error"), ("b", "fine")], "name string, analysis string")
    got = sorted((r.name, r.status, r.scan_ts) for r in history.append(old, results, NOW, 30).collect())
    assert got == [("a", "🔴 Issues Detected", NOW), ("b", "🟢 Healthy", NOW),
                   ("idle", "🟢 Healthy", ago(days=40))]


def test_markdown(spark):
    body = ("\n### Scan: 2025-05-30T10:00:00Z\n**Status:** 🟡 Warnings\n\nfirst\nline\n\n---\n"
            "   \n---\n\n### Scan: not a time\n**Status:** 🟢 Healthy\n\nsecond\n\n---\n")
    files = spark.createDataFrame([("a", "# KB\n\n## Service History\n" + body), ("b", body)],
                                  "name string, content string")
    got = [tuple(r) for r in history.parse_markdown(files).orderBy("entry_no").collect()]
    assert got == [("a", 0, "2025-05-30T10:00:00Z", datetime(2025, 5, 30, 10), "🟡 Warnings", "first\nline"),
                   ("a", 2, "not a time", None, "🟢 Healthy", "second")]


def test_documents(spark):
    rows = spark.createDataFrame([entry("a/b", NOW, "late"), entry("a/b", ago(days=1), "early"),
                                  entry("a/b", None, "untimed"), entry("c", NOW, "x")], KB_HISTORY)
    got = {r.name: r for r in history.documents(rows).collect()}
    text = got["a/b"].content
    assert got["a/b"].storage_name == "a_b" and text.startswith(KB_HEADER % "a/b")
    assert text.index("untimed") < text.index("early") < text.index("late")
    back = history.parse_markdown(history.documents(rows).select("name", "content"))
    assert sorted(r.analysis for r in back.collect()) == ["early", "late", "untimed", "x"]


def test_trend(spark):
    def rows(name, *issues):
        return [(name, "raw", ago(days=d), "🔴 Issues Detected" if bad else "🟢 Healthy", "t") for d, bad in issues]
    table = (rows("worse", (1, True), (9, False)) + rows("better", (1, False), (8, True), (9, False))
             + rows("same", (1, True), (2, False), (8, True), (9, False)) + rows("new", (1, True))
             + rows("quiet", (9, True)) + [entry("worse", None)])
    got = history.trend(spark.createDataFrame(table, KB_HISTORY), NOW, timedelta(days=7))
    assert {r.name: r.trend for r in got.collect()} == {
        "worse": "worse", "better": "better", "same": "same", "new": "new", "quiet": "same"}


def test_markdown_round_trip(spark):
    rows = spark.createDataFrame([entry("a", NOW, "one"), entry("a", NOW, "two\n\nthree")], KB_HISTORY)
    text = rows.withColumn("scan_ts_raw", F.lit("2025-06-01T12:00:00Z")).agg(F.concat(
        F.lit(KB_HEADER % "a"), F.array_join(F.collect_list(kb_entry("scan_ts_raw", "status", "analysis")), ""))
        .alias("content")).withColumn("name", F.lit("a"))
    got = {(r.scan_ts, r.status, r.analysis) for r in history.parse_markdown(text).collect()}
    assert got == {(NOW, "🟢 Healthy", "one"), (NOW, "🟢 Healthy", "two\n\nthree")}
