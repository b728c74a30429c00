import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from logspark.operators import dedup
from logspark.streaming.runs import OPEN_RUNS
from logspark.operators.dedup import collapse_and_write, collapse_repeats, dedup_stats


def collapsed(rows, threshold=3):
    """One container at a time: what the operator should return."""
    out = []
    for owner, lines in groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        for message, run in groupby(lines, key=lambda r: r[4]):
            run = list(run)
            if len(run) >= threshold:
                first = run[0]
                out.append((owner, first[1], first[2], first[3],
                            f"[REPEAT x{len(run)}] {message}", len(run)))
            else:
                out += [(*r, 1) for r in run]
    return sorted(out)


def result(df):
    cols = ("container_id", "seq", "ts_raw", "stream", "message", "run_len")
    return sorted(tuple(r) for r in df.select(*cols).collect())


def lines(*messages, container="c"):
    return [(container, i, f"t{i}", "stderr" if i == 0 else "stdout", m)
            for i, m in enumerate(messages)]


@pytest.mark.parametrize("span", [1, 2, 1 << 20])
@pytest.mark.parametrize("lengths", [(), (1,), (2,), (3,), (9,), (4, 3), (1, 2, 3, 2, 1), (3, 1, 3), (2, 5, 2)])
def test_runs(logs_of, lengths, span):
    """Runs of given lengths, each of a message of its own; the last one is empty text."""
    names = [f"event {i}" for i in range(len(lengths) - 1)] + [""]
    messages = [name for name, n in zip(names, lengths) for _ in range(n)]
    expected = [line for name, n in zip(names, lengths)
                for line in ([f"[REPEAT x{n}] {name}"] if n >= 3 else [name] * n)]
    got = result(collapse_repeats(logs_of(lines(*messages), span)))
    assert [g[4] for g in got] == expected


def test_first_row_is_kept(logs_of):
    got = result(collapse_repeats(logs_of(lines(*["error"] * 5))))
    assert got == [("c", 0, "t0", "stderr", "[REPEAT x5] error", 5)]


def test_only_messages_are_compared(logs_of):
    rows = [("c", 0, "t0", "stdout", "m"), ("c", 1, "", "stderr", "m"), ("c", 2, "x", "s", "m")]
    assert [r[4] for r in result(collapse_repeats(logs_of(rows)))] == ["[REPEAT x3] m"]


def test_null_messages_are_equal(logs_of):
    rows = [("c", i, "", "stdout", None) for i in range(2)] + [("c", 2, "", "stdout", "x")]
    assert [r[4] for r in result(collapse_repeats(logs_of(rows)))] == [None, None, "x"]


@pytest.mark.parametrize("threshold", [2, 3, 5])
@pytest.mark.parametrize("span", [1, 3, 7, 50])
def test_segments_do_not_change_the_result(logs_of, span, threshold):
    rng = random.Random(span * 10 + threshold)
    rows = []
    for c in range(40):
        seq = 0
        for _ in range(rng.randint(1, 60)):
            message = rng.choice("ab" if c % 2 else "abc")
            for _ in range(rng.choice([1, 1, 2, 3, 9])):
                rows.append((f"c{c}", seq, f"t{seq}", "stdout", message))
                seq += rng.choice([1, 1, 1, 4])  # gaps in the numbering
    got = collapse_repeats(logs_of(rows, span), threshold)
    assert result(got) == collapsed(rows, threshold)
    assert got.agg(F.sum("run_len")).first()[0] == len(rows)


def test_one_container_with_all_rows(logs_of):
    rows = [("hot", i, "", "stdout", "x" if i < 9000 else str(i)) for i in range(10_000)]
    got = result(collapse_repeats(logs_of(rows, 256)))
    assert got[0][4:] == ("[REPEAT x9000] x", 9000) and len(got) == 1001


def test_stats(logs_of):
    stats = dedup_stats(collapse_repeats(logs_of(lines("a", "a", "a", "b", "b")))).first()
    assert (stats.original_count, stats.deduplicated_count, stats.saved_count,
            stats.deduplicated) == (5, 3, 2, True)
    assert not dedup_stats(collapse_repeats(logs_of(lines("a", "b")))).first().deduplicated


def test_input_is_shuffled_once(spark, logs_of):
    """All branches read one exchange of the rows; the others carry the ends of segments and blocks."""
    df = collapse_repeats(logs_of(lines(*"aabbbc" * 50), 8))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(container_id" in line
            and "segment" in line.split("),")[0] and "Reused" not in line]
    assert len(rows) == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("span", [1, 5, 1 << 20])
def test_written_form_is_the_same(logs_of, span):
    rng = random.Random(span)
    rows = [(f"c{i % 7}", i, "", "stdout", rng.choice("aab")) for i in range(600)]
    got = collapse_and_write(logs_of(rows, span), lambda df: df)
    assert result(got) == collapsed(rows)


@pytest.mark.parametrize("block", [2, 3, 1024])
@pytest.mark.parametrize("kind", ["a", "ab", "aab"])
def test_blocks_of_segments(logs_of, monkeypatch, block, kind):
    """Runs that go on over several blocks, also where a block is one run."""
    monkeypatch.setattr(dedup, "BLOCK_SEGMENTS", block)
    rng = random.Random(block)
    rows = [(f"c{i % 3}", i, "", "stdout", rng.choice(kind) if i % 90 > 40 else "a") for i in range(400)]
    assert result(collapse_repeats(logs_of(rows, 5))) == collapsed(rows)
    assert result(collapse_and_write(logs_of(rows, 5), lambda df: df)) == collapsed(rows)


def test_a_hot_container_of_many_segments(spark, logs_of):
    """100,000 segments of one container: what joins their ends is over blocks, then over their ends."""
    n = 200_000
    logs = spark.range(n).select(
        F.lit("hot").alias("container_id"), F.lit("hot").alias("name"), (F.col("id") / 2).cast("long")
        .alias("segment"), F.col("id").alias("seq"), F.lit("").alias("ts_raw"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("stdout").alias("stream"),
        F.when(F.col("id") < n // 2, "same").otherwise(F.col("id").cast("string")).alias("message"))
    ends = dedup._segment_runs(logs, 3).filter("_head OR _tail")
    block = F.expr(f"segment div {dedup.BLOCK_SEGMENTS}")
    inside = dedup._joined(ends.withColumn("_block", block), ["container_id", "_block"], "segment")
    per_block = inside.groupBy("_block").count().agg(F.max("count")).first()[0]
    told = inside.filter("(_head OR _tail) AND _pos < 2")
    assert told.count() <= 4 * (n // 2 // dedup.BLOCK_SEGMENTS + 1)
    assert per_block <= 4 * dedup.BLOCK_SEGMENTS
    stats = dedup_stats(collapse_repeats(logs)).first()
    assert (stats.original_count, stats.deduplicated_count) == (n, n // 2 + 1)


def test_the_last_row_of_a_container_is_told(logs_of):
    """Wherever its run began, and whatever pieces it has."""
    rng = random.Random(9)
    rows = [(f"c{i % 5}", i, f"t{i}", "stdout", rng.choice("aab")) for i in range(300)]
    rows += [("one", i, f"t{i}", "stdout", "a") for i in range(50)]
    got = collapse_and_write(logs_of(rows, 7), lambda df: df).filter(F.col(dedup.LAST).isNotNull())
    last = got.groupBy("container_id").agg(F.max_by(dedup.LAST, F.struct("segment", "seq")).alias("l"))
    expected = {c: t for c, _, t, _, _ in rows}
    assert {r.container_id: r.l.ts_raw for r in last.collect()} == expected


@pytest.mark.parametrize("batches,span", [(1, 5), (4, 3), (9, 1 << 20)])
def test_runs_over_batches(spark, logs_of, batches, span):
    """Runs that go on over several batches, and containers that are silent in some of them."""
    rng = random.Random(batches)
    rows = [(f"c{rng.randrange(5)}", i, f"t{i}", "stdout", rng.choice("aab") if i % 100 > 30 else "a")
            for i in range(400)]
    step, lines, still = -(-len(rows) // batches), None, None
    for at in range(0, len(rows), step):
        logs = logs_of(rows[at:at + step], span)
        if still is None:
            _, still = dedup.extend_runs(logs, spark.createDataFrame([], OPEN_RUNS))
            still = still.filter("false")
        ended, last = dedup.extend_runs(logs, still)
        done = [r.asDict() for r in last.collect()]
        owners = {r["container_id"] for r in done}
        old = [r for r in still.collect() if r.container_id not in owners]
        lines = (lines or []) + ended.collect()
        still = spark.createDataFrame([*old, *last.collect()], last.schema)
    lines += dedup.ended_runs(still, logs_of(rows).columns).select(*lines[0].__fields__).collect()
    got = sorted((r.container_id, r.seq, r.ts_raw, r.stream, r.message, r.run_len) for r in lines)
    assert got == sorted(collapsed(rows))
