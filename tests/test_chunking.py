import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.operators.chunking import assign_chunks, chunk_starts, chunk_texts, exit_steps


def packed(tokens, limit, opened=None):
    """(chunk number, tokens open) after each line; ``opened`` tokens are open at the start."""
    chunk, current, out = 0, opened, []
    for t in tokens:
        if current is not None and current + t > limit:
            chunk, current = chunk + 1, t
        else:
            current = (current or 0) + t
        out.append((chunk, current))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(-3, 30),
       st.integers(0, 60))
def test_segment_function(tokens, limit, opened):
    lows, exits, cuts = exit_steps(np.array(tokens), limit)
    last = packed(tokens, limit, opened)[-1]
    if opened + sum(tokens) <= limit:
        assert last == (0, opened + sum(tokens))
    else:
        step = next(i for i, low in enumerate(lows) if low < opened)
        assert last == (cuts[step], exits[step])
    first = packed(tokens, limit)[-1]
    assert (cuts[0] - 1, exits[0]) == first


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(-3, 30),
       st.one_of(st.none(), st.integers(0, 60)))
def test_segment_starts(tokens, limit, opened):
    chunks = [c for c, _ in packed(tokens, limit, opened)]
    before = None if opened is None else 0
    expected = []
    for i, c in enumerate(chunks):
        if c != before:
            expected.append(i)
        before = c
    assert chunk_starts(np.array(tokens), limit, opened) == expected


def frame(spark, rows, span):
    df = spark.createDataFrame(
        rows, "container_id string, seq long, tokens long, chunk_limit long, line string")
    return df.withColumns({"segment": F.expr(f"seq div {span}"), "name": F.col("container_id")})


@pytest.mark.parametrize("span", [1, 4, 33, 1 << 20])
def test_against_sequential_packing(spark, span):
    rng = random.Random(span)
    rows, expected = [], {}
    for c in range(30):
        limit = rng.choice([-5, 0, 1, 10, 25, 400, 10_000])
        tokens = [rng.choice([0, 1, 2, 3, 8, 30]) for _ in range(rng.randint(1, 150))]
        chunks = [k for k, _ in packed(tokens, limit)]
        seq = 0
        for t, k in zip(tokens, chunks):
            rows.append((f"c{c}", seq, t, limit, f"{seq};"))
            expected[f"c{c}", seq] = (k, chunks[-1] + 1)
            seq += rng.choice([1, 1, 2])
    got = assign_chunks(frame(spark, rows, span))
    assert {(r.container_id, r.seq): (r.chunk_index, r.chunk_total) for r in got.collect()} == expected


def test_hot_container(spark):
    """One container over many segments and partitions, next to small ones."""
    rng = random.Random(1)
    tokens = [rng.randint(1, 9) for _ in range(20_000)]
    rows = [("hot", i, t, 100, "x") for i, t in enumerate(tokens)]
    rows += [(f"s{i}", 0, 1, 100, "x") for i in range(50)]
    got = assign_chunks(frame(spark, rows, 500)).filter("container_id = 'hot'").orderBy("seq")
    assert [r.chunk_index for r in got.collect()] == [c for c, _ in packed(tokens, 100)]


def test_texts_and_invariants(spark):
    rng = random.Random(5)
    tokens = [rng.randint(0, 20) for _ in range(500)]
    rows = [("c", i, t, 40, f"{i}\n") for i, t in enumerate(tokens)]
    chunks = chunk_texts(assign_chunks(frame(spark, rows, 64))).orderBy("chunk_index").collect()
    assert "".join(c.text for c in chunks) == "".join(r[4] for r in rows)
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
    assert {c.chunk_total for c in chunks} == {len(chunks)}
    assert all(c.token_count <= 40 or c.n_logs == 1 for c in chunks)
    start = 0
    for c in chunks[:-1]:
        start += c.n_logs
        assert c.token_count + tokens[start] > 40  # the next line did not fit


def test_no_limit_is_one_chunk(spark):
    rows = [("a", 1, 5, None, "y"), ("a", 0, 5, None, "x"), ("b", 0, 9, 1, "z")]
    got = {c.container_id: (c.chunk_index, c.chunk_total, c.text, c.n_logs)
           for c in chunk_texts(assign_chunks(frame(spark, rows, 1))).collect()}
    assert got == {"a": (0, 1, "xy", 2), "b": (0, 1, "z", 1)}


def test_no_lines(spark):
    assert assign_chunks(frame(spark, [], 4)).count() == 0


def test_oversized_line_stands_alone(spark):
    rows = [("c", 0, 500, 100, "long"), ("c", 1, 5, 100, "short")]
    got = chunk_texts(assign_chunks(frame(spark, rows, 10))).orderBy("chunk_index").collect()
    assert [(c.text, c.token_count) for c in got] == [("long", 500), ("short", 5)]


def test_text_segments(spark):
    """Segments may be named by text, as those of log files are."""
    rows = [("c", i, 3, 7, "x") for i in range(10)]
    df = frame(spark, rows, 3).withColumn("segment", F.format_string("f#%05d", F.col("segment")))
    got = assign_chunks(df).orderBy("seq").collect()
    assert [r.chunk_index for r in got] == [i // 2 for i in range(10)]


def test_slim_rows_are_shuffled_once(spark):
    rows = [("c", i, 3, 7, "x") for i in range(100)]
    df = assign_chunks(frame(spark, rows, 3))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and "CartesianProduct" not in plan
    # lines (named again where they are read a second time) and segments
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") == 2
