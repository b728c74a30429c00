"""Budget, requests, results and the whole scan."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.functions.prompts import Prompts
from logspark.functions.tokens import byte_tokens
from logspark.model import KB_HISTORY, RESPONSES, STATE
from logspark.operators import inference
from logspark.operators.exclude import LineFilter
from logspark.plans import scan
from logspark.plans.scan import ScanOptions
from logspark.sources.logs import read_log_files
from logspark.sources.tables import VersionedTable

NOW = datetime(2025, 6, 1, 12)
SHORT = Prompts(system="S", analysis="A {{.ContainerName}} {{.LogCount}}\n{{.Logs}}",
                chunk_summary="C {{.ChunkNum}}/{{.TotalChunks}}\n{{.Logs}}", synthesis="Y\n{{.Summaries}}")


def options(**kw):
    return ScanOptions(**{"now": NOW, "scan_id": "scan", "max_tokens": 4200, "counter": byte_tokens(1.0), "prompts": SHORT, **kw})


def rows(container, *messages, ts="t"):
    return [(container, i, ts, "stdout", m) for i, m in enumerate(messages)]


def prepare(logs, opts, ignore=None):
    """A first scan: no container is known."""
    return scan.prepare(logs, logs.sparkSession.createDataFrame([], STATE), opts, ignore)


def second_requests(prepared, responses, opts):
    return scan.next_requests(prepared, prepared.requests, responses, opts, 0)


def with_time(df):
    return df.withColumn("ts", F.lit("2025-06-01 11:30:00").cast("timestamp_ntz"))


def budget_of(prepared):
    return {r.container_id: r for r in prepared.budgets.collect()}


def reply(request, content, total=15, choices=1, error=None):
    return (request, [(0, ("assistant", content), "stop")] * choices, (10, 5, total), error)


def answers(spark, *replies):
    return spark.createDataFrame(list(replies), RESPONSES)


def test_counts_and_direct_request(logs_of):
    logs = logs_of(rows("web", *["Repeated message"] * 4, "Unique message"))
    prepared = prepare(logs, options())
    b = budget_of(prepared)["web"]
    assert (b.original_count, b.processed_count, b.deduplicated, b.strategy) == (5, 2, True, "direct")
    request = prepared.requests.first()
    assert request.kind == "direct" and request.temperature == 0.3 and request.max_tokens == 4000
    assert [m.content for m in request.messages] == [
        "S", "A web 2\n[t] [REPEAT x4] Repeated message\n[t] Unique message\n"]
    assert request.request_id == "scan/web/direct/0"


def test_filter_counts_follow_the_collapse(logs_of):
    logs = logs_of(rows("web", "DEBUG: 1", "DEBUG: 2", "DEBUG: 3", "INFO", "ERROR", "WARN"))
    b = budget_of(prepare(logs, options(filters={"web": LineFilter(("^DEBUG:",))})))["web"]
    assert (b.lines_total, b.lines_filtered, b.lines_kept, b.processed_count) == (6, 3, 3, 3)
    assert not b.deduplicated


def test_budget_sizes(logs_of):
    """system + 4, the prompt without lines, and the rendered text, bracketless without a time."""
    b = budget_of(prepare(logs_of(rows("web", "äb", ts="") + [("web", 9, "t9", "stdout", "x")]),
                               options()))["web"]
    assert (b.system_tokens, b.base_tokens) == (1 + 4, len("A web 2\n"))
    assert b.logs_tokens == len("äb\n".encode()) + len("[t9] x\n")


def test_budget_edge(logs_of):
    logs = logs_of(rows("web", "x" * 100))
    total = budget_of(prepare(logs, options()))["web"].total_tokens
    at = budget_of(prepare(logs, options(max_tokens=total + 4000)))["web"]
    over = budget_of(prepare(logs, options(max_tokens=total + 3999)))["web"]
    assert (at.strategy, at.chunk_limit) == ("direct", None)
    assert over.strategy == "chunked" and over.chunk_limit == (total - 1 - 5) // 2


def test_limit_below_zero_gives_a_line_per_chunk(logs_of):
    prepared = prepare(logs_of(rows("web", "a", "b", "c", "d")), options(max_tokens=500))
    assert budget_of(prepared)["web"].chunk_limit == -(3505 // 2)  # toward zero
    assert prepared.requests.count() == 4
    first = prepared.requests.orderBy("chunk_index").first()
    assert (first.kind, first.max_tokens, first.messages[1].content) == ("chunk", 2000, "C 1/4\n[t] a\n")


def test_everything_excluded_still_asks(logs_of):
    filters = {"web": LineFilter((".",))}
    request = prepare(logs_of(rows("web", "a")), options(filters=filters)).requests.first()
    assert request.messages[1].content == "A web 0\n"


def test_nothing_left_and_no_room(logs_of, spark):
    opts = options(filters={"web": LineFilter((".",))}, max_tokens=10)
    prepared = prepare(logs_of(rows("web", "a")), opts)
    assert prepared.requests.count() == 0
    got = inference.results(prepared.budgets, prepared.requests, answers(spark), opts.counter)
    r = got.first()
    assert (r.analysis, r.tokens_used, r.chunks_used) == (inference.NOTHING_PROCESSED, 0, 0)


def test_instructions(logs_of, spark):
    ignore = spark.createDataFrame([("my_app", "Skip noise")], "file_stem string, instructions string")
    prepared = prepare(logs_of(rows("my/app", "a") + rows("other", "b")), options(), ignore)
    system = {r.name: r.messages[0].content for r in prepared.requests.collect()}
    assert system == {"my/app": "S\n\nUser Instructions for this container:\nSkip noise", "other": "S"}


def text_of(i):
    return f"message {i} " + "x" * 150


def chunked(logs_of, max_tokens=4400):
    opts = options(max_tokens=max_tokens)
    prepared = prepare(logs_of(rows("big", *[text_of(i) for i in range(6)]) + rows("small", "x")), opts)
    return opts, prepared


def test_two_rounds(spark, logs_of):
    opts, prepared = chunked(logs_of)
    assert budget_of(prepared)["big"].chunk_limit == (400 - 5) // 2
    first = {r.request_id: r for r in prepared.requests.collect()}
    big = sorted(k for k in first if "/big/" in k)
    assert big == [f"scan/big/chunk/{i}" for i in range(6)]  # one line of 197 tokens at most each
    replies = [reply(k, f"sum {k[-1]}") for k in big] + [reply("scan/small/direct/0", "fine", 150)]
    second = second_requests(prepared, answers(spark, *replies), opts).collect()
    assert len(second) == 1 and second[0].kind == "synthesis"
    parts = "".join(f"\n--- Chunk {i + 1} Summary ---\nsum {i}\n" for i in range(6))
    assert second[0].messages[1].content == "Y\n" + parts
    requests = prepared.requests.unionByName(second_requests(prepared, answers(spark, *replies), opts))
    responses = answers(spark, *replies, reply(second[0].request_id, "final", 100))
    got = {r.name: r for r in inference.results(prepared.budgets, requests, responses, opts.counter).collect()}
    texts = sum(len(f"[t] {text_of(i)}\n") for i in range(6))
    assert (got["big"].analysis, got["big"].chunks_used) == ("final", 6)
    assert got["big"].tokens_used == texts + 6 * len("sum 0") + 100
    assert (got["small"].analysis, got["small"].tokens_used, got["small"].chunks_used) == ("fine", 150, 1)


@pytest.mark.parametrize("broken", [
    reply("scan/big/chunk/2", "x", choices=0), reply("scan/big/chunk/2", "x", error=("bad", "t", "c1")), None,
])
def test_one_failed_chunk_fails_its_container(spark, logs_of, broken):
    opts, prepared = chunked(logs_of)
    replies = [reply(f"scan/big/chunk/{i}", "s") for i in range(6) if i != 2]
    replies += [reply("scan/small/direct/0", "fine")] + ([broken] if broken else [])
    responses = answers(spark, *replies)
    assert second_requests(prepared, responses, opts).count() == 0
    got = inference.results(prepared.budgets, prepared.requests, responses, opts.counter)
    assert [r.name for r in got.collect()] == ["small"]
    failed = inference.unwrap(prepared.requests, responses).filter("failure IS NOT NULL").collect()
    expected = {"c1: bad"} if broken and broken[3] else {"no choices in response"} if broken else {"no response"}
    assert {r.failure for r in failed} == expected
    names = inference.failed_containers(prepared.requests, responses)
    assert [r.name for r in names.collect()] == ["big"]


def test_failed_synthesis_fails_its_container(spark, logs_of):
    opts, prepared = chunked(logs_of)
    replies = [reply(f"scan/big/chunk/{i}", "s") for i in range(6)]
    second = second_requests(prepared, answers(spark, *replies), opts)
    requests = prepared.requests.unionByName(second)
    responses = answers(spark, *replies, reply("scan/small/direct/0", "fine"),
                        reply("scan/big/synthesis/0", "", choices=0))
    assert [r.name for r in inference.results(prepared.budgets, requests, responses, opts.counter).collect()] == ["small"]
    assert [r.name for r in inference.failed_containers(requests, responses).collect()] == ["big"]


def test_long_summaries_are_reduced_to_one_request(spark, logs_of):
    """However long the replies, a container ends as one result: packed, level by level."""
    opts, prepared = chunked(logs_of)
    kinds = []

    def answer(requests):
        rows = requests.collect()
        kinds.append(sorted({r.kind for r in rows}))
        return answers(spark, *[reply(r.request_id, "s" * (120 if len(kinds) < 3 else 20)) for r in rows])

    requests, responses = scan.reduce_all(prepared, answer, opts)
    assert kinds == [["chunk", "direct"], ["synthesis"], ["synthesis1"], ["synthesis2"]]
    got = inference.results(prepared.budgets, requests, responses, opts.counter)
    assert sorted(r.name for r in got.collect()) == ["big", "small"]
    assert inference.failed_containers(requests, responses).count() == 0


def test_what_cannot_be_reduced_fails(spark, logs_of):
    """Replies too long to be packed in twos would never end: the container is failed, not absent."""
    opts, prepared = chunked(logs_of)
    requests, responses = scan.reduce_all(
        prepared, lambda rs: answers(spark, *[reply(r.request_id, "s" * 380) for r in rs.collect()]), opts)
    assert [r.name for r in inference.failed_containers(requests, responses).collect()] == ["big"]
    assert [r.name for r in inference.results(
        prepared.budgets, requests, responses, opts.counter).collect()] == ["small"]


def test_repeated_responses_count_once(spark, logs_of):
    prepared = prepare(logs_of(rows("web", "a")), options())
    for replies in ([reply("scan/web/direct/0", "fine", 7)] * 2,
                    [reply("scan/web/direct/0", "x", 9, error=("bad", "t", "c")), reply("scan/web/direct/0", "fine", 7)]):
        got = inference.results(prepared.budgets, prepared.requests, answers(spark, *replies),
                                byte_tokens(1.0)).first()
        assert (got.analysis, got.tokens_used, got.chunks_used) == ("fine", 7, 1)


def test_packed_synthesis_converges(spark, logs_of):
    """More summaries than fit are combined over several levels, keeping their order."""
    opts, prepared = chunked(logs_of)
    summaries = inference.chunk_summaries(
        prepared.requests, answers(spark, *[reply(f"scan/big/chunk/{i}", f"sum {i}") for i in range(6)]))
    level, sizes = 0, []
    while True:
        requests = inference.synthesis_requests(summaries, prepared.budgets, "scan", opts.counter, 70,
                                                opts.prompts, level)
        got = requests.orderBy("chunk_index").collect()
        sizes.append(len(got))
        if len(got) == 1:
            break
        replies = [reply(r.request_id, f"part {r.chunk_index}") for r in got]
        summaries = inference.next_level(requests, answers(spark, *replies))
        level += 1
    assert sizes == [3, 2, 1]
    assert got[0].messages[1].content.index("part 0") < got[0].messages[1].content.index("part 1")


def test_executive_request_takes_one_result_per_name(spark):
    rows = spark.createDataFrame([("1", "web", "old"), ("2", "web", "new"), ("3", "db", "d")],
                                 "container_id string, name string, analysis string")
    prompts = Prompts(system="S", executive="{{.ContainerCount}}\n{{.ContainerAnalyses}}")
    asked = []

    def answer(requests):
        asked.extend(requests.collect())
        return answers(spark, *[reply(r.request_id, "all in all") for r in asked])

    got = scan.executive(rows, answer, options(prompts=prompts)).collect()
    assert [r.summary for r in got] == ["all in all"] and len(asked) == 1
    assert asked[0].messages[1].content == "2\n### db\nd\n\n### web\nnew\n\n"


def test_executive_reduces_to_one_reply(spark):
    rows = spark.createDataFrame([(f"{i:03}", f"s{i:03}", "x" * 60) for i in range(40)],
                                 "container_id string, name string, analysis string")
    prompts = Prompts(system="S", executive="{{.ContainerCount}}\n{{.ContainerAnalyses}}")
    sizes = []

    def answer(requests):
        got = requests.collect()
        sizes.append(len(got))
        assert all(len(r.messages[1].content) <= 400 for r in got)
        return answers(spark, *[reply(r.request_id, f"sum {r.chunk_index}") for r in got])

    reply_row = scan.executive(rows, answer, options(max_tokens=4400, prompts=prompts)).collect()
    assert len(reply_row) == 1 and sizes[-1] == 1 and len(sizes) > 1
    text = scan.alert(rows, spark.createDataFrame(reply_row), options(), "Done").first()
    assert text.message.endswith("\nsum 0") and text.containers == 40


def test_scan_of_log_files(spark, logs_of, tmp_path):
    """Files cut into many splits give the requests that the same lines give in one piece."""
    rng = random.Random(3)
    texts = {"web": [rng.choice("aab") * rng.randint(1, 30) for _ in range(3000)], "db": ["x"] * 50}
    for name, messages in texts.items():
        (tmp_path / f"{name}.log").write_text("".join(f"t {m}\n" for m in messages))
    opts = options(max_tokens=4400, filters={"web": LineFilter(("^b+$",))})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        split = prepare(read_log_files(spark, str(tmp_path)).withColumn("ts", F.lit(None).cast("timestamp_ntz")), opts)
        whole = prepare(logs_of(sum((rows(n, *m) for n, m in texts.items()), [])), opts)
        got, expected = ({r.request_id: r.messages[1].content for r in p.requests.collect()}
                         for p in (split, whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected and len(got) > 50


# ---- the whole scan -------------------------------------------------------------------------

def stores(tmp_path):
    return scan.Stores(VersionedTable(str(tmp_path / "state"), STATE),
                       VersionedTable(str(tmp_path / "kb"), KB_HISTORY), str(tmp_path / "reports"),
                       str(tmp_path / "dashboard"), str(tmp_path / "llm"))


def finished(spark, logs_of, tmp_path, **kw):
    opts = options(**kw)
    logs = with_time(logs_of(rows("web", "a", "b", ts="2025-06-01T11:30:00Z")
                             + rows("db", "c", ts="2025-06-01T11:30:00Z")))
    prepared = prepare(logs, opts)
    responses = answers(spark, reply("scan/web/direct/0", "**Summary**: an error\n**Errors**: e"),
                        reply("scan/db/direct/0", "", choices=0))
    where = stores(tmp_path)
    return scan.finish(prepared, prepared.requests, responses, opts, where), where


def test_finish_writes_everything(spark, logs_of, tmp_path):
    results, where = finished(spark, logs_of, tmp_path)
    assert [r.name for r in results.collect()] == ["web"]
    report = spark.read.parquet(where.reports).first()
    assert report.file == "/web/2025-06-01_12-00-00.md"
    assert report.content.startswith("# Scan Report: web\n\n**Date:** Sun, 01 Jun 2025 12:00:00 UTC  \n")
    assert "| Original Logs | 2 |\n" in report.content and "Deduplication" not in report.content
    kb = where.history.read(spark).first()
    assert (kb.name, kb.status, kb.scan_ts) == ("web", "🔴 Issues Detected", NOW)
    text = "\n".join(r.value for r in spark.read.text(where.dashboard).collect())
    assert "⚠️ 1 Service(s) Reporting Issues" in text and "| web | 🔴 Issues | an error |" in text
    log = spark.read.parquet(where.interactions).first()
    assert json.loads(log.request_json)["max_tokens"] == 4000
    assert json.loads(log.response_json)["usage"]["total_tokens"] == 15
    state = {r.name: r.last_scan for r in where.state.read(spark).collect()}
    assert state == {n: datetime(2025, 6, 1, 11, 30) for n in ("web", "db")}  # the failed one moves too


def test_rows_that_arrive_meanwhile_wait(spark, logs_of, tmp_path):
    """The cursor moves as far as was analysed, whatever is read at the end."""
    path = str(tmp_path / "logs")
    with_time(logs_of(rows("web", "a", ts="2025-06-01T11:30:00Z"))).write.parquet(path)
    where = stores(tmp_path)
    prepared = scan.prepare(spark.read.parquet(path), where.state.read(spark), options())
    late = logs_of([("web", 1, "2025-06-01T11:50:00Z", "stdout", "b")]).withColumn(
        "ts", F.lit("2025-06-01 11:50:00").cast("timestamp_ntz"))
    late.write.mode("append").parquet(path)
    responses = answers(spark, reply("scan/web/direct/0", "fine"))
    for _ in range(2):  # a retry changes nothing
        scan.finish(prepared, prepared.requests, responses, options(), where)
        assert [r.last_scan for r in where.state.read(spark).collect()] == [datetime(2025, 6, 1, 11, 30)]
        assert where.history.read(spark).count() == spark.read.parquet(where.reports).count() == 1
        assert spark.read.parquet(where.interactions).count() == 1
    spark.catalog.refreshByPath(path)
    again = scan.prepare(spark.read.parquet(path), where.state.read(spark), options(scan_id="two"))
    assert "b" in again.requests.first().messages[1].content


def test_scratch_leaves_nothing(spark, logs_of, tmp_path):
    from pathlib import Path

    from logspark.session import scratch, shared_folder

    folder = Path(shared_folder(spark)) / f"logspark-{spark.sparkContext.applicationId}"
    before = set(folder.iterdir()) if folder.exists() else set()
    with scratch(spark):
        finished(spark, logs_of, tmp_path)
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_failures_can_hold_the_cursor(spark, logs_of, tmp_path):
    _, where = finished(spark, logs_of, tmp_path, advance_on_failure=False)
    assert [r.name for r in where.state.read(spark).collect()] == ["web"]


def test_lookback_leaves_the_cursors(spark, logs_of, tmp_path):
    _, where = finished(spark, logs_of, tmp_path, lookback=timedelta(hours=1))
    assert where.state.versions(spark) == [] and where.history.versions(spark) == [0]


def test_dry_run_writes_nothing(spark, logs_of, tmp_path):
    _, where = finished(spark, logs_of, tmp_path, dry_run=True)
    assert list(tmp_path.iterdir()) == []
