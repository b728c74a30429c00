from datetime import datetime


from logspark.functions.tokens import byte_tokens
from logspark.model import STATE, place
from logspark.operators import cleanup, inference, preview, summary

NOW = datetime(2025, 6, 1, 12)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def state(spark, *rows):
    return spark.createDataFrame([(i, n, NOW, "") for i, n in rows], STATE)


def live(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "container_id string")


def findings(df):
    return sorted(tuple(r) for r in df.select("id", "name", "in_state", "in_kb", "in_reports",
                                              "in_llm_logs").collect())


def found(spark, st, alive, kb=(), reports=(), llm=()):
    stores = cleanup.stored_names(names(spark, *kb), names(spark, *reports), names(spark, *llm))
    return cleanup.find_obsolete(st, alive, stores)


def test_live_container_is_not_reported(spark):
    got = found(spark, state(spark, ("1", "web")), live(spark, "1"), kb=["web"], reports=["web"])
    assert findings(got) == []


def test_removed_container(spark):
    got = found(spark, state(spark, ("1", "web")), live(spark))
    assert findings(got) == [("1", "web", True, False, False, False)]


def test_removed_container_with_data_is_reported_twice(spark):
    got = found(spark, state(spark, ("1", "my/app")), live(spark, "2"), kb=["my_app"], llm=["my_app"])
    assert findings(got) == [("1", "my/app", True, True, False, True),
                             ("orphaned-my_app", "my/app", False, True, False, True)]


def test_orphans(spark):
    """A live container unknown to state counts as orphaned; a live twin of a dead one does not."""
    st = state(spark, ("1", "a"), ("2", "a"), ("3", ""))
    got = found(spark, st, live(spark, "2", "9"), reports=["a", "untracked"])
    assert findings(got) == [("1", "a", True, False, True, False), ("3", "", True, False, False, False),
                             ("orphaned-untracked", "untracked", False, False, True, False)]


def test_stores_that_a_scan_writes(spark):
    """Raw names in the stores, and the form that replaces more than slashes."""
    reports = spark.createDataFrame([("my/app", "my_app"), ("a:b", "a:b")], "name string, storage_name string")
    llm = spark.createDataFrame([("my/app", "my_app"), ("a:b", "a_b")], "name string, storage_name string")
    kb = names(spark, "my/app", "a:b")
    st = state(spark, ("1", "my/app"), ("2", "a:b"))
    held = cleanup.stored_names(kb, reports, llm)
    assert findings(cleanup.find_obsolete(st, live(spark, "1", "2"), held)) == []
    gone = cleanup.find_obsolete(st, live(spark, "1"), held)
    assert ("2", "a:b", True, True, True, True) in findings(gone)
    left = cleanup.apply(cleanup.Stores(st, kb, reports, llm), gone)
    assert [[r.name for r in t.collect()] for t in left] == [["my/app"]] * 4


def test_pseudo_id_does_not_replace_a_state_row(spark):
    got = found(spark, state(spark, ("orphaned-x", "y")), live(spark), kb=["x"])
    assert findings(got) == [("orphaned-x", "y", True, False, False, False)]


def test_report_order(spark):
    got = cleanup.report(found(spark, state(spark, ("b" * 20, "x"), ("a" * 20, "y")), live(spark), kb=["z"]))
    assert [r.short_id for r in got.collect()] == ["a" * 12, "b" * 12, "orphaned-z"]


def test_apply(spark):
    st = state(spark, ("1", "my/app"), ("2", "live"))
    kb, reports, llm = names(spark, "my_app", "live", "old"), names(spark, "my_app"), names(spark, "my_app")
    alive = live(spark, "2")
    obsolete = cleanup.find_obsolete(st, alive, cleanup.stored_names(kb, reports, llm))
    left = cleanup.apply(cleanup.Stores(st, kb, reports, llm), obsolete)
    assert [r.container_id for r in left.state.collect()] == ["2"]
    assert [r.name for r in left.kb.collect()] == ["live"]
    assert left.reports.count() == left.llm_logs.count() == 0
    off = cleanup.apply(cleanup.Stores(st, kb, reports, llm), obsolete, llm_enabled=False)
    assert off.llm_logs.count() == 1


def test_disabled_interaction_log(spark):
    stores = cleanup.stored_names(names(spark, "a"), names(spark), None)
    assert stores.first().asDict() == {"name": "a", "in_kb": True, "in_reports": False, "in_llm_logs": False}


# ---- summaries ------------------------------------------------------------------------------

def analyses(spark, *rows):
    return spark.createDataFrame(rows, "name string, analysis string")


def test_health(spark):
    got = summary.health(analyses(spark, ("a", "an error"), ("b", "a Problem"), ("c", "ok"))).first()
    assert tuple(got) == (3, 1, "⚠️ 1 Service(s) Reporting Issues", True)
    assert tuple(summary.health(analyses(spark, ("c", "ok"))).first()) == (1, 0, "🟢 All Systems Operational", False)
    assert summary.health(analyses(spark).filter("false")).first().issues_found is False


def test_dashboard(spark):
    rows = analyses(spark, ("b", "**Summary**: bad\n**Errors**: e1\n**Warnings**: w"), ("a", "fine"))
    text = "".join(r.piece for r in summary.dashboard(rows, NOW).collect())
    assert text == (
        "# 🌍 Global System Summary\n\n**Last Updated:** Sun, 01 Jun 2025 12:00:00 UTC\n\n"
        "## System Health: ⚠️ 1 Service(s) Reporting Issues\n\n## Service Status\n\n"
        "| Service | Status | Last Analysis |\n|---------|--------|---------------|\n"
        "| a | 🟢 OK | fine |\n| b | 🔴 Issues | bad |\n\n## Recent Critical Issues\n\n### b\n**Errors**: e1\n")
    calm = "".join(r.piece for r in summary.dashboard(analyses(spark, ("a", "ok")), NOW).collect())
    assert calm.endswith("## Recent Critical Issues\n\n*No critical issues reported in the last scan.*")


def test_executive_requests(spark):
    rows = analyses(spark, *[(f"s{i:03}", "x" * 40) for i in range(100)])
    one = summary.executive_requests(rows, "scan", byte_tokens(1.0), 10**6).collect()
    assert len(one) == 1 and "Analyzed 100 container(s):\n\n### s000\nxxx" in one[0].messages[1].content
    many = summary.executive_requests(rows, "scan", byte_tokens(1.0), 510).orderBy("chunk_index").collect()
    assert [r.chunk_total for r in many] == [10] * 10 and len({r.request_id for r in many}) == 10
    held = [line for r in many for line in r.messages[1].content.split("\n") if line.startswith("### ")]
    assert held == [f"### s{i:03}" for i in range(100)]


def test_alert(spark):
    text = spark.createDataFrame([("all well",)], "summary string")
    got = summary.alert(text, summary.health(analyses(spark, ("a", "ok"))), NOW, "Done").first()
    assert got.message == ("Done\n📅 Time: 2025-06-01 12:00:00\n📦 Containers: 1\n✅ No critical issues\n\nall well")


def test_scan_totals(spark, logs_of):
    rows = [("a", 0, "", "", "x"), ("a", 1, "", "", "y"), ("b", 0, "", "", "z")]
    assert tuple(summary.scan_totals(logs_of(rows)).first()) == (2, 3)
    assert tuple(summary.scan_totals(logs_of(rows).filter("false")).first()) == (0, 0)


def test_preview(logs_of):
    rows = [("a", i, "", "", f"m{i}") for i in range(13)] + [("b", 0, "", "", "only")]
    got = preview.preview(logs_of(rows, 4)).orderBy("container_id", "line_no").collect()
    assert [(r.message, r.more_lines) for r in got] == [(f"m{i}", 3) for i in range(10)] + [("only", 0)]


def test_preview_limits_before_the_shuffle(logs_of):
    plan = preview.preview(logs_of([("a", 0, "", "", "m")]))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_latest_per_name(spark):
    rows = spark.createDataFrame([("n", 0, 1, "old"), ("n", 1, 0, "new"), ("o", 0, 0, "x")],
                                 "name string, segment long, seq long, analysis string")
    got = {r.name: r.analysis for r in inference.latest_per_name(rows, place()).collect()}
    assert got == {"n": "new", "o": "x"}


def test_pass_totals_take_no_pass_over_the_lines(spark, logs_of):
    from logspark.operators import budget, dedup, exclude
    from logspark.operators.exclude import LineFilter

    lines = [("a", i, "", "stdout", m) for i, m in enumerate(["x", "x", "x", "noise", "y"])]
    logs = logs_of(lines + [("b", 0, "", "stdout", "z")])
    flagged = exclude.flag_excluded(dedup.collapse_repeats(logs), {"a": LineFilter(("noise",))})
    stats = budget.container_stats(budget.priced_lines(flagged, byte_tokens()))
    totals = summary.pass_totals(stats)
    assert totals.first().asDict() == {
        "scanned_containers": 2, "total_logs": 6, "lines_total": 4, "lines_filtered": 1,
        "lines_kept": 3, "filter_reduction": 25.0, "tokens_saved": 20}
    assert tuple(summary.pass_totals(stats.filter("false")).first()) == (0, 0, 0, 0, 0, 0.0, 0)
