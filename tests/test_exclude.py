import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.functions.patterns import PatternError, fold, required_literals
from logspark.operators import exclude as X
from logspark.operators.dedup import collapse_repeats
from logspark.operators.exclude import LineFilter

LINES = ["DEBUG: a", "INFO: b", "DEBUG: c", "ERROR: d", "DEBUG: e", "WARN: f"]


def rows(messages, container="web"):
    return [(container, i, "", "stdout", m) for i, m in enumerate(messages)]


def kept(df):
    return [r.message for r in df.orderBy("seq").collect()]


def test_any_match_excludes(logs_of):
    rule = {"web": LineFilter(("^DEBUG:", "ERROR"))}
    assert kept(X.exclude_lines(logs_of(rows(LINES)), rule)) == ["INFO: b", "WARN: f"]


@pytest.mark.parametrize("rule", [
    {}, {"other": LineFilter(("^DEBUG:",))}, {"web": LineFilter(("^DEBUG:",), enabled=False)},
    {"web": LineFilter(())}, {"WEB": LineFilter(("^DEBUG:",))}, {"we": LineFilter(("DEBUG",))},
])
def test_no_filter_in_force(logs_of, rule):
    assert kept(X.exclude_lines(logs_of(rows(LINES)), rule)) == LINES
    stats = X.filter_stats(X.flag_excluded(logs_of(rows(LINES)), rule)).first()
    assert (stats.lines_total, stats.lines_filtered, stats.lines_kept) == (6, 0, 6)


def test_stats(logs_of):
    rule = {"web": LineFilter(("^DEBUG:",))}
    stats = X.filter_stats(X.flag_excluded(logs_of(rows(LINES)), rule)).first()
    assert (stats.lines_total, stats.lines_filtered, stats.lines_kept) == (6, 3, 3)
    assert stats.filter_reduction == 50.0 and stats.tokens_saved == 60


def test_case_folding(logs_of):
    lines = ["debug: x", "Debug: y"]
    assert kept(X.exclude_lines(logs_of(rows(lines)), {"web": LineFilter(("debug",))})) == [lines[1]]
    assert kept(X.exclude_lines(logs_of(rows(lines)), {"web": LineFilter(("(?i)debug",))})) == []


def test_repeat_marker_hides_the_line_start(logs_of):
    """Collapsing first changes what an anchored pattern sees; the steps do not commute."""
    logs, rule = logs_of(rows(["DEBUG: a"] * 5)), {"web": LineFilter(("^DEBUG:",))}
    assert kept(X.exclude_lines(collapse_repeats(logs), rule)) == ["[REPEAT x5] DEBUG: a"]
    assert kept(collapse_repeats(X.exclude_lines(logs, rule))) == []


def test_null_message_is_kept(logs_of):
    assert kept(X.exclude_lines(logs_of(rows([None])), {"web": LineFilter(("x",))})) == [None]


def test_invalid_pattern_names_container_and_index():
    with pytest.raises(PatternError, match=r"patterns\[1\] of container 'web'"):
        X.check_filters({"web": LineFilter(("ok", "[bad"))})
    X.check_filters({"web": LineFilter(("[bad",), enabled=False)})


def test_table_of_rules(spark, logs_of):
    rules = spark.createDataFrame(
        [("web", True, ["^DEBUG:", "x$"]), ("off", False, ["."]), ("none", True, [])],
        "name string, enabled boolean, patterns array<string>")
    logs = logs_of(rows(LINES) + rows(["keep"], "off") + rows(["keep"], "none")
                   + rows(["keep"], "unknown"))
    got = X.exclude_by_table(logs, rules)
    assert got.columns == logs.columns
    assert sorted(kept(got)) == sorted(["INFO: b", "ERROR: d", "WARN: f"] + ["keep"] * 3)


def test_rules_of_one_name_count_together(spark, logs_of):
    rules = spark.createDataFrame([("web", True, [r"^(?P<level>DEBUG):"]), ("web", True, [r"[[:digit:]]\z"])],
                                  "name string, enabled boolean, patterns array<string>")
    logs = logs_of(rows(["DEBUG: a", "INFO", "code 7", "code"]))
    assert sorted(kept(X.exclude_by_table(logs, rules))) == ["INFO", "code"]


def test_bad_rules_are_refused(spark, logs_of):
    rules = spark.createDataFrame([("web", True, ["(?=x)"])],
                                  "name string, enabled boolean, patterns array<string>")
    with pytest.raises(PatternError):
        X.exclude_by_table(logs_of(rows(["a"])), rules)


def test_no_shuffle(logs_of):
    df = X.exclude_lines(logs_of(rows(LINES)), {"web": LineFilter(("a",)), "b": LineFilter(("b",))})
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.filter(F.col("message").contains("INFO")).count() == 1


@pytest.mark.parametrize("pattern,expected", [
    ("^DEBUG:", ("debug:",)), ("foo|barn", ("foo", "barn")), ("a(bc|de)f", ("bc", "de")),
    ("(?i)Hello W", ("hello w",)), ("x?abc+d", ("abc",)), ("ab*", None), ("[0-9]+", None), ("", None),
    (r"\Qa.b\Ec", ("a.bc",)), (r"\x41\x{42}c", ("abc",)), ("abc{0,2}de", ("ab",)), ("(abc)?", None),
    ("(abc)+x", ("abc",)), ("(?P<k>abc|x)", None), (r"err\.or$", ("err.or",)), ("(?:abc){2}", ("abc",)),
    ("ab|cd|", None), (r"[ab]cde\d", ("cde",)), ("(?i:AbC)", ("abc",)), ("é日x", ("é日x",))])
def test_required_literals(pattern, expected):
    got = required_literals(pattern)
    assert got == expected or (got is None and expected is None)


ALPHABET = ["a", "B", "k", "K", "s", "ſ", "İ", "ı", "é", "É", "ß", ".", "1", " ", "σ", "ς"]


@given(st.lists(st.sampled_from([*ALPHABET, "(?i:ks)", "(a|Bk)", "[ab]", "x?", "k+", r"\b", "(?i)", "|", "a*", ".", "^"]),
                max_size=6), st.lists(st.sampled_from(ALPHABET), max_size=8))
@settings(max_examples=300, deadline=None)
def test_no_match_without_a_required_literal(parts, chars):
    """Whatever Python's engine matches without regard to case contains one of the literals."""
    pattern, text = "".join(parts), "".join(chars)
    try:
        X.to_java(pattern)
        found = re.compile(pattern.replace("(?i)", ""), re.IGNORECASE).search(text)
    except (PatternError, re.error):
        return
    literals = required_literals(pattern)
    if found and literals is not None:
        assert any(literal in fold(text) for literal in literals)


def test_twenty_thousand_patterns(spark, logs_of):
    """Literal and other patterns, over many rules of two containers; before, 500 overflowed the stack."""
    patterns = [f"^worker {i} (?:failed|died)$" for i in range(15_000)] + [
        f"code={i}[^0-9]" for i in range(4_900)] + [f"[xyz]{{3}}{i}$" for i in range(100)]
    rules = spark.createDataFrame(
        [("web", True, patterns[i:i + 1000]) for i in range(0, 20_000, 1000)] + [("db", True, patterns[:5])],
        "name string, enabled boolean, patterns array<string>")
    lines = ["worker 14999 died", "worker 15000 died", "worker 3 failed", "code=17;", "code=4900;", "xyz42", "xyz420"]
    logs = logs_of(rows(lines) + rows(lines, "db") + rows(["worker 3 failed"], "other"))
    got = X.exclude_by_table(logs, rules)
    assert sorted((r["name"], r["message"]) for r in got.collect()) == sorted(
        [("web", m) for m in ("worker 15000 died", "code=4900;", "xyz420")]
        + [("db", m) for m in lines if m != "worker 3 failed"] + [("other", "worker 3 failed")])


def test_clashing_columns_and_nulls(spark, logs_of):
    rules = spark.createDataFrame([("web", True, ["ab", None]), ("web", True, None), (None, True, ["ab"])],
                                  "name string, enabled boolean, patterns array<string>")
    logs = logs_of(rows(["xabx", "x", None])).withColumns({"_set": F.lit(1), "_tried": F.lit(2)})
    got = X.exclude_by_table(logs, rules)
    assert got.columns == logs.columns and sorted(kept(got), key=str) == [None, "x"]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_PATTERNS": 3000, "BLOCK_BYTES": 16},
                                    {"MOST_PATTERNS": 10**6, "MOST_ENTRIES": 100}])
def test_more_patterns_than_a_task_holds(spark, logs_of, monkeypatch, limits):
    """Over 20,000 distinct patterns, or sets with too many in all, were refused before."""
    for name, value in limits.items():
        monkeypatch.setattr(X, name, value)
    patterns = [f"^worker {i} (?:failed|died)$" for i in range(21_000)] + [
        f"[xyz]{{3}}{i}$" for i in range(100)] + ["(?i)STRASSE|größe", "^$"]
    rules = spark.createDataFrame(
        [("web", True, [*patterns[i:i + 1000], None]) for i in range(0, len(patterns), 1000)]
        + [("db", True, patterns[:5]), ("off", False, patterns[:5]), (None, True, ["keep"])],
        "name string, enabled boolean, patterns array<string>")
    lines = ["worker 20999 died", "worker 21000 died", "worker 3 failed", "xyz42", "xyz420",
             "die GRÖßE", "", "worker 3 failed", None]
    logs = logs_of(rows(lines) + rows(lines, "db") + rows(lines[:3], "off") + rows(["keep"], "other"))
    got = X.exclude_by_table(logs, rules)
    assert got.columns == logs.columns
    assert sorted(((r["name"], r["message"]) for r in got.collect()), key=str) == sorted(
        [("web", m) for m in ("worker 21000 died", "xyz420", None)]
        + [("db", m) for m in lines if m != "worker 3 failed"]
        + [("off", m) for m in lines[:3]] + [("other", "keep")], key=str)


def test_a_bad_rule_among_many_is_refused(spark, logs_of, monkeypatch):
    monkeypatch.setattr(X, "MOST_PATTERNS", 1)
    rules = spark.createDataFrame([("web", True, ["ab", "cd", "(?=x)"])],
                                  "name string, enabled boolean, patterns array<string>")
    with pytest.raises(PatternError, match=r"patterns\[2\] of container 'web'"):
        X.exclude_by_table(logs_of(rows(["a"])), rules)


def test_clashing_columns_among_many_rules(spark, logs_of, monkeypatch):
    monkeypatch.setattr(X, "MOST_PATTERNS", 1)
    rules = spark.createDataFrame([("web", True, ["ab", "cd", None])],
                                  "name string, enabled boolean, patterns array<string>")
    logs = logs_of(rows(["xabx", "x", "cd", None])).withColumns(
        {c: F.lit(1) for c in ("_tried", "_blocks", "_part")})
    got = X.exclude_by_table(logs, rules)
    assert got.columns == logs.columns and sorted(kept(got), key=str) == [None, "x"]
