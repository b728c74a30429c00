import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.functions import classify as C
from logspark.functions import parse, prompts, render, text, tokens
from logspark.functions.durations import parse_duration


# ---- parsing --------------------------------------------------------------------------------

@pytest.mark.parametrize("line,ts,message", [
    ("2031-07-09T01:02:03.987654321Z disk sda1 is full", "2031-07-09T01:02:03.987654321Z",
     "disk sda1 is full"),
    ("oneword", "", "oneword"), ("2031-07-09T01:02:03Z ", "2031-07-09T01:02:03Z", ""),
    ("stamp    indented", "stamp", "   indented"), ("", "", ""), ("a\tb c", "a\tb", "c"),
    (" led by a blank", "", "led by a blank"),
    ("t größer als 東京 🚀", "t", "größer als 東京 🚀"), ("t " + "y" * 70_000, "t", "y" * 70_000),
])
def test_line(eval_expr, line, ts, message):
    assert eval_expr(lambda c: parse.line_timestamp(F.col(c)), [line]) == [ts]
    assert eval_expr(lambda c: parse.line_message(F.col(c)), [line]) == [message]


def test_frame_header(spark):
    raw = [b"\x01\0\0\0\0\0\0\x20t out", b"\x02\0\0\0\0\0\0\x20t err", b"\x01short", b"\x03\0\0\0\0\0\0\x20t x",
           b"\x01\0\0\0\0\0\0\x20", "t zwölf bytes".encode()]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, b binary")
    line = F.col("b").cast("string")
    got = df.orderBy("i").select(parse.strip_frame_header(line).cast("binary").alias("l"),
                                 parse.frame_stream(line).alias("s")).collect()
    assert [bytes(r.l) for r in got] == [b"t out", b"t err", *raw[2:]]
    assert [r.s for r in got] == ["stdout", "stderr", None, None, None, None]


@pytest.mark.parametrize("value,expected", [
    ("2025-01-01T10:00:00Z", datetime(2025, 1, 1, 10)),
    ("2025-01-01T10:00:00.5Z", datetime(2025, 1, 1, 10, 0, 0, 500_000)),
    ("2025-01-01T10:00:00.123456789Z", datetime(2025, 1, 1, 10, 0, 0, 123_456)),
    ("2025-01-01T10:00:00+05:30", datetime(2025, 1, 1, 4, 30)),
    ("2025-01-01T23:00:00.25-02:00", datetime(2025, 1, 2, 1, 0, 0, 250_000)),
    ("2025-10-26T02:30:00Z", datetime(2025, 10, 26, 2, 30)),
    ("2025-02-30T10:00:00Z", None), ("2025-01-01 10:00:00Z", None), ("2025-01-01T10:00:00", None),
    ("2025-01-01T25:00:00Z", None), ("2025-01-01T10:60:00Z", None), ("Plain", None), ("", None),
    ("2025-01-01T10:00:00Z\n", None), ("2025-01-01T10:00Z", None), (None, None),
])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_rfc3339(spark, eval_expr, value, expected, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert eval_expr(lambda c: parse.rfc3339(F.col(c)), [value]) == [expected]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("value,expected", [
    ("", timedelta(0)), ("7h", timedelta(hours=7)), ("36h", timedelta(days=1, hours=12)),
    ("45m", timedelta(minutes=45)), ("2h15m10s", timedelta(hours=2, minutes=15, seconds=10)),
    ("0.25h", timedelta(minutes=15)), ("-90s", timedelta(seconds=-90)), ("250ms", timedelta(milliseconds=250)),
])
def test_duration(value, expected):
    assert parse_duration(value) == expected


@pytest.mark.parametrize("value", ["soon", "3d", "h3", "12", "m", "2h3", "4h ", "--1h"])
def test_bad_duration(value):
    with pytest.raises(ValueError):
        parse_duration(value)


# ---- tokens ---------------------------------------------------------------------------------

def test_byte_tokens(eval_expr):
    counter = tokens.byte_tokens(0.1)
    assert eval_expr(lambda c: counter.of_text(F.col(c)), ["x" * 25, "", "é" * 10]) == [2, 0, 2]
    assert eval_expr(lambda c: counter.of_message(F.col(c)), ["x" * 25]) == [6]
    assert eval_expr(lambda c: counter.fits(F.col(c), 2), ["x" * 25, "x" * 30]) == [True, False]


# ---- prompts --------------------------------------------------------------------------------

def test_prompt_markers_in_values_stay(eval_expr):
    fill = lambda c: prompts.render("<{{.Logs}}|{{ .Name }}>", Logs=F.col(c), Name=F.lit("n{{.Logs}}"))
    assert eval_expr(fill, ["x {{.Name}}"]) == ["<x {{.Name}}|n{{.Logs}}>"]


def test_prompt_errors(spark):
    with pytest.raises(KeyError):
        prompts.render("{{.Unknown}}", Logs=F.lit(""))
    with pytest.raises(ValueError):
        prompts.render("{{if .Logs}}", Logs=F.lit(""))


def test_default_prompts(eval_expr):
    p = prompts.Prompts()
    analysis = eval_expr(lambda c: prompts.analysis_prompt(p, F.lit("web"), F.col(c), F.lit(2)), ["L"])[0]
    assert analysis.startswith('Analyze these 2 log entries from container "web":\n\nL\n\nProvide')
    chunk = eval_expr(lambda c: prompts.chunk_summary_prompt(p, F.lit("web"), F.lit(1), F.lit(3),
                                                             F.col(c)), ["L"])[0]
    assert chunk.startswith('This is chunk 1 of 3 from container "web".')
    system = eval_expr(lambda c: prompts.system_prompt(p, F.col(c)), ["", "be brief", None])
    assert system[0] == system[2] == p.system
    assert system[1] == p.system + "\n\nUser Instructions for this container:\nbe brief"


# ---- classification -------------------------------------------------------------------------

@pytest.mark.parametrize("value,issues,warnings", [
    ("a Critical disk", True, False), ("no terrors", True, False), ("eRRoR", True, False),
    ("forewarnings of load", False, True), ("an error after a warning", True, True), ("quiet night", False, False),
    ("", False, False),
])
def test_flags(eval_expr, value, issues, warnings):
    assert eval_expr(lambda c: C.has_issues(F.col(c)), [value]) == [issues]
    assert eval_expr(lambda c: C.has_warnings(F.col(c)), [value]) == [warnings]


@pytest.mark.parametrize("value,service,dashboard", [
    ("An ERROR and a warning", "🔴 Issues Detected", "🔴 Issues"),
    ("a Warning", "🟡 Warnings", "🟡 Warning"), ("fine", "🟢 Healthy", "🟢 OK"),
])
def test_labels(eval_expr, value, service, dashboard):
    assert eval_expr(lambda c: C.service_status(F.col(c)), [value]) == [service]
    assert eval_expr(lambda c: C.dashboard_status(F.col(c)), [value]) == [dashboard]


@pytest.mark.parametrize("value,expected", [
    ("**Summary**: two queues are late\nmore", "two queues are late"),
    ("head\n2) **Summary**: late \n**Summary**: other", "2)  late"), ("z" * 51, "z" * 50 + "..."),
    ("", ""), ("\t\n\t", "\t"), ("z" * 50, "z" * 50), ("in **Summary** here", "in **Summary** here"),
    ("é" * 26, "é" * 25 + "..."), ("x" + "é" * 25, "x" + "é" * 24 + "..."),
    ("**Summary**: a **Summary**: b", "a **Summary**: b"),
])
def test_summary(eval_expr, value, expected):
    assert eval_expr(lambda c: C.extract_summary(F.col(c)), [value]) == [expected]


@pytest.mark.parametrize("value,expected", [
    ("x\n**Errors**: boom\n\n**Warnings**: w", "**Errors**: boom"), ("**Errors**: boom \n", "**Errors**: boom"),
    ("nothing", C.ERRORS_FALLBACK), ("**Warnings** w **Errors** e **Warnings** v", "**Errors** e"),
])
def test_errors(eval_expr, value, expected):
    assert eval_expr(lambda c: C.extract_errors(F.col(c)), [value]) == [expected]


@pytest.mark.parametrize("value,size,expected", [
    ("seven plus more", 7, "seven p..."), ("seven p", 7, "seven p"), ("q", 0, "..."), ("", 0, ""),
    ("aé", 2, "a..."), ("a🙂b", 2, "a..."), ("a🙂b", 4, "a..."), ("a🙂b", 5, "a🙂..."), ("ab\ufffdc", 5, "ab\ufffd..."),
])
def test_truncate(eval_expr, value, size, expected):
    assert eval_expr(lambda c: C.truncate(F.col(c), size), [value]) == [expected]


def test_alert_words(eval_expr):
    got = eval_expr(lambda c: C.needs_alert(F.col(c)), ["Urgent, please", "as planned", "an unexpected Exception"])
    assert got == [True, False, True]


# ---- names, secrets, rendering --------------------------------------------------------------

def test_names(eval_expr):
    one = lambda fn, v: eval_expr(lambda c: fn(F.col(c)), [v])[0]
    assert one(text.sanitize, "a/b_c") == "a_b_c"
    assert one(text.unsanitize, "my_app") == "my/app"
    assert one(text.sanitize_filename, 'a/b\\c:d*e?f"g<h>i|j') == "a_b_c_d_e_f_g_h_i_j"
    assert one(text.short_id, "0123456789abcdef") == "0123456789ab"
    assert one(text.short_id, "orphaned-a-long-name") == "orphaned-a-long-name"
    assert one(text.trim_space, "\u2003 x y\n\t\u00a0") == "x y"


def test_masks(eval_expr):
    keys = eval_expr(lambda c: text.mask_secret(F.col(c)), ["", "tiny", "eightch.", "key-abcdefgh", "ééééé", None])
    assert keys == ["❌ Not set", "***", "***", "key-****efgh", "éé**éé", "❌ Not set"]
    urls = eval_expr(lambda c: text.mask_url(F.col(c)), ["", "slack://a@b", "plain", "a://b://c"])
    assert urls == ["❌ Not configured", "✅ Configured (slack://***)", "✅ Configured (invalid format)",
                    "✅ Configured (a://***)"]


def test_personal_data_is_masked(eval_expr):
    got = eval_expr(lambda c: text.mask_personal(F.col(c)), [
        "login of ann.b+x@mail.example.org from 10.20.30.40", 'api_key = "s3cr et", PASSWORD:hunter2',
        "call +49 (030) 555-0199 or pay 4111 1111 1111 1111", "version 1.2.3 of 2024", None])
    assert got == ["login of [EMAIL] from [IP]", "api_key = [SECRET], PASSWORD:[SECRET]",
                   "call [PHONE] or pay [NUMBER]", "version 1.2.3 of 2024", None]


def test_log_lines(eval_expr):
    line = lambda ts: eval_expr(lambda c: render.log_line(F.lit(ts), F.col(c)), ["line"])[0]
    assert line("t1") == "[t1] line\n" and line("") == "line\n"
    for ts in ("t1", ""):
        size = eval_expr(lambda c: render.log_line_bytes(F.lit(ts), F.col(c)), ["zwölf"])[0]
        assert size == len(eval_expr(lambda c: render.log_line(F.lit(ts), F.col(c)), ["zwölf"])[0].encode())
    assert eval_expr(lambda c: render.budget_line(F.lit(""), F.col(c)), ["line"]) == ["[] line\n"]


def test_savings(spark):
    cases = [(8, 4), (0, 0), (2000, 1998), (3, 1)]
    df = spark.createDataFrame(cases, "o long, p long")
    got = [r[0] for r in df.select(render.savings(F.col("o"), F.col("p"))).collect()]
    assert got[:2] == [50.0, 0.0] and round(got[2], 9) == 0.1 and got[3] == 2 / 3 * 100


def test_one_decimal_rounds_exactly(eval_expr):
    rng = random.Random(0)
    values = [i / 20 for i in range(2001)] + [i / 8 for i in range(800)]
    values += [(o - p) / o * 100 for o in range(1, 120) for p in range(0, o, 3)]
    values += [rng.uniform(0, 100) for _ in range(3000)]
    got = eval_expr(lambda c: render.one_decimal(F.col(c)), values, "double")
    assert got == [f"{v:.1f}" for v in values]


def test_masking_is_linear_and_deep(eval_expr):
    """Thousands of labels overflowed the stack; a long run of letters was tried from each of them."""
    odd = ["a@b" + ".c" * 3000, "x" * 1_000_000, "a@b.c_d@e.f x@y", "@@a.b@c.d.", "a.b+c" * 100_000]
    got = eval_expr(lambda c: text.mask_personal(F.col(c)), odd)
    assert got == ["[EMAIL]", odd[1], "[EMAIL][EMAIL] x@y", "@@[EMAIL].", odd[4]]
