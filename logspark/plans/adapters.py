"""The test tables as logs, containers, state, stores and analyses.

Everything is derived from whole tables by declarative rules, so the same can be said in SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import SERVICE_LABELS
from ..functions.parse import FRAME_STREAMS, STDOUT
from ..model import SEGMENT_SPAN, SOURCE, ZERO_TIME, with_segment
from ..operators.exclude import LineFilter
from ..sources.logs import parse_lines, split_lines

# The moment the derived scans run at, just behind the newest event.
NOW = datetime(2024, 1, 31)
# Containers without an event since then no longer exist.
LIVE_SINCE = "2024-01-30 12:00:00"

EVENT_FILTERS = {
    "app/user-1": LineFilter(("^view$", "^click$")),
    "app/user-2": LineFilter(("(?i)^CLICK",)),
    "app/user-3": LineFilter(("^error$",)),
    "app/user-5": LineFilter((r"^\[REPEAT x\d+\]",)),
    "app/user-8": LineFilter(("(?P<kind>sign|view)", "purchase$")),
    "app/user-13": LineFilter(("view", "click"), enabled=False),
    "app/user-21": LineFilter(()),
    "app/user-34": LineFilter(("[[:alpha:]]",)),
    "app/user-55": LineFilter((r"\berror\b", r"\Bgnup$")),
}
DOC_FILTERS = {
    "src0": LineFilter(("^The",)),
    "src1": LineFilter(("(?i)the", r"\d+")),
    "src2": LineFilter((r"[[:punct:]]$",)),
    "src3": LineFilter((r"^\[REPEAT x\d+\]", "^$")),
    "src5": LineFilter((r"\bde\b",)),
    "src8": LineFilter(("que|les", r"[A-Z][a-z]+\.$")),
    "src13": LineFilter((r"@|https?://",)),
}

# Ignore instructions and container names are read from the event rows as well.
IGNORE_TEXT = "Skip routine %s entries."


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def user_name(user_id: Column) -> Column:
    return F.concat(F.lit("app/user-"), user_id.cast("string"))


def event_logs(spark: SparkSession, folder: str, span: int = SEGMENT_SPAN) -> DataFrame:
    """Events as logs: a container per user, the event type as message, in event order."""
    return events_to_logs(read(spark, folder, "events"), span)


def events_to_logs(e: DataFrame, span: int = SEGMENT_SPAN) -> DataFrame:
    text = F.translate(F.col("ts").cast("string"), " ", "T")
    dotted = F.when(F.char_length(text) == 19, F.concat(text, F.lit("."))).otherwise(text)
    stamp = F.concat(F.rpad(dotted, 26, "0"), F.lit("Z"))
    logs = e.select(
        F.col("user_id").cast("string").alias(SOURCE), user_name(F.col("user_id")).alias("name"),
        F.col("event_id").alias("seq"), stamp.alias("ts_raw"), "ts",
        F.lit(STDOUT).alias("stream"), F.col("event_type").alias("message"))
    return with_segment(logs, span)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event files as a stream."""
    schema = read(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def order_logs(spark: SparkSession, folder: str, span: int = SEGMENT_SPAN) -> DataFrame:
    """Orders as logs: a container per priority, the status as message."""
    o = read(spark, folder, "orders")
    logs = o.select(
        F.col("o_orderpriority").alias(SOURCE), F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("seq"), F.lit("").alias("ts_raw"),
        F.col("o_orderdate").alias("ts"), F.lit(STDOUT).alias("stream"),
        F.col("o_orderstatus").alias("message"))
    return with_segment(logs, span)


def doc_lines(spark: SparkSession, folder: str, group: int = 4096) -> DataFrame:
    """Every line of every document, unparsed: a container per source."""
    d = read(spark, folder, "documents").select(
        F.col("source").alias(SOURCE), F.col("source").alias("name"), "doc_id", "text")
    return split_lines(d, "text", "doc_id", group)


def doc_logs(spark: SparkSession, folder: str, group: int = 4096) -> DataFrame:
    """The same lines as messages without a timestamp."""
    return doc_lines(spark, folder, group).select(
        SOURCE, "name", "segment", "seq", F.lit("").alias("ts_raw"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(STDOUT).alias("stream"),
        F.col("value").alias("message"))


def conversation_logs(spark: SparkSession, folder: str, span: int = SEGMENT_SPAN) -> DataFrame:
    """Conversations as logs: a container per conversation, the role as stream."""
    c = read(spark, folder, "conversations")
    logs = c.select(
        F.col("conv_id").cast("string").alias(SOURCE),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"),
        F.col("turn").alias("seq"), F.lit("").alias("ts_raw"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("role").alias("stream"),
        F.col("text").alias("message"))
    return with_segment(logs, span)


def raw_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`event_texts`, parsed."""
    return parse_lines(event_texts(spark, folder))


def framed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same with frame headers: clicks from one stream, errors from the other."""
    header = (F.when(F.col("message") == "click", F.lit("\x01\0\0\0\0\0\0\x20"))
              .when(F.col("message") == "error", F.lit("\x02\0\0\0\0\0\0\x20")).otherwise(F.lit("")))
    lines = event_logs(spark, folder)
    return parse_lines(lines.select(SOURCE, "seq", F.concat(header, "ts_raw", F.lit(" "), "message")
                                    .alias("value")))


def frame_lines(spark: SparkSession, folder: str, block: int = 1 << 16) -> DataFrame:
    """Events as lines of frames, errors on stderr: a folder per kind, a file per ``block`` events."""
    lines = event_logs(spark, folder)
    file = F.format_string("%s/%012d.frames", "message", F.floor(F.col("seq") / block))
    return lines.select(
        file.alias("file"), "seq",
        F.when(F.col("message") == "error", FRAME_STREAMS[2]).otherwise(FRAME_STREAMS[1])
        .alias("stream"), F.concat_ws(" ", "ts_raw", "name").alias("value"))


def event_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw log lines, each type with its own timestamp style (one of them malformed)."""
    e = read(spark, folder, "events")
    kind, ts = F.col("event_type"), F.col("ts")

    def stamp(pattern: str, shift: str = "0 hours") -> Column:
        return F.date_format(ts + F.expr(f"INTERVAL {shift}"), pattern)

    seconds, micros = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = (F.when(kind == "click", F.concat(stamp(seconds), F.lit("Z "), "event_type"))
            .when(kind == "view", F.concat(stamp(micros, "2 hours"), F.lit("+02:00 "), "event_type"))
            .when(kind == "error", F.concat(stamp(micros, "-5 hours"), F.lit("789-05:00  "),
                                            "event_type"))
            .when(kind == "signup", kind)
            .otherwise(F.concat(stamp("yyyy/MM/dd"), F.lit(" "), "props")))
    return e.select(F.col("user_id").cast("string").alias(SOURCE), F.col("event_id").alias("seq"),
                    text.alias("value"))


def state(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors: each user's last signup; users without one, or whose last event is an error, are
    unknown."""
    users = read(spark, folder, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last_scan"),
        F.max_by("event_type", "event_id").alias("last"))
    return users.filter(F.col("last_scan").isNotNull() & (F.col("last") != "error")).select(
        F.col("user_id").cast("string").alias(SOURCE), user_name(F.col("user_id")).alias("name"),
        "last_scan", F.lit("").alias("log_cursor"))


def unread(spark: SparkSession, folder: str) -> DataFrame:
    """A state in which every user is known and nothing has been read."""
    users = read(spark, folder, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias(SOURCE), user_name(F.col("user_id")).alias("name"),
        F.lit(ZERO_TIME).cast("timestamp_ntz").alias("last_scan"), F.lit("").alias("log_cursor"))


def containers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as containers; those with a positive balance are running."""
    s = read(spark, folder, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias(SOURCE),
        F.concat(F.lit("/"), "s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, "running").otherwise("exited").alias("state"),
        F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("image"))


def live(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return (e.filter(F.col("ts") >= F.lit(LIVE_SINCE).cast("timestamp_ntz"))
            .select(F.col("user_id").cast("string").alias(SOURCE)).distinct())


def store(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """A store that keeps a row per event of some kinds, under the storage name."""
    e = read(spark, folder, "events")
    return e.filter(F.col("event_type").isin(*kinds)).select(
        F.translate(user_name(F.col("user_id")), "/", "_").alias("name"),
        F.col("event_id").alias("entry"))


def ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions for each user whose last event is no click, naming the kind of the strongest."""
    users = read(spark, folder, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last"),
        F.max_by("event_type", F.struct("value", "event_id")).alias("kind"))
    return users.filter("last <> 'click'").select(
        F.translate(user_name(F.col("user_id")), "/", "_").alias("file_stem"),
        F.format_string(IGNORE_TEXT, "kind").alias("instructions"))


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """A filter table in the RE2 dialect: users leave out their last and collapsed first kind.

    Two rows a user, and the rules of users whose strongest event is a view are disabled.
    """
    e = read(spark, folder, "events")
    users = e.groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last"),
        F.min_by("event_type", "event_id").alias("first"),
        (F.max_by("event_type", F.struct("value", "event_id")) != "view").alias("enabled"))
    patterns = F.array(F.concat(F.lit("^(?P<kind>"), "last", F.lit(r")\z")),
                       F.concat(F.lit(r"^\[REPEAT x[[:digit:]]+\] "), "first"))
    return users.select(user_name(F.col("user_id")).alias("name"), "enabled",
                        F.explode(F.transform(patterns, lambda p: F.array(p))).alias("patterns"))


def broken_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of :func:`rules`, of which every fifth user's are not valid."""
    kinds = F.array(F.lit("("), F.lit("*"), F.lit("(?=x)"), F.lit("[z-"), F.lit("a{2000}"))
    own = rules(spark, folder)
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    broken = F.get(kinds, (F.floor(number / 5) % 5).cast("int"))
    return own.withColumn("patterns", F.when(number % 5 == 0, F.concat(
        "patterns", F.array(broken))).otherwise(F.col("patterns")))


def duration_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Durations of all forms, from the orders' keys; every thirteenth is none."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.when(key % 3 == 0, "-").when(key % 3 == 1, "+").otherwise(""), (key % 30).cast("string"),
        F.lit("h"), (key % 61).cast("string"), F.lit("."), (key % 10).cast("string"), F.lit("m."),
        (key % 7).cast("string"), F.lit("s"), (key % 1000).cast("string"), F.lit("us"))
    return read(spark, folder, "orders").select("o_orderkey", F.when(key % 13 == 0, F.concat(
        text, F.lit("x"))).when(key % 17 == 0, "0").otherwise(text).alias("text"))


def word_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A large filter table: two words of every document, as patterns of the document's source."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))
    pair = F.filter(F.array(F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)), F.isnotnull)
    return read(spark, folder, "documents").where(F.col("text").isNotNull()).select(
        F.col("source").alias("name"), (F.col("source") != "src4").alias("enabled"),
        F.transform(pair, lambda w: F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b"))).alias("patterns"))


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    """An analysis text per user, shaped by the kind of the user's last event."""
    e = read(spark, folder, "events")
    users = e.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("string").alias("n"),
        F.count_if(F.col("event_type") == "purchase").cast("string").alias("buys"),
        F.max_by("event_type", "event_id").alias("kind"))
    n, buys = F.col("n"), F.col("buys")
    text = (F.when(F.col("kind") == "error", F.concat(
                F.lit("Report\n  **Summary**: "), n, F.lit(" entries, bad end \n**Errors**: "), buys,
                F.lit(" orders lost\n\n**Warnings**: none\n")))
            .when(F.col("kind") == "purchase", F.concat(
                F.lit("Warning: "), buys, F.lit(" purchases among "), n,
                F.lit(" entries of this container, see below\nnothing else")))
            .when(F.col("kind") == "click", F.concat(
                F.lit("**Summary**: quiet, "), n, F.lit(" entries")))
            .when(F.col("kind") == "view", F.concat(F.lit("Viewed "), n, F.lit(" pages")))
            .otherwise(F.concat(F.lit("CRITICAL signup spree after "), n, F.lit(" entries"))))
    return users.select(user_name(F.col("user_id")).alias("name"), text.alias("analysis"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """History entries: one per event; those of kind view lost their time."""
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    known = kind != "view"
    raw = F.when(known, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("unknown"))
    return e.select(
        user_name(F.col("user_id")).alias("name"), raw.alias("scan_ts_raw"),
        F.when(known, F.date_trunc("second", F.col("ts").cast("timestamp"))
               .cast("timestamp_ntz")).alias("scan_ts"),
        F.when(kind == "error", SERVICE_LABELS[0]).when(kind == "purchase", SERVICE_LABELS[1])
        .otherwise(SERVICE_LABELS[2]).alias("status"),
        F.concat(F.lit("entry "), F.col("event_id").cast("string")).alias("analysis"))


def responses(requests: DataFrame) -> DataFrame:
    """Answers to chunk and direct requests, derived from the lines they are about.

    Requests about a single line get no choices, so their containers fail.
    """
    n, tokens = F.col("n_logs"), F.col("token_count")
    return _answers(requests, F.concat(F.lit("**Summary**: "), n.cast("string"), F.lit(" lines, "),
                                    tokens.cast("string"), F.lit(" tokens")), tokens, n, n == 1)


def answer(requests: DataFrame) -> DataFrame:
    """Answers to a round of requests of any kind."""
    combining = F.col("kind").startswith("synthesis") | F.col("kind").startswith("executive")
    return responses(requests.filter(~combining)).unionByName(
        synthesis_responses(requests.filter(combining)))


def synthesis_responses(requests: DataFrame) -> DataFrame:
    """Answers to synthesis requests that report how long the request was."""
    size = F.char_length(F.get("messages", F.lit(1))["content"]).cast("long")
    return _answers(requests, F.concat(F.lit("**Summary**: all of "), size.cast("string"),
                                       F.lit(" characters")), size, F.lit(7).cast("long"),
                    F.lit(False))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    inner = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substr(inner, F.lit(6), F.char_length(inner) - 6)


def provider_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """A response text for each event, of thirteen shapes that providers give."""
    def joined(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    no, words = F.col("event_id"), _quoted(F.col("props"))
    given, made = no % 100, no % 7
    message = joined('{"index":0,"message":{"role":"assistant","content":', words, '}}')
    total = joined('"usage":{"prompt_tokens":', given, ',"completion_tokens":', made,
                   ',"total_tokens":', given + made, '}')
    shapes = [
        joined('{"choices":[', message, '],', total, '}'),
        joined('{"id":"r","extra":{"a":[1,null]},"choices":[', message,
               '],"usage":{"prompt_tokens":', given, ',"completion_tokens":', made, ',"cached":9}}'),
        joined('{"choices":[{"message":{"content":[{"type":"text","text":', words,
               '},{"type":"image"},7,{"text":"; end"}]}}],', total, ',"error":null}'),
        joined('{"choices":[{"text":', words, '}]}'),
        joined('{"choices":[', message, '],"usage":{"total_tokens":"', given, '"}}'),
        joined('{', total, '}'),
        joined('{"choices":[],', total, '}'),
        joined('{"choices":', words, ',', total, '}'),
        joined('{"error":', words, '}'),
        joined('{"error":{"message":', words, ',"code":', given, '},"choices":[', message, ']}'),
        joined('{"choices":[', message),
        joined('{"choices":[{"message":{"content":null}}],"usage":{"total_tokens":true}}'),
        joined('{"choices":[3,"x",', message, '],"usage":[', given, ']}'),
    ]
    body = F.lit(None).cast("string")
    for i, text in enumerate(shapes):
        body = F.when(no % len(shapes) == i, text).otherwise(body)
    return read(spark, folder, "events").select(no.cast("string").alias("request_id"),
                                                body.alias("body"))


def state_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The state as JSON texts of up to 64 containers, whose shapes and entries differ."""
    key = F.col(SOURCE).cast("long")
    scanned = F.date_format("last_scan", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = F.when(key % 7 == 0, F.format_string(
        '"name":%s,"last_scan":"%s","log_cursor":"c%s"', _quoted(F.col("name")), scanned, key))
    fields = (fields.when(key % 7 == 1, F.format_string(
        '"name":%s,"labels":{"a":[1]},"last_scan":"%s"', _quoted(F.col("name")), scanned))
        .when(key % 7 == 2, F.format_string('"name":%s,"last_scan":%s', _quoted(F.col("name")), key))
        .when(key % 7 == 3, F.format_string('"name":{"n":1},"last_scan":"%s","log_cursor":7', scanned))
        .when(key % 7 == 4, F.lit('"last_scan":"yesterday"')))
    listed = F.floor(key / 64) % 4 == 2
    entry = (F.when(key % 7 == 5, F.when(listed, "null").otherwise(F.format_string('"%s":null', key)))
             .when(key % 7 == 6, F.when(listed, '{"name":"x"}').otherwise(
                 F.format_string('"%s":[1]', key)))
             .otherwise(F.when(listed, F.format_string('{"id":"%s",%s}', key, fields))
                        .otherwise(F.format_string('"%s":{%s}', key, fields))))
    kind = F.col("part") % 4
    whole = F.array_join("entries", ",")
    return (state(spark, folder).groupBy(F.floor(key / 64).alias("part"))
            .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
            .select(F.when(kind == 2, F.concat(F.lit('{"containers":['), whole, F.lit("]}")))
                    .when(kind == 3, F.concat(F.lit('{"containers":{'), whole))
                    .otherwise(F.concat(F.lit('{"version":1,"containers":{'), whole, F.lit("}}")))
                    .alias("value")))


def _answers(rows: DataFrame, content: Column, prompt: Column, completion: Column,
             empty: Column) -> DataFrame:
    choice = F.struct(
        F.lit(0).alias("index"),
        F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"))
    error = F.lit(None).cast("struct<message:string,type:string,code:string>")
    return rows.select(
        "request_id",
        F.filter(F.array(choice), lambda _: ~empty).alias("choices"),
        F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                 (prompt + completion).alias("total_tokens")).alias("usage"),
        error.alias("error"))
