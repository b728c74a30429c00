"""Record schemas, ordering keys and the constants shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A log row is placed by (container_id, segment, seq). ``segment`` is a contiguous slice of a
# container's log holding a bounded number of rows; ``seq`` is unique and ordered inside it.
# Order-sensitive operators work per (container_id, segment) and then join up the segment ends,
# so one container holding most of the rows is still spread over the cluster.
SOURCE = "container_id"
PLACE = ("segment", "seq")

# Rows (at most) per segment when ``segment`` is derived from an integer ``seq``.
SEGMENT_SPAN = 1 << 20

# What an uninitialised cursor reads as: everything is newer.
ZERO_TIME = "0001-01-01 00:00:00"

CONTAINERS = T.StructType([
    T.StructField("container_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])

LOGS = T.StructType([
    T.StructField("container_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("segment", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("stream", T.StringType()),
    T.StructField("message", T.StringType()),
])

STATE = T.StructType([
    T.StructField("container_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("last_scan", T.TimestampNTZType()),
    T.StructField("log_cursor", T.StringType()),
])

KB_HISTORY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("scan_ts_raw", T.StringType()),
    T.StructField("scan_ts", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("analysis", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()),
        T.StructField("message", MESSAGE),
        T.StructField("finish_reason", T.StringType()),
    ]))),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ])),
    T.StructField("error", T.StructType([
        T.StructField("message", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("code", T.StringType()),
    ])),
])


def place() -> Column:
    """The position of a row inside its container, as one orderable value."""
    return F.struct(*PLACE)


def with_segment(logs: DataFrame, span: int = SEGMENT_SPAN) -> DataFrame:
    """Add ``segment`` from an integer ``seq``: consecutive ranges of ``span`` values.

    ``seq`` is unique per container, so a segment holds at most ``span`` rows whatever the skew.
    """
    return logs.withColumn("segment", F.expr(f"seq div {int(span)}"))
