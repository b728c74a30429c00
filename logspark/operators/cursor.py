"""Incremental reading from per-container cursors."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import SOURCE, ZERO_TIME
from .dedup import LAST

# Fixed value: how far back the first scan of a container reads.
FIRST_SCAN = timedelta(hours=1)


def _ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def since_time(logs: DataFrame, since: datetime, until: datetime | None = None) -> DataFrame:
    """Rows not older than ``since``; the comparison is pushed to the scan."""
    rows = logs.filter(F.col("ts") >= _ntz(since))
    return rows if until is None else rows.filter(F.col("ts") <= _ntz(until))


def lookback(logs: DataFrame, now: datetime, back: timedelta) -> DataFrame:
    return since_time(logs, now - back)


def placed(logs: DataFrame) -> Column:
    """The time that places each row: its own, or that of the last row before it that has one.

    The rows before it in its segment are looked at first, then the last times of earlier segments, of
    which there is one row each. Null where no row before it has a time.
    """
    here = W.partitionBy(SOURCE, "segment").orderBy("seq")
    return F.last("ts", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, W.currentRow))


def with_place(logs: DataFrame) -> DataFrame:
    """Add ``_at``, see :func:`placed`; rows of one container stay in their segments."""
    segments = logs.groupBy(SOURCE, "segment").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq")))
                                                   .alias("_last"))
    order = W.partitionBy(SOURCE).orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    carried = segments.select(SOURCE, "segment",
                              F.last("_last", ignorenulls=True).over(order).alias("_carried"))
    return (logs.withColumn("_at", placed(logs)).join(carried, [SOURCE, "segment"])
            .withColumn("_at", F.coalesce("_at", "_carried")).select(*logs.columns, "_at"))


def new_lines(logs: DataFrame, state: DataFrame, now: datetime, back: timedelta | None = None,
              until: datetime | None = None, strict: bool = False) -> DataFrame:
    """Rows since each container's start time: lookback, else its cursor, else an hour ago.

    A row without a time of its own, such as a line of a stack trace, stands where the row before it
    stands. The oldest start time of all is applied first, as a scalar that reaches the scan, so old
    files and row groups are skipped before the join; rows without a time pass it. The join itself
    is left to Catalyst: a broadcast if the measured state is small, else a sort-merge join whose
    skewed side AQE splits. Where no row at or after that oldest time stands before it, a row without
    a time is new only if its container has no cursor yet, or one of the zero time: behind a cursor
    it belongs to what was read before.

    Where every row has a time, which is looked up first, rows stay where they were read; only logs
    with other rows are shuffled to place those.
    """
    first = _ntz(now - FIRST_SCAN)
    if back:
        floor = _ntz(now - back)
    else:
        floor = state.agg(F.least(F.coalesce(F.min("last_scan"), first), first)).scalar()
    untimed = F.col("ts").isNull()
    rows = logs.filter(untimed | (F.col("ts") >= floor))
    rows = rows.withColumn("_at", F.col("ts")) if logs.filter(untimed).isEmpty() else with_place(rows)
    if until:
        rows = rows.filter(F.col("_at").isNull() | (F.col("_at") <= _ntz(until)))
    if back:
        return rows.filter(F.col("_at").isNotNull()).select(*logs.columns)
    cursors = state.select(SOURCE, F.col("last_scan").alias("_since"))
    start = F.coalesce("_since", first)
    wanted = (F.col("_at") > start) if strict else (F.col("_at") >= start)
    fresh = F.coalesce("_since", _zero()) == _zero()
    return (rows.join(cursors, SOURCE, "left")
            .filter(F.when(F.col("_at").isNull(), fresh).otherwise(wanted)).select(*logs.columns))


def _zero() -> Column:
    return F.lit(ZERO_TIME).cast("timestamp_ntz")


def _moved(last: DataFrame, empty_resets: bool) -> DataFrame:
    """Cursor rows from each container's last row (``name``, ``ts_raw``, ``ts``)."""
    zero = _zero() if empty_resets else F.lit(None)
    time = F.when(F.col("ts_raw") == "", zero).otherwise(F.col("ts"))
    return (last.select(SOURCE, "name", time.alias("last_scan"), F.lit("").alias("log_cursor"))
            .filter(F.col("last_scan").isNotNull()))


def last_times(logs: DataFrame, empty_resets: bool = True) -> DataFrame:
    """The time of each container's last row by position, which need not be its greatest time.

    A last row without a timestamp yields the zero time (``empty_resets=False`` leaves the container
    out); one that does not parse leaves the container out.
    """
    # Per segment first, so the last segment is found among one row per segment.
    segments = logs.groupBy(SOURCE, "segment").agg(*(
        F.max_by(c, "seq").alias(c) for c in ("name", "ts_raw", "ts")))
    return _moved(_last_segments(segments), empty_resets)


def _last_segments(segments: DataFrame) -> DataFrame:
    last = segments.groupBy(SOURCE).agg(
        F.max_by(F.struct("name", "ts_raw", "ts"), "segment").alias("l"))
    return last.select(SOURCE, "l.*")


def last_times_written(lines: DataFrame, empty_resets: bool = True) -> DataFrame:
    """:func:`last_times` of the rows that :func:`operators.dedup.collapse_and_write` was given.

    From the written lines alone, so cursors move exactly as far as what was analysed reaches, even if
    more rows have arrived since.
    """
    told = lines.filter(F.col(LAST).isNotNull())
    last = told.groupBy(SOURCE).agg(F.max_by(LAST, F.struct("segment", "seq")).alias("l"))
    return _moved(last.select(SOURCE, "l.*"), empty_resets)


def advance(state: DataFrame, moved: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State after a scan: containers in ``moved`` replaced or added, others unchanged.

    A failed analysis moves its cursor too, unless the ``failed`` containers are given.
    """
    if failed is not None:
        moved = moved.join(failed.select(SOURCE).distinct(), SOURCE, "left_anti")
    return upsert(state, moved)


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.join(rows, SOURCE, "left_anti").unionByName(rows.select(*state.columns))
