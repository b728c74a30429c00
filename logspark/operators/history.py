"""Per-service history with a retention period."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import SERVICE_LABELS, service_status
from ..functions.parse import rfc3339
from ..functions.render import kb_document, kb_entry
from ..functions.text import sanitize, trim_space
from ..model import KB_HISTORY
from ..sources.store import Snapshot, Transaction, rewrite_parts

# Marks of the Markdown history and the allowed retention range in days.
HISTORY_HEADER = "## Service History\n"
ENTRY_END = "---\n"
SCAN_MARK = "### Scan:"
STATUS_MARK = "**Status:**"
RETENTION_DAYS = (1, 365)


def prune(history: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """Drop entries strictly older than the retention period; entries without a time are kept."""
    return history.filter(_in_retention(now, retention_days))


def _in_retention(now: datetime, days: int) -> Column:
    low, high = RETENTION_DAYS
    if not low <= days <= high:
        raise ValueError(f"retention days must be between {low} and {high}, got {days}")
    cutoff = F.lit((now - timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.col("scan_ts").isNull() | (F.col("scan_ts") >= cutoff)


def entries(results: DataFrame, now: datetime) -> DataFrame:
    """Results as history entries of a scan at ``now`` (UTC, to the second)."""
    stamp = now.replace(microsecond=0)
    return results.select(
        "name", F.lit(stamp.isoformat() + "Z").alias("scan_ts_raw"),
        F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz").alias("scan_ts"),
        service_status(F.col("analysis")).alias("status"), "analysis")


def append(history: DataFrame, results: DataFrame, now: datetime,
           retention_days: int) -> DataFrame:
    """History after a scan: old entries of the scanned services pruned, then the new ones added.

    A service without a new result keeps its entries untouched, as nothing rewrites them.
    """
    new = entries(results, now)
    scanned = new.select("name", F.lit(True).alias("_scanned")).distinct()
    kept = (history.join(scanned, "name", "left")
            .filter(F.col("_scanned").isNull() | _in_retention(now, retention_days)))
    return kept.select(*history.columns).unionByName(new.select(*history.columns))


# A store's history table has a part for each day of its entries, and one for those without a time.
TABLE, NO_DAY = "history", "unknown"


def import_by_day(change: Transaction, history: DataFrame) -> None:
    """Add an existing history to the store, day by day."""
    day = F.coalesce(F.date_format("scan_ts", "yyyy-MM-dd"), F.lit(NO_DAY))
    change.add_by(TABLE, history.withColumn("_day", day).select(*KB_HISTORY.names, "_day"), "_day")


def append_by_day(change: Transaction, results: DataFrame, now: datetime,
                  retention_days: int) -> list[str]:
    """:func:`append` on the store's history: gives the days that were rewritten.

    New entries are one more folder of their day. Only days that have run out are looked at again, and
    only those written that lose entries: a scanned service's old ones. A day that loses all goes.
    """
    new = entries(results, now).select(*KB_HISTORY.names)
    keep = _in_retention(now, retention_days)
    scanned = new.select("name", F.lit(True).alias("_scanned")).distinct()
    last = (now - timedelta(days=retention_days)).date().isoformat()
    days = sorted({e.part for e in change.current(TABLE) if e.part != NO_DAY and e.part <= last})
    gone = rewrite_parts(change, TABLE, KB_HISTORY, days, lambda old: old.join(
        scanned, "name", "left").filter(F.col("_scanned").isNull() | keep).select(*KB_HISTORY.names))
    change.add(TABLE, new, now.date().isoformat())
    return gone


def read_by_day(source: Snapshot, spark: SparkSession, since: datetime | None = None) -> DataFrame:
    """The store's history; with ``since``, from that day on, and the entries without a time."""
    days = source.parts(TABLE)
    if since is not None:
        days = [d for d in days if d == NO_DAY or d >= since.date().isoformat()]
        if not days:
            return spark.createDataFrame([], KB_HISTORY)
    return source.read(spark, TABLE, KB_HISTORY, *days)


def intervals(history: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """How long each service has been in each status, one row for every time it entered one.

    ``since`` is the first time with that status and ``until`` the time of the next one, null for the
    status of now, whose ``seconds`` run to ``now``; ``previous_status`` is null for the first. Entries
    within the retention period count. Of several at one time the worst status does; entries without a
    time, or after ``now``, do not. Times are aggregated before a service's own are put in order.
    """
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    severity = F.coalesce(*(F.when(F.col("status") == label, i)
                            for i, label in enumerate(SERVICE_LABELS)), F.lit(len(SERVICE_LABELS)))
    times = (history.filter(F.col("scan_ts").isNotNull() & (F.col("scan_ts") <= moment)
                            & _in_retention(now, retention_days))
             .groupBy("name", "scan_ts").agg(F.min(F.struct(severity.alias("s"), "status")).alias("w"),
                                             F.count(F.lit(1)).alias("n")))
    in_time = W.partitionBy("name").orderBy("scan_ts")
    status = F.col("w.status")
    starts = (~F.lag(status).over(in_time).eqNullSafe(status)
              | F.lag("scan_ts").over(in_time).isNull())
    numbered = times.select("name", "scan_ts", "n", status.alias("status"), starts.alias("_starts"))
    numbered = numbered.withColumn("_run", F.sum(F.col("_starts").cast("int")).over(
        in_time.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = numbered.groupBy("name", "_run").agg(
        F.first("status").alias("status"), F.min("scan_ts").alias("since"), F.sum("n").alias("entries"))
    ordered = W.partitionBy("name").orderBy("_run")
    until = F.lead("since").over(ordered)
    return runs.select(
        "name", "status", F.lag("status").over(ordered).alias("previous_status"), "since",
        until.alias("until"), "entries",
        F.timestamp_diff("SECOND", F.col("since"), F.coalesce(until, moment)).alias("seconds"))


# Statuses from bad to good, and what a change of their mean is called.
WORSE, BETTER, SAME, NEW = "worse", "better", "same", "new"


def trend(history: DataFrame, now: datetime, recent: timedelta) -> DataFrame:
    """Per service: entries and issues in the ``recent`` time and before it, and which way it goes.

    Shares of entries with issues are compared, without rounding; a service without earlier entries
    is new, one without recent ones the same. Entries without a time do not count.
    """
    since = F.lit((now - recent).isoformat(sep=" ")).cast("timestamp_ntz")
    late = F.col("scan_ts") >= since
    issue = F.col("status") == SERVICE_LABELS[0]
    counts = history.filter(F.col("scan_ts").isNotNull()).groupBy("name").agg(
        F.count_if(late).alias("recent"), F.count_if(late & issue).alias("recent_issues"),
        F.count_if(~late).alias("earlier"), F.count_if(~late & issue).alias("earlier_issues"))
    now_share = F.col("recent_issues") * F.col("earlier")
    before = F.col("earlier_issues") * F.col("recent")
    return counts.withColumn(
        "trend", F.when(F.col("earlier") == 0, NEW).when(now_share > before, WORSE)
        .when(now_share < before, BETTER).otherwise(SAME))


def documents(history: DataFrame) -> DataFrame:
    """One document per service with its entries in the order of their times, the unknown first.

    A service's history is bounded by its retention period, so a document is one text.
    """
    entry = kb_entry(F.col("scan_ts_raw"), F.col("status"), F.col("analysis"))
    rows = F.struct("scan_ts", "scan_ts_raw", entry.alias("entry"))
    listed = F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["entry"])
    return history.groupBy("name").agg(listed.alias("_entries")).select(
        "name", sanitize(F.col("name")).alias("storage_name"),
        kb_document(F.col("name"), F.col("_entries")).alias("content"))


def parse_markdown(files: DataFrame) -> DataFrame:
    """``files(name, content)`` of Markdown histories to entries; blank entries vanish.

    Entries end at ``---`` lines, so an analysis that holds one is cut there as well. A file without
    the history heading has no entries.
    """
    c = F.col
    at = F.instr(c("content"), HISTORY_HEADER)
    body = F.substr(c("content"), at + len(HISTORY_HEADER))
    entry = files.filter(at > 0).select("name", F.posexplode(F.split(body, ENTRY_END))
                                        .alias("entry_no", "entry"))
    lines = F.split(c("entry"), "\n")
    marked = F.get(F.filter(F.transform(lines, trim_space), lambda x: x.startswith(SCAN_MARK)),
                   F.lit(0))
    raw = F.coalesce(trim_space(F.substr(marked, F.lit(len(SCAN_MARK) + 1))), F.lit(""))
    status = F.get(F.filter(lines, lambda x: x.startswith(STATUS_MARK)), F.lit(0))
    analysis = F.substr(c("entry"), F.instr(c("entry"), "\n\n") + 2)
    return (entry.filter(trim_space(c("entry")) != "")
            .select("name", "entry_no", raw.alias("scan_ts_raw"), rfc3339(raw).alias("scan_ts"),
                    trim_space(F.substr(status, F.lit(len(STATUS_MARK) + 1))).alias("status"),
                    F.when(F.instr(c("entry"), "\n\n") > 0, trim_space(analysis))
                    .otherwise(F.lit("")).alias("analysis")))
