"""Log lines, history entries and reports as text columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats.
REPEAT_FORMAT = "[REPEAT x%d] %s"
TOKENS_PER_FILTERED_LINE = 20
KB_ENTRY = "\n### Scan: %s\n**Status:** %s\n\n%s\n\n---\n"
KB_HEADER = "# Knowledge Base: %s\n\n## Service History\n"
REPORT_HEAD = (
    "# Scan Report: %s\n\n"
    "**Date:** %s  \n"
    "**Container:** `%s`  \n"
    "**Log Entries:** %d  \n"
    "**Tokens Used:** %d\n\n"
    "## 🤖 AI Analysis\n\n"
    "%s\n\n"
)
REPORT_FILTERS = (
    "## 🔍 Pre-Processing Statistics\n\n"
    "| Metric | Value |\n"
    "|--------|-------|\n"
    "| Total Log Lines | %d |\n"
    "| Lines Filtered (Regexp) | %d |\n"
    "| Lines Kept | %d |\n"
    "| Filter Reduction | %s%% |\n"
    "| Est. Tokens Saved | ~%d |\n"
    "\n**Cost Impact:** By filtering log lines before LLM processing, "
    "approximately %d tokens were saved. "
    "This reduces API costs and improves processing speed.\n\n"
)
REPORT_COUNTS = (
    "## 📊 Statistics\n\n"
    "| Metric | Value |\n"
    "|--------|-------|\n"
    "| Original Logs | %d |\n"
    "| Processed Logs | %d |\n"
)
REPORT_DEDUPLICATION = "| Deduplication | %s%% |\n"
REPORT_COST = "| Tokens | %d |\n| Chunks | %d |\n"
INTERACTION = (
    "# LLM Interaction Log\n\n"
    "**Container**: %s\n"
    "**Timestamp**: %s\n\n"
    "## Original Input\n\n"
    "%s\n\n"
    "## Request Sent to LLM\n\n"
    "```json\n%s\n```\n\n"
    "## LLM Response\n\n"
    "```json\n%s\n```\n"
)
REPORT_DATE = "%a, %d %b %Y %H:%M:%S UTC"
REPORT_FILE = "%Y-%m-%d_%H-%M-%S.md"


def log_line(ts_raw: Column, message: Column) -> Column:
    """One line of prompt text; the brackets go when there is no timestamp."""
    return F.when(ts_raw == "", F.concat(message, F.lit("\n"))).otherwise(
        F.concat(F.lit("["), ts_raw, F.lit("] "), message, F.lit("\n")))


def log_line_bytes(ts_raw: Column, message: Column) -> Column:
    """The byte length of :func:`log_line`, without building it."""
    frame = F.when(ts_raw == "", 1).otherwise(F.octet_length(ts_raw) + 4)
    return (F.octet_length(message) + frame).cast("long")


def budget_line(ts_raw: Column, message: Column) -> Column:
    """The text a line is charged for: always bracketed, even without a timestamp."""
    return F.concat(F.lit("["), ts_raw, F.lit("] "), message, F.lit("\n"))


def budget_line_bytes(ts_raw: Column, message: Column) -> Column:
    return (F.octet_length(ts_raw) + F.octet_length(message) + 4).cast("long")


def repeat_marker(count: Column, message: Column) -> Column:
    return F.format_string(REPEAT_FORMAT, count, message)


def savings(original: Column, processed: Column) -> Column:
    """Percentage saved; 0 of nothing."""
    return F.when(original == 0, F.lit(0.0)).otherwise(
        (original - processed).cast("double") / original.cast("double") * F.lit(100.0))


def one_decimal(value: Column) -> Column:
    """``%.1f`` of a non-negative double, rounding its exact binary value half to even.

    (The JVM formatter rounds the shortest decimal form half up, which differs at x.x5.) ``rest`` is
    the exact distance of 20 * value from the nearest integer: both differences are of neighbours.
    """
    twentieths = F.rint(value * 20).cast("long")
    rest = (value * 16 - twentieths) + value * 4
    low = F.floor(twentieths / 2)
    up = (rest > 0) | ((rest == 0) & (low % 2 == 1))
    tenths = F.when(twentieths % 2 == 0, low).when(up, low + 1).otherwise(low)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def kb_entry(scan_ts_raw: Column, status: Column, analysis: Column) -> Column:
    return F.format_string(KB_ENTRY, scan_ts_raw, status, analysis)


def interaction_document() -> Column:
    """The document of an interaction row (see ``operators.inference.interactions``)."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return F.format_string(INTERACTION, "name", stamp, "original_input", "request_json",
                           "response_json")


def kb_document(name: Column, entries: Column) -> Column:
    """A service's history document: its header and an array of entries (:func:`kb_entry`)."""
    return F.concat(F.format_string(KB_HEADER, name), F.array_join(entries, ""))


def report(now: datetime) -> Column:
    """The scan report of a results row (see ``operators.inference.results``)."""
    c = F.col
    saved = c("lines_filtered") * TOKENS_PER_FILTERED_LINE
    head = F.format_string(REPORT_HEAD, c("name"), F.lit(now.strftime(REPORT_DATE)), c("name"),
                           c("original_count"), c("tokens_used"), c("analysis"))
    filters = F.format_string(
        REPORT_FILTERS, c("lines_total"), c("lines_filtered"), c("lines_kept"),
        one_decimal(savings(c("lines_total"), c("lines_kept"))), saved, saved)
    deduplication = F.format_string(
        REPORT_DEDUPLICATION, one_decimal(savings(c("original_count"), c("processed_count"))))
    return F.concat(
        head,
        F.when(c("lines_total") > 0, filters).otherwise(F.lit("")),
        F.format_string(REPORT_COUNTS, c("original_count"), c("processed_count")),
        F.when(c("deduplicated"), deduplication).otherwise(F.lit("")),
        F.format_string(REPORT_COST, c("tokens_used"), c("chunks_used")),
    )


def report_path(reports_dir: str, name: Column, now: datetime) -> Column:
    from .text import sanitize

    return F.concat(F.lit(f"{reports_dir.rstrip('/')}/"), sanitize(name),
                    F.lit("/" + now.strftime(REPORT_FILE)))
