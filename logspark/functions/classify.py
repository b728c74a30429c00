"""Severity and sections of analysis texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# Keywords, labels and section markers.
ISSUE_WORDS = ("critical", "error")
WARNING_WORDS = ("warning",)
ALERT_WORDS = ("error", "failed", "exception", "critical", "warning", "issue", "problem", "alert",
               "urgent", "attention")
SERVICE_LABELS = ("🔴 Issues Detected", "🟡 Warnings", "🟢 Healthy")
DASHBOARD_LABELS = ("🔴 Issues", "🟡 Warning", "🟢 OK")
SUMMARY_MARK = "**Summary**"
ERRORS_MARK = "**Errors**"
WARNINGS_MARK = "**Warnings**"
ERRORS_FALLBACK = "Issues detected but could not parse specific errors."
SUMMARY_BYTES = 50


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found


def has_issues(analysis: Column) -> Column:
    return _mentions(analysis, ISSUE_WORDS)


def has_warnings(analysis: Column) -> Column:
    return _mentions(analysis, WARNING_WORDS)


def needs_alert(analysis: Column) -> Column:
    """The wide keyword net used to decide whether a notification mentions issues."""
    return _mentions(analysis, ALERT_WORDS)


def _label(analysis: Column, labels: tuple[str, str, str]) -> Column:
    return (F.when(has_issues(analysis), labels[0])
            .when(has_warnings(analysis), labels[1]).otherwise(labels[2]))


def service_status(analysis: Column) -> Column:
    return _label(analysis, SERVICE_LABELS)


def dashboard_status(analysis: Column) -> Column:
    return _label(analysis, DASHBOARD_LABELS)


def truncate(text: Column, max_bytes: int) -> Column:
    """The first ``max_bytes`` bytes and an ellipsis; a character cut in half is left out."""
    raw = text.cast("binary")

    def inside(at: int) -> Column:
        """Whether the byte at ``at`` (from 1) is not the first of its character."""
        return F.hex(F.substring(raw, at, 1)).between("80", "BF") if at > 0 else F.lit(False)

    kept = F.lit(max(0, max_bytes - 3))
    for back in (2, 1, 0):
        kept = F.when(~inside(max_bytes + 1 - back), F.lit(max(0, max_bytes - back))).otherwise(kept)
    cut = F.substr(raw, F.lit(1), kept).cast("string")
    return F.when(F.octet_length(text) > max_bytes, F.concat(cut, F.lit("..."))).otherwise(text)


def extract_summary(analysis: Column) -> Column:
    """The first line carrying the summary mark, else the shortened first line."""
    lines = F.split(analysis, "\n")
    marked = F.get(F.filter(lines, lambda line: line.contains(SUMMARY_MARK)), F.lit(0))
    label = SUMMARY_MARK + ":"
    at = F.instr(marked, label)
    without = F.when(at > 0, F.concat(F.substr(marked, F.lit(1), at - 1),
                                      F.substr(marked, at + len(label)))).otherwise(marked)
    return F.when(marked.isNotNull(), trim_space(without)).otherwise(
        truncate(F.get(lines, F.lit(0)), SUMMARY_BYTES))


def extract_errors(analysis: Column) -> Column:
    """From the errors mark up to the warnings mark behind it, or to the end."""
    at = F.instr(analysis, ERRORS_MARK)
    section = F.substring_index(F.substr(analysis, at), WARNINGS_MARK, 1)
    return F.when(at > 0, trim_space(section)).otherwise(F.lit(ERRORS_FALLBACK))
