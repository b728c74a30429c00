"""Summaries over all containers of a scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import prompts as P
from ..functions.render import REPORT_DATE, TOKENS_PER_FILTERED_LINE, savings
from ..functions.tokens import TokenCounter
from ..model import SOURCE
from ..session import materialize
from . import inference
from .budget import RESPONSE_RESERVE

# Texts of the dashboard and the alert.
DASHBOARD_HEAD = "# 🌍 Global System Summary\n\n**Last Updated:** %s\n\n"
ALL_HEALTHY = "🟢 All Systems Operational"
UNHEALTHY = "⚠️ %d Service(s) Reporting Issues"
HEALTH = "## System Health: %s\n\n"
TABLE_HEAD = (
    "## Service Status\n\n"
    "| Service | Status | Last Analysis |\n"
    "|---------|--------|---------------|\n"
)
TABLE_ROW = "| %s | %s | %s |\n"
CRITICAL_HEAD = "\n## Recent Critical Issues\n\n"
CRITICAL_ROW = "### %s\n%s\n"
NO_CRITICAL = "*No critical issues reported in the last scan.*"
ALERT_TIME = "📅 Time: %s\n"
ALERT_COUNT = "📦 Containers: %d\n"
ALERT_ISSUES = "⚠️  Issues detected\n"
ALERT_CLEAN = "✅ No critical issues\n"


def scan_totals(logs: DataFrame) -> DataFrame:
    """Containers that had lines and the number of lines; analysis failures do not matter."""
    per_container = logs.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"))
    return per_container.agg(F.count(F.lit(1)).alias("scanned_containers"),
                             F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"))


def pass_totals(budgets: DataFrame) -> DataFrame:
    """The counts of a scan's pass over its lines, from one row a container and no further pass.

    ``scanned_containers`` and ``total_logs`` are those of :func:`scan_totals`; the counts of excluded
    and kept lines, and the savings, are those of all containers together.
    """
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    sums = budgets.agg(
        F.count(F.lit(1)).alias("scanned_containers"),
        total("original_count").alias("total_logs"),
        total("lines_total"), total("lines_filtered"), total("lines_kept"))
    return sums.withColumns({
        "filter_reduction": savings(F.col("lines_total"), F.col("lines_kept")),
        "tokens_saved": F.col("lines_filtered") * TOKENS_PER_FILTERED_LINE})


def service_status(analyses: DataFrame) -> DataFrame:
    """Status, summary and errors of each service; the dashboard sorts them."""
    text = F.col("analysis")
    return analyses.select(
        "name", C.has_issues(text).alias("has_issues"),
        C.dashboard_status(text).alias("status"), C.extract_summary(text).alias("summary"),
        F.when(C.has_issues(text), C.extract_errors(text)).alias("errors"))


# In place of a summary of all services.
NO_SUMMARY = "(no summary available) %d services analysed, %d with issues"


def health(analyses: DataFrame) -> DataFrame:
    """One row: services, services with issues, headline, and whether to raise an alert."""
    text = F.col("analysis")
    issues = F.count_if(C.has_issues(text))
    return analyses.agg(
        F.count(F.lit(1)).alias("services"), issues.alias("services_with_issues"),
        F.when(issues > 0, F.format_string(UNHEALTHY, issues)).otherwise(F.lit(ALL_HEALTHY))
        .alias("health"),
        F.coalesce(F.bool_or(C.needs_alert(text)), F.lit(False)).alias("issues_found"))


def dashboard(analyses: DataFrame, now: datetime) -> DataFrame:
    """The dashboard document as ordered pieces (section, name, piece).

    Read in (section, name) order, the pieces are the document. It has a part per service, so it is
    left as rows: sorted by range and written as files in order, no task holds all of it.
    """
    stats = health(analyses)
    services = service_status(analyses)
    none = F.lit("")
    head = F.concat(F.lit(DASHBOARD_HEAD % now.strftime(REPORT_DATE)),
                    F.format_string(HEALTH, F.col("health")), F.lit(TABLE_HEAD))
    closing = F.concat(F.lit(CRITICAL_HEAD),
                       F.when(F.col("services_with_issues") == 0, NO_CRITICAL).otherwise(none))
    pieces = [
        stats.select(F.lit(0).alias("section"), none.alias("name"), head.alias("piece")),
        services.select(F.lit(1), "name",
                        F.format_string(TABLE_ROW, "name", "status", "summary")),
        stats.select(F.lit(2), none, closing),
        services.filter("has_issues").select(
            F.lit(3), "name", F.format_string(CRITICAL_ROW, "name", "errors")),
    ]
    document = pieces[0]
    for piece in pieces[1:]:
        document = document.union(piece)
    return document.orderBy("section", "name")


NO_LIMIT = 1 << 62  # tokens, more than any texts have


def executive_limit(spark: SparkSession, counter: TokenCounter, max_tokens: int,
                    prompts: P.Prompts = P.Prompts()) -> int:
    """Tokens left for analyses in an executive request: without reply, system prompt and template."""
    system = P.system_prompt(prompts, F.lit(""))
    template = P.executive_prompt(prompts, F.lit(0), F.lit(""))
    fixed = spark.range(1).select(counter.of_message(system) + counter.of_text(template)).first()[0]
    return max(1, max_tokens - RESPONSE_RESERVE - fixed)


def executive_requests(analyses: DataFrame, scan_id: str, counter: TokenCounter, limit: int | None,
                       prompts: P.Prompts = P.Prompts(), level: int = 0) -> DataFrame:
    """The executive summary request over all analyses, in name order.

    One request while the analyses fit into ``limit`` tokens; beyond that they are packed in order
    into several, numbered by ``chunk_index`` of ``chunk_total``, so no request text is unbounded.
    Without a limit there is one request however many analyses there are, for models that take it.
    Their replies are the analyses of the next ``level`` (:func:`plans.scan.executive`).
    """
    c = F.col
    part = P.analysis_part(c("name"), c("analysis"))
    ranked = _numbered(analyses.select("name", part.alias("line"),
                                       counter.of_text(part).alias("tokens")))
    lines = ranked.select(
        F.lit("").alias(SOURCE), F.lit("").alias("name"), "segment", "seq", "line", "tokens",
        F.lit(NO_LIMIT if limit is None else limit).cast("long").alias("chunk_limit"))
    packs = inference._pack(lines)
    user = P.executive_prompt(prompts, c("n_logs"), c("text"))
    kind = inference.EXECUTIVE if level == 0 else f"{inference.EXECUTIVE}{level}"
    return packs.select(*inference._request(
        scan_id, F.lit(kind), c("chunk_index"), c("chunk_total"),
        P.system_prompt(prompts, F.lit("")), user, F.lit(inference.ANALYSIS_REPLY_TOKENS)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows placed in name order over as many segments as the range sort makes partitions.

    Partition and row numbers hold for one run only, so the numbered rows are written down.
    """
    ranged = rows.repartitionByRange("name").sortWithinPartitions("name")
    return materialize(ranged.withColumns({
        "segment": F.spark_partition_id().cast("long"),
        "seq": F.monotonically_increasing_id()}), "analyses")


def without_reply(stats: DataFrame) -> DataFrame:
    """What stands for a summary that the model did not give, from :func:`health`."""
    return stats.select(F.format_string(NO_SUMMARY, "services", "services_with_issues").alias("summary"))


def alert(summary: DataFrame, stats: DataFrame, now: datetime, title: str) -> DataFrame:
    """The notification row: ``summary(summary)`` and ``stats`` (:func:`health`) hold one row each."""
    issues = F.when(F.col("issues_found"), ALERT_ISSUES).otherwise(F.lit(ALERT_CLEAN))
    return stats.withColumn("summary", summary.select("summary").scalar()).select(
        F.concat(F.lit(title + "\n"), F.lit(ALERT_TIME % now.strftime("%Y-%m-%d %H:%M:%S")),
                 F.format_string(ALERT_COUNT, F.col("services")), issues, F.lit("\n"),
                 F.col("summary")).alias("message"),
        "issues_found", F.col("services").alias("containers"))
