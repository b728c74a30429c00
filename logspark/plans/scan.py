"""A whole scan, from logs to results, out of the operators.

A scan has rounds, as the model is asked outside. :func:`prepare` reads the new lines and writes the
first requests; :func:`next_requests` gives the requests of the next round until there are none;
:func:`finish` writes results and moves the cursors; :func:`executive` asks for the summary of all
results, round by round as well, and :func:`alert` turns its reply into the notification.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import Prompts
from ..functions.tokens import TokenCounter, byte_tokens
from ..model import SOURCE, STATE
from ..operators import budget as B
from ..operators import chunking, cursor, dedup, exclude, history, inference, summary
from ..operators.exclude import LineFilter
from ..session import materialize
from ..sources.store import Store, upsert_keyed
from ..sources.tables import (VersionedTable, interaction_rows, report_rows, write_dashboard,
                              write_interactions, write_reports)


@dataclass(frozen=True)
class ScanOptions:
    """``scan_id`` tells a scan's requests and outputs from those of all others.

    ``one_executive``: the executive request is one over all containers, however many tokens it has.
    """

    now: datetime
    scan_id: str
    lookback: timedelta | None = None
    max_tokens: int = B.MAX_TOKENS
    filters: Mapping[str, LineFilter] = field(default_factory=dict)
    counter: TokenCounter = field(default_factory=byte_tokens)
    prompts: Prompts = Prompts()
    retention_days: int = 30
    dry_run: bool = False
    advance_on_failure: bool = True
    one_executive: bool = False


@dataclass(frozen=True)
class Prepared:
    """Priced lines, budgets and first requests, all written down, and where cursors go."""

    lines: DataFrame
    budgets: DataFrame
    requests: DataFrame
    moved: DataFrame


def written_lines(logs: DataFrame, filters: Mapping[str, LineFilter],
                  counter: TokenCounter) -> DataFrame:
    """Lines collapsed, flagged and priced, as a written table."""
    def finish(rows: DataFrame) -> DataFrame:
        return B.priced_lines(exclude.flag_excluded(rows, filters), counter,
                              ("_edge", "_raw", dedup.LAST))

    return dedup.collapse_and_write(logs, finish)


def prepare(logs: DataFrame, state: DataFrame, options: ScanOptions,
            ignore: DataFrame | None = None) -> Prepared:
    """Read the new lines, collapse repeats, exclude, budget, pack and build the first requests.

    The order is fixed: the repeat marker changes what the patterns see. The priced lines are
    written once, because the budget, the packing and the texts each read other columns of them, and
    because the cursors move by them: rows that arrive later wait for the next scan.
    """
    new = cursor.new_lines(logs, state, options.now, options.lookback)
    lines = written_lines(new, options.filters, options.counter)
    stats = B.with_instructions(B.container_stats(lines), ignore)
    budgets = materialize(B.budget(stats, options.counter, options.max_tokens, options.prompts),
                          "budgets")
    chunks = chunking.chunk_texts(chunking.assign_chunks(B.lines_to_pack(lines, budgets)))
    requests = inference.first_requests(budgets, chunks, options.scan_id, options.counter,
                                        options.prompts)
    return Prepared(lines, budgets, materialize(requests, "requests"),
                    cursor.last_times_written(lines))


def next_requests(prepared: Prepared, last: DataFrame, responses: DataFrame, options: ScanOptions,
                  level: int) -> DataFrame:
    """The requests that combine what the round ``last`` has answered; none when all is reduced.

    Level 0 combines the summaries of chunks, every further one the replies to packed requests of the
    level before.
    """
    if level == 0:
        summaries = inference.chunk_summaries(last, responses)
    else:
        summaries = inference.next_level(last, responses)
    limit = inference.summary_limit(options.counter, options.max_tokens, options.prompts)
    return inference.synthesis_requests(summaries, prepared.budgets, options.scan_id,
                                        options.counter, limit, options.prompts, level)


def reduce_all(prepared: Prepared, answer, options: ScanOptions) -> tuple[DataFrame, DataFrame]:
    """All requests and responses of a scan: ``answer`` turns a round's requests into responses.

    Every round has fewer requests for each container that is not done, so the rounds end.
    """
    requests = last = prepared.requests
    responses = replies = materialize(answer(last), "responses")
    level = 0
    while True:
        if inference.is_reduced(last, level):
            return requests, responses
        last = materialize(next_requests(prepared, last, replies, options, level), "requests")
        if last.isEmpty():
            return requests, responses
        replies = materialize(answer(last), "responses")
        requests, responses = requests.unionByName(last), responses.unionByName(replies)
        level += 1


@dataclass(frozen=True)
class Stores:
    """Where a scan keeps its results."""

    state: VersionedTable
    history: VersionedTable
    reports: str
    dashboard: str
    interactions: str | None = None


def executive(results: DataFrame, answer, options: ScanOptions) -> DataFrame:
    """The reply to the summary request over all containers, as ``summary`` of one row at most.

    Analyses too long for one request are summed up in several, whose replies are summed up again.
    Where the replies no longer get fewer, the counts of statuses take the place of a summary, marked
    as such, so that no scan goes without an alert.
    """
    parts = inference.latest_per_name(results, F.col(SOURCE)).select("name", "analysis")
    limit = None if options.one_executive else summary.executive_limit(
        results.sparkSession, options.counter, options.max_tokens, options.prompts)
    level, before = 0, None
    while True:
        requests = materialize(summary.executive_requests(
            parts, options.scan_id, options.counter, limit, options.prompts, level), "requests")
        replies = inference.unwrap(requests, materialize(answer(requests), "responses"))
        count = requests.count()
        if count <= 1:
            last = replies.filter((F.col("chunk_total") == 1) & F.col("failure").isNull())
            return last.select(F.col("content").alias("summary"))
        if before is not None and count >= before:
            named = inference.latest_per_name(results, F.col(SOURCE))
            return summary.without_reply(summary.health(named))
        parts = replies.select(F.format_string("part %09d", F.col("chunk_index") + 1).alias("name"),
                               F.coalesce("content", F.lit("")).alias("analysis"))
        level, before = level + 1, count


def alert(results: DataFrame, reply: DataFrame, options: ScanOptions, title: str) -> DataFrame:
    """The notification of a scan; no row without an executive summary."""
    named = inference.latest_per_name(results, F.col(SOURCE))
    return (summary.alert(reply, summary.health(named), options.now, title)
            .filter(F.col("message").isNotNull()))


def finish_together(prepared: Prepared, requests: DataFrame, responses: DataFrame,
                    options: ScanOptions, store: Store) -> DataFrame:
    """:func:`finish` with all outputs in one store, where they appear together or not at all.

    The history has a part for each day, of which only new ones and those that run out are written;
    reports and interactions have one for each scan; the state grows by the cursors that moved. A scan
    that is finished again starts from what it started from before, and replaces what it wrote.
    """
    results = inference.results(prepared.budgets, requests, responses, options.counter)
    if options.dry_run:
        return results
    spark = results.sparkSession
    results = materialize(results, "results")
    change = store.begin(spark, options.scan_id)
    history.append_by_day(change, results, options.now, options.retention_days)
    part = f"{options.now.date().isoformat()} {options.scan_id}"
    change.replace("reports", report_rows(results, options.now), part)
    if not results.isEmpty():
        named = inference.latest_per_name(results, F.col(SOURCE))
        change.replace("dashboard", summary.dashboard(named, options.now))
    change.replace("interactions", interaction_rows(
        inference.interactions(requests, responses, options.now)), part)
    if options.lookback is None:
        moved = prepared.moved
        if not options.advance_on_failure:
            failed = inference.failed_containers(requests, responses)
            moved = moved.join(failed.select(SOURCE).distinct(), SOURCE, "left_anti")
        upsert_keyed(change, "state", SOURCE, STATE, moved)
    change.commit()
    return results


def finish(prepared: Prepared, requests: DataFrame, responses: DataFrame, options: ScanOptions,
           stores: Stores) -> DataFrame:
    """Results of all rounds; writes reports, history, dashboard, interaction log and cursors.

    A dry run writes nothing, and a scan with a lookback leaves the cursors alone. A scan that is
    finished again replaces its reports and interactions and repeats its version of the tables.
    """
    results = inference.results(prepared.budgets, requests, responses, options.counter)
    if options.dry_run:
        return results
    spark = results.sparkSession
    results = materialize(results, "results")
    write_reports(results, stores.reports, options.now, options.scan_id)
    before = stores.history.read(spark, redo=options.scan_id)
    stores.history.write(history.append(before, results, options.now, options.retention_days),
                         options.scan_id)
    if not results.isEmpty():
        named = inference.latest_per_name(results, F.col(SOURCE))
        write_dashboard(summary.dashboard(named, options.now), stores.dashboard)
    if stores.interactions:
        write_interactions(inference.interactions(requests, responses, options.now),
                           stores.interactions, options.now, options.scan_id)
    if options.lookback is None:
        failed = None if options.advance_on_failure else inference.failed_containers(
            requests, responses)
        state = stores.state.read(spark, redo=options.scan_id)
        stores.state.write(cursor.advance(state, prepared.moved, failed), options.scan_id)
    return results
