"""Run-length collapse of repeated messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.render import repeat_marker
from ..model import PLACE, SOURCE
from ..session import materialize

# Fixed value: the shortest run that is collapsed.
REPEAT_THRESHOLD = 3
LAST = "_segment_last"
# Segments (by their numbers) whose ends one task joins up.
BLOCK_SEGMENTS = 1024


def collapse_repeats(logs: DataFrame, threshold: int = REPEAT_THRESHOLD) -> DataFrame:
    """Replace each run of at least ``threshold`` equal consecutive messages by its first row.

    The kept row carries the ``[REPEAT xN]`` message and ``run_len`` = N; rows of shorter runs stay
    as they are with ``run_len`` = 1, so ``sum(run_len)`` is the input row count. Only ``message``
    is compared.

    Runs are found per (container, segment) with one shuffle and one sort. What a segment tells the
    others is small: its first and last run, in at most ``2 * threshold`` rows. These are joined up in
    blocks of :data:`BLOCK_SEGMENTS` segments, what a block tells the others is of the same kind, and
    those are joined up per container. Both branches read the same exchange, and no task ever sorts a
    whole container or the ends of all its segments.
    """
    columns = logs.columns
    runs = _segment_runs(logs, threshold)
    inner = runs.filter(~F.col("_head") & ~F.col("_tail"))
    ends = _join_ends(runs.filter(F.col("_head") | F.col("_tail")), threshold)
    return _collapsed(inner, columns, threshold).unionByName(_collapsed(ends, columns, threshold))


def collapse_and_write(logs: DataFrame, finish: Callable[[DataFrame], DataFrame],
                       threshold: int = REPEAT_THRESHOLD) -> DataFrame:
    """:func:`collapse_repeats` and a row-wise ``finish``, written down for several later reads.

    The input is shuffled, sorted and read once, and rows are written in the order of that sort. Rows
    of runs inside a segment are final when they are written; the few of runs that touch a segment's
    end carry in ``_raw`` what they were and are joined up from there, into a table of their own.
    ``finish`` passes ``_edge``, ``_raw`` and :data:`LAST` on. ``LAST`` is on the rows of the run that
    ends a segment: the name and times of that segment's last row, or of the last segment's that the run
    goes on to. So the last row of a container has it for the container.
    """
    runs = _segment_runs(logs, threshold, F.struct("name", "ts_raw", "ts"))
    raw = [*logs.columns, "_pos", "_n", "_head", "_tail"]
    edge = F.col("_head") | F.col("_tail")
    marked = runs.withColumns({"_edge": edge, "_raw": F.when(edge, F.struct(*raw, LAST))})
    rows = materialize(
        finish(_collapsed(marked, [*logs.columns, "_edge", "_raw", LAST], threshold)), "lines")
    ends = _join_ends(rows.filter("_edge").select("_raw.*"), threshold)
    none = {"_edge": F.lit(True), "_raw": F.lit(None)}
    joined = finish(_collapsed(ends, [*logs.columns, LAST], threshold).withColumns(none))
    final = [c for c in rows.columns if c not in none]
    return rows.filter(~F.col("_edge")).select(*final).unionByName(
        materialize(joined.select(*final), "ends"))


def _segment_runs(logs: DataFrame, threshold: int, of_last: Column | None = None) -> DataFrame:
    """The first ``threshold - 1`` rows of each run inside a segment, with the run's length.

    ``_pos`` is the row's offset in its run, ``_n`` the run length, ``_head`` / ``_tail`` tell
    whether the run touches the segment's start / end. Both windows share one ordering: the first
    leaves each run its first rows and its last one, the second looks up that last one. ``of_last`` is
    what :data:`LAST` tells of a segment's last row, on the rows of its last run.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    here = W.partitionBy(SOURCE, "segment").orderBy("seq")
    message = F.col("message")

    def breaks(step: int) -> Column:
        """Whether the row ``step`` places away (before or behind) is none or differs."""
        return (~F.lag("message", step).over(here).eqNullSafe(message)
                | F.lag("seq", step).over(here).isNull())

    offset = F.when(breaks(1), 0)
    for step in range(2, threshold):
        offset = offset.when(breaks(step), step - 1)
    last = F.lead("seq").over(here).isNull()
    first_rows = logs.withColumns({
        "_row": F.row_number().over(here), "_pos": offset, "_ends": breaks(-1), "_last": last,
    }).filter(F.col("_pos").isNotNull() | F.col("_ends"))
    # The number of the run's last row, negative if that row is the segment's last as well.
    number = F.when(F.col("_last"), -F.col("_row")).otherwise(F.col("_row"))
    end = F.when(F.col("_ends"), number)
    nearest = F.coalesce(end, *[F.lead(end, i).over(here) for i in range(1, threshold)])
    start = F.col("_row") - F.col("_pos")
    first_rows = first_rows.withColumn("_end", nearest)
    if of_last is not None:
        told = F.when(F.col("_last"), of_last)
        told = F.coalesce(told, *[F.lead(told, i).over(here) for i in range(1, threshold)])
        first_rows = first_rows.withColumn(LAST, F.when(F.col("_end") < 0, told))
    return (first_rows
            .filter(F.col("_pos").isNotNull())
            .withColumns({"_n": (F.abs("_end") - start + 1).cast("long"),
                          "_tail": F.col("_end") < 0, "_head": start == 1}))


def _join_ends(ends: DataFrame, threshold: int) -> DataFrame:
    """Join runs across segment ends, in blocks of segments first and then across the blocks' ends.

    Of a run that a block tells the others, the first ``threshold - 1`` rows are enough. Segments that
    are not numbered, as those named by file and offset, are one block a container.
    """
    if not isinstance(ends.schema["segment"].dataType, T.IntegralType):
        return _joined(ends, [SOURCE], "segment")
    block = F.expr(f"segment div {BLOCK_SEGMENTS}")
    inside = _joined(ends.withColumn("_block", block), [SOURCE, "_block"], "segment")
    # One plan for both kinds of rows: those that are told meet under no block, the others are passed
    # through within theirs, so nothing before is computed twice.
    edge = F.col("_head") | F.col("_tail")
    told = (inside.filter(~edge | (F.col("_pos") < threshold - 1))
            .withColumns({"_edge_run": edge, "_meet": F.when(~edge, F.col("_block"))}))
    return (_joined(told, [SOURCE, "_meet"], "_block", F.col("_edge_run"))
            .drop("_edge_run", "_meet", "_block"))


def _joined(ends: DataFrame, whole: list[str], part: str, only: Column | None = None) -> DataFrame:
    """Join the runs of parts of a whole: lengths add up, later pieces become positions of the first.

    ``_head`` and ``_tail`` then tell whether a run touches the whole's start or end; a whole has the
    first and the last run of each of its parts, so these are its first and its last one. Rows that
    are not among ``only``, in wholes of their own, keep what they have.
    """
    order = W.partitionBy(*whole).orderBy(*PLACE)
    same_part = F.lag(part).over(order).eqNullSafe(F.col(part))
    starts = F.when(same_part, F.col("_pos") == 0).otherwise(
        ~F.lag("message").over(order).eqNullSafe(F.col("message"))
        | F.lag("seq").over(order).isNull())
    # Runs are numbered and counted in one sort of the whole, and summed up in one of its runs.
    count = F.sum(F.col("_starts").cast("int"))
    numbered = ends.withColumn("_starts", starts).withColumns({
        "_id": count.over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "_runs": count.over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    run = W.partitionBy(*whole, "_id").orderBy(*PLACE)
    full = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joined = {
        "_n": F.sum(F.when(F.col("_pos") == 0, F.col("_n")).otherwise(0)).over(full),
        "_pos": F.row_number().over(run) - 1,
        "_head": F.col("_id") == 1, "_tail": F.col("_id") == F.col("_runs")}
    if LAST in ends.columns:
        joined[LAST] = F.last(LAST, ignorenulls=True).over(full)
    if only is not None:
        joined = {c: F.when(only, value).otherwise(F.col(c)) for c, value in joined.items()}
    return numbered.withColumns(joined).drop("_starts", "_id", "_runs")


# Runs that go on from one batch of lines to the next: a container's open run, as the rows that its
# first lines would be if it ended there.

PLACED = "_place"


def extend_runs(logs: DataFrame, open_runs: DataFrame,
                threshold: int = REPEAT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Collapse a batch of lines that follow the batches before it.

    ``open_runs(container_id, rows)`` holds the last run of each container so far, from the batches
    before; containers without lines in this batch may be left out. Gives the collapsed lines of all runs
    that have ended, and the open run of every container in the batch. Over all batches, the first of
    these and the last :func:`ended_runs` are what :func:`collapse_repeats` makes of all lines at once.
    """
    columns = logs.columns
    raw = [*columns, PLACED, "_pos", "_n", "_head", "_tail"]
    runs = _segment_runs(logs.withColumn(PLACED, F.struct(*PLACE)), threshold).select(*raw)
    edge = F.col("_head") | F.col("_tail")
    here = logs.select(SOURCE).distinct()
    carried = _carried(open_runs.join(here, SOURCE, "left_semi"))
    ends = _join_ends(runs.filter(edge).unionByName(carried.withColumns(
        {"_head": F.lit(True), "_tail": F.lit(True)}).select(*raw)), threshold)
    done = runs.filter(~edge).unionByName(ends.filter(~F.col("_tail")).select(*raw))
    still = ends.filter(F.col("_tail") & (F.col("_pos") < threshold - 1))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "_n", PLACED, *(
        c for c in columns if c not in (*PLACE, SOURCE)))))
    return _replaced(done, columns, threshold), still.groupBy(SOURCE).agg(rows.alias("rows"))


def ended_runs(open_runs: DataFrame, columns: list[str],
               threshold: int = REPEAT_THRESHOLD) -> DataFrame:
    """The collapsed lines of open runs, if they end where they are; ``columns`` are those of the logs."""
    return _replaced(_carried(open_runs), columns, threshold)


def _carried(open_runs: DataFrame) -> DataFrame:
    """The rows of open runs, placed before all segments."""
    rows = open_runs.select(SOURCE, F.explode("rows").alias("r")).select(SOURCE, "r.*")
    return rows.withColumns({"segment": F.lit(-1).cast("long"), "seq": F.col("_pos").cast("long")})


def _replaced(runs: DataFrame, columns: list[str], threshold: int) -> DataFrame:
    """Collapsed runs, every row at the place it was read from."""
    rows = _collapsed(runs, [*columns, PLACED], threshold)
    return rows.withColumns({c: F.col(PLACED)[c] for c in PLACE}).drop(PLACED)


def _collapsed(runs: DataFrame, columns: list[str], threshold: int) -> DataFrame:
    long_run = F.col("_n") >= threshold
    return runs.filter(~long_run | (F.col("_pos") == 0)).select(
        *[F.col(c) for c in columns if c != "message"],
        F.when(long_run, repeat_marker(F.col("_n"), F.col("message")))
        .otherwise(F.col("message")).alias("message"),
        F.when(long_run, F.col("_n")).otherwise(F.lit(1)).cast("long").alias("run_len"),
    )


def dedup_stats(collapsed: DataFrame) -> DataFrame:
    """Rows before, after and saved per container; no second pass over the input."""
    return collapsed.groupBy(SOURCE, "name").agg(
        F.sum("run_len").alias("original_count"),
        F.count(F.lit(1)).alias("deduplicated_count"),
        (F.sum("run_len") - F.count(F.lit(1))).alias("saved_count"),
        (F.count(F.lit(1)) < F.sum("run_len")).alias("deduplicated"),
    )
