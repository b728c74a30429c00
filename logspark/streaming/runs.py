"""Repeats collapsed over a stream: runs go on from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import LOGS, SOURCE
from ..operators.dedup import PLACED, ended_runs, extend_runs
from ..session import materialize, scratch
from ..sources.store import Snapshot, Store, read_keyed, upsert_keyed
from .incremental import stream_id

LINES, OPEN = "lines", "open_runs"

_ROW = T.StructType([
    T.StructField("_pos", T.IntegerType()), T.StructField("_n", T.LongType()),
    T.StructField(PLACED, T.StructType([LOGS["segment"], LOGS["seq"]])),
    *(f for f in LOGS.fields if f.name not in ("segment", "seq", SOURCE))])
OPEN_RUNS = T.StructType([T.StructField(SOURCE, T.StringType()),
                          T.StructField("rows", T.ArrayType(_ROW))])
COLLAPSED = T.StructType([*LOGS.fields, T.StructField("run_len", T.LongType())])


def stream_runs(stream: DataFrame, path: str, checkpoint: str,
                to_logs: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Collapse the lines of a stream into the store at ``path``, until what is available is read.

    Lines of a container arrive in their order, batch after batch. Each batch commits, together, the
    lines of the runs that ended in it and the open run of each of its containers, a few rows that are
    kept as a keyed table: a batch costs what is in it, however many containers there are. A batch that
    is run again after a failure starts from the same open runs and replaces what it wrote.
    """
    store = Store(path)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        change = store.begin(spark, f"{stream_id(spark, checkpoint)}-{batch_id}")
        with scratch(spark):
            logs = materialize(to_logs(rows).select(*LOGS.names), f"batch-{batch_id}")
            known = read_keyed(change, spark, OPEN, SOURCE, OPEN_RUNS)
            ended, still = extend_runs(logs, known)
            still = materialize(still, "open-runs")
            change.add(LINES, ended.select(*COLLAPSED.names), str(batch_id))
            upsert_keyed(change, OPEN, SOURCE, OPEN_RUNS, still)
            change.commit()

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def collapsed_lines(now: Snapshot, spark: SparkSession) -> DataFrame:
    """The lines of a stream so far, as if it ended here."""
    still = read_keyed(now, spark, OPEN, SOURCE, OPEN_RUNS)
    return now.read(spark, LINES, COLLAPSED).unionByName(
        ended_runs(still, LOGS.names).select(*COLLAPSED.names))
