"""The scan as a stream: every micro-batch is one scan."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import STATE
from ..operators import cursor
from ..session import materialize, scratch
from ..sources.logs import place_lines
from ..sources.tables import VersionedTable


def scan_stream(stream: DataFrame, state_path: str, checkpoint: str,
                handle: Callable[[DataFrame, int], None], now: Callable[[], datetime],
                to_logs: Callable[[DataFrame], DataFrame] = place_lines) -> StreamingQuery:
    """Hand each micro-batch's new lines to ``handle(lines, batch_id)`` and move the cursors.

    ``stream`` comes from :func:`sources.logs.scan_lines`, or from any source together with its own
    ``to_logs``, which turns a micro-batch into log rows.

    Runs of repeats and chunks stay within a batch, as they stay within a scan. A version of the state
    table is tagged with the stream and its batch: a batch run again after a failure starts from the
    same state and replaces what it wrote, so ``handle`` should key its own output by ``batch_id`` too.
    Other writers, such as a reset between two batches, add versions of their own. Unseen containers
    start an hour before ``now``; late rows behind a cursor are not read. The lines of a batch are
    removed once it is done.
    """
    table = VersionedTable(state_path, STATE)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        tag = f"{stream_id(spark, checkpoint)}-{batch_id}"
        with scratch(spark):
            state = table.read(spark, redo=tag)
            new = cursor.new_lines(to_logs(rows), state, now())
            lines = materialize(new, f"batch-{batch_id}")
            handle(lines, batch_id)
            table.write(cursor.advance(state, cursor.last_times(lines)), tag)

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]
