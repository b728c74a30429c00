"""The first lines of each container."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import PLACE, SOURCE

# Fixed value: lines shown per container.
PREVIEW_LINES = 10


def preview(logs: DataFrame, lines: int = PREVIEW_LINES) -> DataFrame:
    """The first ``lines`` rows per container with ``line_no`` and the number of rows not shown.

    The rank limit is applied before the shuffle, and the counts are aggregated apart, so neither
    side moves a whole container.
    """
    rank = F.row_number().over(W.partitionBy(SOURCE).orderBy(*PLACE))
    first = (logs.withColumn("line_no", rank).filter(F.col("line_no") <= lines)
             .withColumn("line_no", F.col("line_no").cast("long")))
    counts = logs.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("_rows"))
    return (first.join(counts, SOURCE)
            .withColumn("more_lines", F.greatest(F.col("_rows") - lines, F.lit(0)).cast("long"))
            .drop("_rows"))
