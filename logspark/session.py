"""Session settings and the written hand-over tables of multi-stage plans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the sizing: partitions are coalesced to the advisory size after each
# shuffle, skewed join sides are split, and joins turn into broadcasts on measured sizes only.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites are not recorded per column expression; that was half of the planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in ``spark.checkpoint.dir``.

    Where that is unset, as in local sessions, it is a folder in the warehouse, which executors share
    as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/hand-over"


# The tables written since the innermost ``scratch`` began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that several later stages read: they prune columns from the written table instead
    of running the upstream again, and a lost executor costs a re-read, not a recomputation. Inside
    :func:`scratch` the table goes when that ends.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/logspark-{run}/{label}-{uuid.uuid4().hex}"
    kept = _written.get()
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that :func:`materialize` wrote inside.

    Results that are read after it have to be written elsewhere first.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any Hadoop file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settings_for(input_bytes: int, partition_bytes: int = 512 << 20) -> dict[str, str]:
    """:data:`SETTINGS` with the shuffle sized to the input: ``partition_bytes`` per partition.

    AQE merges partitions that turn out small but never splits a plain shuffle further, so the
    number has to start high enough.
    """
    partitions = max(200, -(-input_bytes // partition_bytes))
    return SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
