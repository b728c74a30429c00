"""Zone map of log files: what times of which containers a file holds, so that old files stay closed."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SOURCE
from ..session import materialize

TABLE = "zones"
ZONES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField(SOURCE, T.StringType()),
    T.StructField("greatest", T.TimestampNTZType()),
    T.StructField("untimed", T.BooleanType()),
])


def zones(logs: DataFrame) -> DataFrame:
    """A row for each file and container of ``logs``, which are read from files.

    ``greatest`` is the greatest time, ``untimed`` tells of rows without one. Three narrow columns are
    read, and rows are aggregated where they are read.
    """
    file = F.regexp_replace("_metadata.file_path", "^([a-z0-9]+:)/+", "$1/")
    return logs.groupBy(file.alias("file"), SOURCE).agg(
        F.max("ts").alias("greatest"), F.bool_or(F.col("ts").isNull()).alias("untimed"))


def _plain(path: str) -> str:
    """A file's name in one form, whoever lists it."""
    return re.sub("^([a-z0-9]+:)/+", r"\1/", path)


def needed(known: DataFrame, state: DataFrame, now: datetime, first_scan: timedelta) -> DataFrame:
    """The files that may hold new lines, or the line before one without a time.

    For a container all of whose rows have times: files with a row at or after its cursor, or, without
    one, at or after ``first_scan`` before ``now``. For one with other rows, which stand where the row
    before them stands: files with such a row, or one at or after the oldest start of all.
    """
    first = F.lit((now - first_scan).isoformat(sep=" ")).cast("timestamp_ntz")
    floor = state.agg(F.least(F.coalesce(F.min("last_scan"), first), first)).scalar()
    cursors = state.select(SOURCE, F.col("last_scan").alias("_since"))
    mixed = known.groupBy(SOURCE).agg(F.bool_or("untimed").alias("_mixed"))
    start = F.when(F.col("_mixed"), F.least(F.coalesce("_since", first), floor)).otherwise(
        F.coalesce("_since", first))
    return (known.join(cursors, SOURCE, "left").join(mixed, SOURCE)
            .filter(F.col("untimed") | (F.col("greatest") >= start)).select("file").distinct())


def read_needed(spark: SparkSession, path: str, known: DataFrame, state: DataFrame, now: datetime,
                first_scan: timedelta) -> tuple[DataFrame, DataFrame]:
    """The logs of a folder of Parquet files that a scan has to look at, and the zones of new files.

    Of files not in ``known`` three narrow columns are read for their zones; then those files are opened
    that :func:`needed` tells of. File names are handled by the driver, as Spark's own listing is.
    """
    every = spark.read.parquet(path)
    paths = {_plain(f): f for f in every.inputFiles()}
    listed = spark.createDataFrame([(f,) for f in paths], "file string")
    new = [paths[r.file] for r in listed.join(
        known.select("file").distinct(), "file", "left_anti").collect()]
    reader = spark.read.schema(every.schema)
    own = materialize(zones(reader.parquet(*new)) if new else spark.createDataFrame([], ZONES), "zones")
    wanted = needed(known.unionByName(own), state, now, first_scan).join(listed, "file", "left_semi")
    files = sorted(paths[r.file] for r in wanted.collect())
    return (reader.parquet(*files) if files else spark.createDataFrame([], every.schema)), own
