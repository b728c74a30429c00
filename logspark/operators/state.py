"""Views and resets of the cursor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import to_java
from ..model import SOURCE, ZERO_TIME

# Display texts.
NEVER, NO_CURSOR = "Never", "-"


def _hit(pattern: str) -> Column:
    if pattern == "":
        raise ValueError("the pattern must not be empty")
    java = to_java(pattern)
    return F.col("name").rlike(java) | F.col(SOURCE).rlike(java)


def reset_matching(state: DataFrame, pattern: str) -> DataFrame:
    """State without the rows whose name or id matches."""
    return state.filter(~_hit(pattern))


def matching(state: DataFrame, pattern: str) -> DataFrame:
    """The rows :func:`reset_matching` removes."""
    return state.filter(_hit(pattern))


def reset_all(state: DataFrame) -> DataFrame:
    return state.filter(F.lit(False))


def remove(state: DataFrame, container_id: str) -> DataFrame:
    return state.filter(F.col(SOURCE) != container_id)


def row_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("containers"))


def listing(state: DataFrame) -> DataFrame:
    zero = F.lit(ZERO_TIME).cast("timestamp_ntz")
    unset = F.col("last_scan").isNull() | (F.col("last_scan") == zero)
    cursor = F.coalesce("log_cursor", F.lit(""))
    return state.select(
        F.left(F.col(SOURCE), F.lit(12)).alias("short_id"), "name",
        F.when(unset, NEVER).otherwise(F.date_format("last_scan", "yyyy-MM-dd HH:mm:ss"))
        .alias("last_scan"),
        F.when(cursor == "", NO_CURSOR).otherwise(cursor).alias("log_cursor"))
