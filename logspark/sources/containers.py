"""The container inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import to_java

# Fixed value: the state of a container that is up.
RUNNING = "running"


def container_name(name: Column) -> Column:
    """One leading slash removed."""
    return F.regexp_replace(name, "^/", "")


def list_containers(containers: DataFrame, name_pattern: str = "",
                    include_all: bool = False) -> DataFrame:
    """Containers whose name matches anywhere; running ones only unless ``include_all``."""
    rows = containers if include_all else containers.filter(F.col("state") == RUNNING)
    named = rows.withColumn("name", container_name(F.col("name")))
    return named.filter(F.col("name").rlike(to_java(name_pattern))) if name_pattern else named
