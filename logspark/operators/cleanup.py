"""Detection and removal of data of containers that no longer exist."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ORPHAN_PREFIX, sanitize, sanitize_filename, short_id, unsanitize
from ..model import SOURCE


class Stores(NamedTuple):
    """Tables keyed by container: ``state`` by id, the others by the container's ``name``.

    A store's rows go under the name's storage form, in ``storage_name`` where the store has such a
    column, else made from ``name`` (which may be a storage name already).
    """

    state: DataFrame
    kb: DataFrame
    reports: DataFrame
    llm_logs: DataFrame


def _storage(store: DataFrame) -> Column:
    return F.col("storage_name") if "storage_name" in store.columns else sanitize(F.col("name"))


def _forms(name: Column) -> Column:
    """The storage forms a container's name can have: most stores change slashes only."""
    return F.array_distinct(F.array(sanitize(name), sanitize_filename(name)))


def stored_names(kb: DataFrame, reports: DataFrame, llm_logs: DataFrame | None) -> DataFrame:
    """Every storage name once, with the stores that hold it (one shuffle for all three)."""
    flags = ("in_kb", "in_reports", "in_llm_logs")
    stores = [(kb, "in_kb"), (reports, "in_reports"), (llm_logs, "in_llm_logs")]
    rows = None
    for store, flag in stores:
        if store is None:
            continue
        part = store.select(_storage(store).alias("name"), *[F.lit(f == flag).alias(f) for f in flags])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name").agg(*[F.bool_or(f).alias(f) for f in flags])


def find_obsolete(state: DataFrame, live: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (id, name, in_state, in_kb, in_reports, in_llm_logs), one per finding.

    A state row that is not live, with the stores its name occurs in; and a stored name that no live
    state row carries, under the id ``orphaned-<name>``. A dead container with stored data is
    therefore reported both ways. ``names`` comes from :func:`stored_names`; ``live`` holds the ids
    of the containers that exist. Stored names of live containers missing from state count as
    orphaned.
    """
    ids = live.select(SOURCE).distinct()
    gone = state.join(ids, SOURCE, "left_anti").select(SOURCE, F.col("name").alias("_name"))
    flags = ("in_kb", "in_reports", "in_llm_logs")
    held = (gone.filter(F.col("_name") != "")
            .select(SOURCE, F.explode(_forms(F.col("_name"))).alias("name")).join(names, "name")
            .groupBy(SOURCE).agg(*[F.bool_or(f).alias(f) for f in flags]))
    from_state = gone.join(held, SOURCE, "left").select(
        F.col(SOURCE).alias("id"), F.col("_name").alias("name"), F.lit(True).alias("in_state"),
        *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    kept = (state.join(ids, SOURCE, "left_semi")
            .select(F.explode(_forms(F.col("name"))).alias("name")).distinct())
    orphans = (names.join(kept, "name", "left_anti")
               .select(F.concat(F.lit(ORPHAN_PREFIX), F.col("name")).alias("id"),
                       unsanitize(F.col("name")).alias("name"), F.lit(False).alias("in_state"),
                       *flags)
               .join(gone.select(F.col(SOURCE).alias("id")), "id", "left_anti"))
    return from_state.unionByName(orphans)


def report(obsolete: DataFrame) -> DataFrame:
    """Findings in id order, with the id shortened for display."""
    return obsolete.withColumn("short_id", short_id(F.col("id"))).orderBy("id")


def apply(stores: Stores, obsolete: DataFrame, llm_enabled: bool = True) -> Stores:
    """The stores without the findings' data; a finding without a name touches no named store."""
    def without(store: DataFrame, flag: str) -> DataFrame:
        hit = (obsolete.filter(F.col(flag) & (F.col("name") != ""))
               .select(F.explode(_forms(F.col("name"))).alias("_name")).distinct())
        return store.join(hit, _storage(store) == F.col("_name"), "left_anti")

    ids = obsolete.filter("in_state").select(F.col("id").alias(SOURCE))
    return Stores(
        stores.state.join(ids, SOURCE, "left_anti"),
        without(stores.kb, "in_kb"),
        without(stores.reports, "in_reports"),
        without(stores.llm_logs, "in_llm_logs") if llm_enabled else stores.llm_logs,
    )
