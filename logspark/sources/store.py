"""Tables of one store that change together.

A store is a folder of data folders and of commits. A transaction writes data folders that nobody knows
of yet and then, last, one commit that names them: readers follow the newest whole commits, so of all
the tables of a store they see what one scan wrote, or nothing of it. A commit lists what it adds and
drops; every :data:`CHECKPOINT`-th one lists all that is in force, so that few are read.

Tables are made of parts, and a part of folders. What a table's parts mean is up to its writer: days of a
history, scans of a report table, or the one part of a state table, whose folders are deltas.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete
from .tables import _entries, exists

CHECKPOINT = 16
COMMIT = "added boolean, ord long, tab string, part string, folder string, n long"


@dataclass(frozen=True)
class Entry:
    """A data folder of a part of a table; ``order`` rises with time, ``rows`` is what it holds."""

    order: int
    table: str
    part: str
    folder: str
    rows: int


@dataclass(frozen=True)
class Snapshot:
    """What was in force after commit ``number``; -1 is the empty store."""

    path: str
    number: int
    entries: tuple[Entry, ...] = ()

    def of(self, table: str, *parts: str) -> list[Entry]:
        """The entries of a table, or of some of its parts, oldest first."""
        return sorted((e for e in self.entries if e.table == table and (not parts or e.part in parts)),
                      key=lambda e: e.order)

    def parts(self, table: str) -> list[str]:
        return sorted({e.part for e in self.of(table)})

    def read(self, spark: SparkSession, table: str, schema: T.StructType, *parts: str) -> DataFrame:
        """The rows of a table, or of some of its parts; none where there are no entries."""
        return _read(spark, self.path, self.of(table, *parts), schema)


def _read(spark: SparkSession, path: str, entries: list[Entry], schema: T.StructType) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{e.folder}" for e in entries))


class Store:
    """A folder of tables that change together."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _commits(self, spark: SparkSession) -> list[tuple[int, str, bool, str]]:
        """Number, tag, whether it is a checkpoint, and folder of each whole commit, oldest first."""
        found = []
        for name in _entries(spark, f"{self.path}/commits"):
            number, _, tag = name.removeprefix("c=").partition("@")
            if name.startswith("c=") and exists(spark, f"{self.path}/commits/{name}/_SUCCESS"):
                full = number.endswith("full")
                found.append((int(number.removesuffix("full")), tag, full, name))
        return sorted(found)

    def snapshot(self, spark: SparkSession, redo: str | None = None) -> Snapshot:
        """What is in force now; before the commit tagged ``redo``, if there is one."""
        commits = self._commits(spark)
        for number, tag, _, _ in commits:
            if redo is not None and tag == redo:
                commits = [c for c in commits if c[0] < number]
                break
        if not commits:
            return Snapshot(self.path, -1)
        start = max((c[0] for c in commits if c[2]), default=-1)
        needed = [c for c in commits if (c[2] and c[0] == start) or (c[0] > start and not c[2])]
        rows = spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(
            [f"{self.path}/commits/{name}" for *_, name in needed]).collect()
        dropped = {r.folder for r in rows if not r.added}
        return Snapshot(self.path, commits[-1][0], tuple(sorted(
            (Entry(r.ord, r.tab, r.part, r.folder, r.n) for r in rows
             if r.added and r.folder not in dropped), key=lambda e: e.order)))

    def begin(self, spark: SparkSession, tag: str) -> Transaction:
        """A transaction on top of the newest commit; on what ``tag`` started from, if that is newest.

        Where other commits have followed the one of that tag, they are built on it: the transaction is
        closed from the start, and what it is given is not written.
        """
        commits = self._commits(spark)
        same = [c[0] for c in commits if c[1] == tag]
        closed = bool(same) and commits[-1][0] > same[-1]
        return Transaction(self, spark, tag, self.snapshot(spark, redo=None if closed else tag), closed)

    def vacuum(self, spark: SparkSession) -> int:
        """Remove data folders that no commit has in force; not while a transaction is open."""
        known = {e.folder.split("/")[0] for e in self.snapshot(spark).entries}
        loose = [n for n in _entries(spark, f"{self.path}/data") if n not in known]
        for name in loose:
            delete(spark, f"{self.path}/data/{name}")
        return len(loose)


@dataclass
class Transaction:
    """Changes that appear together with :meth:`commit`, or not at all."""

    store: Store
    spark: SparkSession
    tag: str
    before: Snapshot
    closed: bool = False
    added: list[Entry] = field(default_factory=list)
    dropped: set[str] = field(default_factory=set)

    def current(self, table: str, *parts: str) -> list[Entry]:
        """The entries of a table as this transaction would leave them."""
        own = [e for e in self.added if e.table == table and (not parts or e.part in parts)]
        return [e for e in [*self.before.of(table, *parts), *own] if e.folder not in self.dropped]

    def read(self, table: str, schema: T.StructType, *parts: str) -> DataFrame:
        return _read(self.spark, self.store.path, self.current(table, *parts), schema)

    def add(self, table: str, rows: DataFrame, part: str = "") -> int:
        """Write ``rows`` as one more folder of a part; none for no rows. Gives their number."""
        if self.closed:
            return 0
        folder = uuid.uuid4().hex
        path = f"{self.store.path}/data/{folder}"
        rows.write.parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()
        if n:
            order = 1 + max((e.order for e in [*self.before.entries, *self.added]), default=-1)
            self.added.append(Entry(order, table, part, folder, n))
        return n

    def add_by(self, table: str, rows: DataFrame, by: str) -> None:
        """Write ``rows`` as a folder for each value of ``by``, which names the part."""
        if self.closed:
            return
        folder = uuid.uuid4().hex
        path = f"{self.store.path}/data/{folder}"
        rows.withColumn("_part", F.col(by)).write.partitionBy("_part").parquet(path)
        order = 1 + max((e.order for e in [*self.before.entries, *self.added]), default=-1)
        held = rows.groupBy(F.col(by).alias("part")).count().orderBy("part").collect()
        self.added += [Entry(order + i, table, part, f"{folder}/_part={part}", n)
                       for i, (part, n) in enumerate(held)]

    def drop(self, *entries: Entry) -> None:
        self.dropped.update(e.folder for e in entries)

    def replace(self, table: str, rows: DataFrame, part: str = "") -> int:
        """Write ``rows`` in place of all folders of a part. They may be made of those."""
        old = self.current(table, part)
        n = self.add(table, rows, part)
        self.drop(*old)
        return n

    def commit(self) -> int:
        """Let the changes appear; a commit of the same tag that was the newest is replaced."""
        if self.closed:
            return self.before.number
        number = self.before.number + 1
        kept = [e for e in [*self.before.entries, *self.added] if e.folder not in self.dropped]
        own = [e for e in self.added if e.folder not in self.dropped]
        gone = [e for e in self.before.entries if e.folder in self.dropped]
        self._write(number, [(True, e) for e in own] + [(False, e) for e in gone], "")
        if number and number % CHECKPOINT == 0:
            self._write(number, [(True, e) for e in kept], "full")
        self.closed = True
        return number

    def _write(self, number: int, entries: list[tuple[bool, Entry]], kind: str) -> None:
        rows = [(added, e.order, e.table, e.part, e.folder, e.rows) for added, e in entries]
        (self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite")
         .json(f"{self.store.path}/commits/c={number:012d}{kind}@{self.tag}"))


# Tables of a store whose rows are replaced by key: deltas, merged when they are read.

REMOVED, ORDER = "_removed", "_order"


def _delta_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(REMOVED, T.BooleanType()),
                         T.StructField(ORDER, T.LongType())])


def _newest(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """The newest row of each key, removals included."""
    names = [c for c in [*schema.names, REMOVED, ORDER] if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), ORDER).alias("_r"))
    return newest.select(key, *(F.col(f"_r.`{c}`").alias(c) for c in names))


def read_keyed(source: Snapshot | Transaction, spark: SparkSession, table: str, key: str,
               schema: T.StructType) -> DataFrame:
    """The rows of a keyed table: of each key the newest, unless that is its removal."""
    path = source.path if isinstance(source, Snapshot) else source.store.path
    entries = source.of(table) if isinstance(source, Snapshot) else source.current(table)
    rows = _read(spark, path, entries, _delta_schema(schema))
    return _newest(rows, key, schema).filter(~F.col(REMOVED)).select(*schema.names)


def upsert_keyed(change: Transaction, table: str, key: str, schema: T.StructType,
                 rows: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Add a delta of changed rows and of keys that go; gives the rows written.

    Deltas are merged like runs of a merge sort: as long as the last but one is less than twice as
    long as the last, the two become one. So there are few of them, and over time a row is written
    again about as often as the table has doubled since. Removals are forgotten in the oldest one.
    """
    order = 2 * (1 + max((e.order for e in [*change.before.entries, *change.added]), default=-1))
    parts = []
    if rows is not None:  # a row that is changed as well is not removed
        parts.append(rows.select(*schema.names).withColumns(
            {REMOVED: F.lit(False), ORDER: F.lit(order + 1).cast("long")}))
    if removed is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key)
                 for f in schema.fields]
        parts.append(removed.select(key).distinct().select(*empty).withColumns(
            {REMOVED: F.lit(True), ORDER: F.lit(order).cast("long")}))
    written = change.add(table, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    while len(runs := change.current(table)) > 1 and runs[-2].rows < 2 * runs[-1].rows:
        merged = _newest(_read(change.spark, change.store.path, runs[-2:], _delta_schema(schema)),
                         key, schema)
        if len(runs) == 2:
            merged = merged.filter(~F.col(REMOVED))
        merged = merged.select(*schema.names, REMOVED, ORDER)
        written += change.add(table, merged)
        change.drop(*runs[-2:])
    return written


def rewrite_parts(change: Transaction, table: str, schema: T.StructType, parts: list[str],
                  keep: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Apply ``keep`` to some parts of a table; those that lose all rows go. Gives the parts rewritten.

    A part that loses no row is not written.
    """
    rewritten = []
    for part in parts:
        old = change.current(table, part)
        rows = keep(_read(change.spark, change.store.path, old, schema))
        if old and rows.count() < sum(e.rows for e in old):
            change.replace(table, rows, part)
            rewritten.append(part)
    return rewritten
