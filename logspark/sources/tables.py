"""Stored tables: state, history, reports, interaction log, small texts."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import interaction_document, report, report_path
from ..functions.shapes import at, is_object, text_at
from ..functions.text import sanitize, sanitize_filename
from ..functions.parse import rfc3339
from ..model import SOURCE, STATE
from ..session import delete

# Fixed value: version of the state document. And the containers in one of them, about.
STATE_VERSION = "1"
STATE_ROWS = 1 << 16

STATE_FILE = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("last_updated", T.StringType()),
    T.StructField("containers", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("last_scan", T.StringType()),
        T.StructField("log_cursor", T.StringType()),
    ]))),
])


def _entries(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any Hadoop file system; empty if it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON state file as the state table; a missing file is an empty state."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE_FILE).json(path, multiLine=True, mode="FAILFAST")
    return (rows.select(F.explode(F.map_entries("containers")).alias("e"))
            .select(F.col("e.key").alias(SOURCE), F.col("e.value.name").alias("name"),
                    rfc3339(F.col("e.value.last_scan")).alias("last_scan"),
                    F.coalesce("e.value.log_cursor", F.lit("")).alias("log_cursor")))


def state_of_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """The state table out of JSON documents of differing shape, one a row.

    ``containers`` is an object by container id, or a list of objects that have an ``id``. Fields of
    no meaning here are passed over. A field that is missing or of a wrong type counts as not given,
    a time that is none too; an entry that is no object, or has no id, is left out, and a document
    that is no JSON or has no containers gives no row. An id that several documents have gives a row
    for each.
    """
    spark = documents.sparkSession
    held = documents.select(at(F.try_parse_json(F.col(text)), "$.containers").alias("_held"))
    entries = held.lateralJoin(spark.tvf.variant_explode(F.col("_held").outer()))
    entry = F.col("value")
    return (entries.filter(is_object(entry))
            .select(F.coalesce("key", text_at(entry, "$.id")).alias(SOURCE),
                    text_at(entry, "$.name").alias("name"),
                    rfc3339(text_at(entry, "$.last_scan")).alias("last_scan"),
                    F.coalesce(text_at(entry, "$.log_cursor"), F.lit("")).alias("log_cursor"))
            .filter(F.col(SOURCE).isNotNull()))


def write_state_json(state: DataFrame, path: str, now: datetime) -> None:
    """The state as JSON documents in the folder ``path``, which :func:`read_state_json` reads.

    One document, or as many as keep each to about :data:`STATE_ROWS` containers, each in a file.
    """
    parts = max(1, -(-state.count() // STATE_ROWS))
    stamp = F.concat(F.date_format("last_scan", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    entry = F.struct("name", stamp.alias("last_scan"), "log_cursor")
    documents = state.groupBy(F.pmod(F.xxhash64(SOURCE), F.lit(parts)).alias("part")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(SOURCE, entry)))).alias("containers"))
    documents.select(
        "part", F.lit(STATE_VERSION).alias("version"),
        F.lit(now.isoformat() + "Z").alias("last_updated"), "containers"
    ).write.mode("overwrite").partitionBy("part").json(path)


class VersionedTable:
    """A Parquet table replaced as a whole: each write is a new numbered folder below ``path``.

    A version counts once its ``_SUCCESS`` file is there, so readers never see half a write and a
    job can replace the table it reads. Numbers are the table's own; a write may carry a ``tag``, such
    as a stream and its batch, so that a repeated batch is known as one. The last ``keep`` versions
    stay.
    """

    def __init__(self, path: str, schema: T.StructType, keep: int = 3):
        self.path, self.schema, self.keep = path.rstrip("/"), schema, keep

    def _folders(self, spark: SparkSession) -> list[tuple[int, str, str]]:
        """Number, tag and folder of each whole version, oldest first."""
        found = []
        for name in _entries(spark, self.path):
            number, _, tag = name.removeprefix("v=").partition("@")
            if name.startswith("v=") and exists(spark, f"{self.path}/{name}/_SUCCESS"):
                found.append((int(number), tag, name))
        return sorted(found)

    def versions(self, spark: SparkSession) -> list[int]:
        return [number for number, _, _ in self._folders(spark)]

    def read(self, spark: SparkSession, redo: str | None = None) -> DataFrame:
        """The newest version, or an empty table.

        If a version is tagged ``redo``, the one before it: what that write started from.
        """
        found = self._folders(spark)
        for number, tag, _ in found:
            if redo is not None and tag == redo:
                found = [f for f in found if f[0] < number]
                break
        if not found:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1][2]}")

    def write(self, df: DataFrame, tag: str | None = None) -> int:
        """Add a version, or repeat the newest one if it has this tag.

        Where other versions have followed the tagged one, they are built on it, and stay.
        """
        spark = df.sparkSession
        found = self._folders(spark)
        number = found[-1][0] + 1 if found else 0
        same = [n for n, t, _ in found if tag is not None and t == tag]
        if same and same[-1] < number - 1:
            return same[-1]
        number = same[-1] if same else number
        name = f"v={number:012d}" + (f"@{tag}" if tag else "")
        (df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{name}"))
        for old, _, folder in found:
            if old <= number - self.keep:
                delete(spark, f"{self.path}/{folder}")
        return number


def report_rows(results: DataFrame, now: datetime) -> DataFrame:
    """A rendered report per result, with the file it would be in."""
    return results.select(
        "name", sanitize(F.col("name")).alias("storage_name"),
        F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("scan_ts"),
        report_path("", F.col("name"), now).alias("file"), report(now).alias("content"))


def write_reports(results: DataFrame, path: str, now: datetime, scan_id: str) -> None:
    """A rendered report per result, in the partition of its scan day and scan.

    A scan that is finished again replaces what it wrote before.
    """
    _replace(report_rows(results, now), path, now, scan_id)


def interaction_rows(rows: DataFrame) -> DataFrame:
    """Request/response pairs with their documents."""
    return rows.withColumns({"storage_name": sanitize_filename(F.col("name")),
                             "content": interaction_document()})


def write_interactions(rows: DataFrame, path: str, now: datetime, scan_id: str) -> None:
    """A scan's request/response pairs and their documents, in the interaction log."""
    _replace(interaction_rows(rows), path, now, scan_id)


def _replace(rows: DataFrame, path: str, now: datetime, scan_id: str) -> None:
    folder = f"{path.rstrip('/')}/scan_day={now.date().isoformat()}/scan_id={quote(scan_id, safe='')}"
    rows.write.mode("overwrite").parquet(folder)


def write_dashboard(document: DataFrame, path: str) -> None:
    """Replace the dashboard text; part files in order are the document.

    Each piece ends in the newline the writer adds, so its own last one is left out.
    """
    (document.orderBy("section", "name")
     .select(F.regexp_replace("piece", r"\n\z", "").alias("value"))
     .write.mode("overwrite").text(path))


def stored_names(store: DataFrame) -> DataFrame:
    """Storage names of a table that keeps rows per container."""
    name = F.col("storage_name") if "storage_name" in store.columns else sanitize(F.col("name"))
    return store.select(name.alias("name")).distinct()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files of a folder as (file_stem, instructions); a missing folder is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file_stem string, instructions string")
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("file_stem"),
                        F.col("value").alias("instructions"))


def read_template(spark: SparkSession, path: str | None, default: str) -> str:
    """A prompt template file, or the built-in text if there is none."""
    if not path or not exists(spark, path):
        return default
    return spark.read.text(path, wholetext=True).first()["value"]
