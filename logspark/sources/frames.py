"""Multiplexed log frames as a data source: a stream id, three zero bytes, a length, and the payload.

``read_frames`` gives log rows of a folder of frame files, ``stream_frames`` those of the files that
arrive in it, ``write_frames`` makes such files. A file is read by one task, a batch at a time, so
files should be of bounded size; a task never holds more than a batch and one frame of it.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, WriterCommitMessage)

from ..functions import parse as P
from ..model import SEGMENT_SPAN

NAME = "logspark-frames"
SCHEMA = "_path string, _no long, stream_decoded string, ts timestamp_ntz, value string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# A batch ends with this many lines or bytes.
BATCH_LINES, BATCH_BYTES = 1 << 13, 4 << 20

_HEADER = struct.Struct(">B3xI")
_STREAM_IDS = {name: sid for sid, name in P.FRAME_STREAMS.items()}
_TIME = re.compile(r"(\d{4}-\d\d-\d\dT(?:[01]\d|2[0-3]):\d\d:\d\d)(?:[.,](\d+))?"
                   r"(?:Z|([+-])(\d\d):([0-5]\d))", re.ASCII)


def line_time(line: str) -> datetime | None:
    """The time a line starts with, as :func:`functions.parse.rfc3339` of its timestamp gives it."""
    found = _TIME.fullmatch(line.partition(" ")[0]) if " " in line else None
    if not found:
        return None
    clock, fraction, sign, hours, minutes = found.groups()
    try:
        local = datetime.fromisoformat(clock) + timedelta(
            microseconds=int((fraction or "")[:6].ljust(6, "0")))
        shift = timedelta(hours=int(hours or 0), minutes=int(minutes or 0))
        return local + shift if sign == "-" else local - shift
    except (ValueError, OverflowError):
        return None


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path.rstrip("/")))


def _files(path: str) -> list[str]:
    """Paths of all files of a folder in order, but for those that are still being written."""
    fs, folder = _file_system(path)
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found
                  if f.is_file and not f.base_name.startswith((".", "_")))


def _lines(source, name: str) -> Iterator[tuple[str | None, str]]:
    """Stream name and text of each line; a last frame that is cut off gives what there is of it."""
    while len(header := source.read(_HEADER.size)) == _HEADER.size:
        sid, size = _HEADER.unpack(header)
        if sid > max(P.FRAME_STREAMS) or header[1:4] != bytes(3):
            raise ValueError(f"no frame header where one should be in {name}")
        text = source.read(size).decode("utf-8", "replace").removesuffix("\n")
        for line in text.split("\n"):
            yield P.FRAME_STREAMS.get(sid), line.removesuffix("\r")


@dataclass
class FrameFile(InputPartition):
    path: str


class _Frames:
    """What batch and stream readers share: a file's lines, as batches."""

    def __init__(self, path: str):
        self.path = path
        self.since: datetime | None = None

    def read(self, partition: FrameFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where there are no files
            return
        fs, _ = _file_system(self.path)
        schema = pa.schema([("_path", pa.string()), ("_no", pa.int64()),
                            ("stream_decoded", pa.string()), ("ts", pa.timestamp("us")),
                            ("value", pa.string())])
        rows, held = [], 0
        with fs.open_input_stream(partition.path, buffer_size=1 << 20) as source:
            for no, (stream, line) in enumerate(_lines(source, partition.path)):
                time = line_time(line)
                if self.since is not None and (time is None or time < self.since):
                    continue
                rows.append((partition.path, no, stream, time, line))
                held += len(line)
                if len(rows) >= BATCH_LINES or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class FrameReader(_Frames, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Lines before a start time are left out where the file is read; other filters stay."""
        for f in filters:
            if (isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ts",)
                    and isinstance(f.value, datetime) and f.value.tzinfo is None):
                self.since = max(f.value, self.since or f.value)
                if isinstance(f, GreaterThanOrEqual):
                    continue
            yield f

    def partitions(self) -> list[FrameFile]:
        return [FrameFile(p) for p in _files(self.path)]


class FrameStream(_Frames, DataSourceStreamReader):
    """Files that arrive whole, each under a path behind those before it, as rotated logs do."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_files(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[FrameFile]:
        return [FrameFile(p) for p in _files(self.path) if start["after"] < p <= end["after"]]


class FrameWriter(DataSourceWriter):
    """A file for each run of rows with the same ``file``.

    A file takes its name when it is whole, and a task that runs again replaces it.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        fs, folder = _file_system(self.path)
        name, sink, temporary = None, None, None

        def close() -> None:
            if sink is not None:
                sink.close()
                fs.move(temporary, f"{folder}/{name}")

        for row in iterator:
            if row["file"] != name:
                close()
                name = row["file"]
                parent, _, base = f"{folder}/{name}".rpartition("/")
                fs.create_dir(parent)
                temporary = f"{parent}/.{base}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(temporary, buffer_size=1 << 20)
            payload = row["value"].encode() + b"\n"
            sink.write(_HEADER.pack(_STREAM_IDS.get(row["stream"], 0), len(payload)) + payload)
        close()
        return WriterCommitMessage()


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to the session, which then pushes filters to Python data sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FrameSource)


def place_frames(lines: DataFrame, container: Column | None = None,
                 span: int = SEGMENT_SPAN) -> DataFrame:
    """Lines of frames as log rows; each file is one container unless ``container`` says otherwise.

    ``container`` is a column over ``_path``. Files of one container follow each other by path, and
    ``span`` lines of one are a segment. ``stream`` is always stdout, as for text lines, and
    ``stream_decoded`` tells the frame's.
    """
    owner = container if container is not None else F.regexp_extract("_path", r"([^/]+)$", 1)
    return lines.select(
        owner.alias("container_id"), owner.alias("name"),
        F.format_string("%s#%012d", "_path", F.expr(f"_no div {span}")).alias("segment"),
        F.col("_no").alias("seq"), P.line_timestamp(F.col("value")).alias("ts_raw"), "ts",
        F.lit(P.STDOUT).alias("stream"), "stream_decoded",
        P.line_message(F.col("value")).alias("message"))


def read_frames(spark: SparkSession, path: str, container: Column | None = None) -> DataFrame:
    """Log rows of all frame files below a folder; a filter ``ts >= …`` reaches the files."""
    register(spark)
    return place_frames(spark.read.format(NAME).load(path), container)


def stream_frames(spark: SparkSession, path: str, container: Column | None = None) -> DataFrame:
    """Log rows of the frame files that arrive below a folder."""
    register(spark)
    return place_frames(spark.readStream.format(NAME).load(path), container)


def write_frames(lines: DataFrame, path: str) -> None:
    """Write ``lines(file, stream, value)``, a frame each, to the files they name below ``path``.

    The rows of a file have to be next to each other in one partition, in their order.
    """
    register(lines.sparkSession)
    (lines.select("file", "stream", F.coalesce("value", F.lit("")).alias("value"))
     .write.format(NAME).mode("append").save(path))
