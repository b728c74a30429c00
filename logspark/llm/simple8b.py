"""Token ids in files of Simple-8b words, written in document order and read back.

A 64-bit word holds a 4-bit selector and 60 bits: from 60 ids of one bit to one id of 60 bits, or a
run of 120 zeros. Selector 0 is an escape: an id too wide for a word stands in a list of its own, and
the word has its place there. Which selector fits is worked out for all positions at once, from
sliding maxima of bit lengths; only the hop from word to word is a loop. Decoding is vectorised: the
words of a selector are taken apart together.

A file is one Parquet part, holding a range of ``doc_id``; a row is a block of whole documents with
its words, its first id's position in the part, each document's length, and for every
``STRIDE``-th word the number of ids before it, so that a reader can start inside a block. Parquet
is the container because Spark writes it to any shared store and commits whole tasks: a lost executor
leaves no half-written part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..session import shared_folder
from .common import documents, rows_of

# Fixed values of the code, by selector: ids in a word, and bits of each.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

STRIDE = 128
BLOCK_IDS = 1 << 16
END_ID = 2
CACHE = 250_000

BLOCKS = ("part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "offsets binary, escapes binary, words binary")


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Exact to 53 bits; above that rounding may give one bit more, which only costs an escape."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """The selector that takes most ids at each position; past the end there are only zeros."""
    n, width = len(bits), 1
    sliding = np.concatenate((bits, np.zeros(COUNTS[1], np.uint8)))
    best = np.where(bits > BITS[-1], 0, len(COUNTS) - 1).astype(np.uint8)
    for code in range(len(COUNTS) - 2, 0, -1):
        while width < COUNTS[code]:  # two overlapping windows make a wider one
            step = min(width, COUNTS[code] - width)
            sliding = np.maximum(sliding[:-step], sliding[step:])
            width += step
        best[sliding[:n] <= BITS[code]] = code
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``ids``, the escaped ids, and the ids before every :data:`STRIDE`-th word."""
    ids = np.asarray(ids, np.uint64)
    best = _selectors(_bit_lengths(ids))
    spans = np.array(COUNTS)[best].tolist()
    starts, at, n = [], 0, len(ids)
    while at < n:
        starts.append(at)
        at += spans[at]
    starts = np.array(starts, np.int64)
    codes = best[starts]
    words = codes.astype(np.uint64)
    padded = np.concatenate((ids, np.zeros(COUNTS[1], np.uint64)))
    for code in np.unique(codes).tolist():
        where = np.flatnonzero(codes == code)
        if code == 0:
            words[where] |= np.arange(len(where), dtype=np.uint64) << np.uint64(4)
        elif BITS[code]:
            for k in range(COUNTS[code]):
                words[where] |= padded[starts[where] + k] << np.uint64(4 + k * BITS[code])
    return words, ids[starts[codes == 0]], starts[::STRIDE]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of a run of words."""
    codes = (words & np.uint64(15)).astype(np.int64)
    counts = np.array(COUNTS)[codes]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for code in np.unique(codes).tolist():
        where = np.flatnonzero(codes == code)
        data = words[where] >> np.uint64(4)
        if code == 0:
            out[starts[where]] = escapes[data.astype(np.int64)]
        elif BITS[code]:
            mask = np.uint64((1 << BITS[code]) - 1)
            for k in range(COUNTS[code]):
                out[starts[where] + k] = (data >> np.uint64(k * BITS[code])) & mask
    return out[:n]


class WordIds:
    """Ids by the tokenizers library, kept for each piece of text.

    The tokenizer drops white space and joins nothing across it, nor across the border of letters,
    digits and marks; small letters are all it sees. A text of plain Latin letters, digits and marks
    goes to the library's model piece by piece. In any other text the runs between ASCII white space
    that are not plain go through the library's whole encoder.
    """

    # Letters that are one character in NFC, and marks that start no contraction or special token.
    letters = "a-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0103\u0105\u0107\u0109\u010d\u010f\u0111\u0113"
    marks = re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
    plain = re.compile(f"[{letters}0-9{marks}\\s]*", re.ASCII).fullmatch
    pieces = re.compile(f"[{letters}]+|[0-9]|[{marks}]+").findall

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode
        self.model = tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x180)
                      if self.plain(chr(c)) and not chr(c).isspace()}
        self.seen: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """The pieces of a text; a run for the whole encoder has a space before it."""
        low = text.lower()
        if self.plain(low):
            return self.pieces(low)
        out = []
        for run in text.encode().split():
            run = run.decode()
            out += self.pieces(low) if self.plain(low := run.lower()) else [" " + run]
        return out

    def learn(self, parts: set[str]) -> None:
        tokenize, table = self.model.tokenize, self.table
        for part in parts:
            if part[0] == " ":
                ids = self.encode(part[1:], add_special_tokens=False).ids
            else:
                ids = [t.id for t in tokenize(part.translate(table))]
            self.seen[part] = array("I", ids).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.parts(text) for text in texts]
        needed = set().union(*parts)
        missing = needed.difference(self.seen)
        if len(self.seen) + len(missing) > CACHE:  # what these texts know is what is frequent
            self.seen = {part: self.seen[part] for part in needed.difference(missing)}
        self.learn(missing)
        get = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<u4") for own in parts]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending ``doc_id`` order.

    A null or empty text has the end id alone. Rows without an id come first; rows that share an id
    are ordered by text. A very long text makes a long block of its own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = load(tokenizer), TaskContext.get().partitionId()
        block, first, held, own = 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([ids for _, ids in own])
            words, escapes, offsets = encode(ids)
            values = (part, block, first, len(ids), [doc for doc, _ in own],
                      [len(ids) for _, ids in own], offsets.astype("<u4").tobytes(),
                      escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, ARROW)], schema=ARROW)

        for rows in rows_of(batches):
            for (doc, _), ids in zip(rows, ids_of([text or "" for _, text in rows])):
                own.append((doc, np.append(ids, np.uint32(end_id))))
                held += len(ids) + 1
                if held >= BLOCK_IDS:
                    yield flush()
                    block, first, held, own = block + 1, first + held, 0, []
        if own:
            yield flush()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(work, BLOCKS).write.parquet(path)


ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()),
    ("escapes", pa.binary()), ("words", pa.binary()),
])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Each document with its place among all ids and its ids, decoded from the files in ``path``."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (blocks.groupBy("part").agg(F.sum("n_ids").alias("in_part"))  # one row a file
             .select("part", (F.sum("in_part").over(order) - F.col("in_part")).alias("base")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                ids = decode(words, np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                ids = ids.astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                raw = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    pa.array(raw, pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # one row of 12 bytes a file, so the broadcast is bounded by the number of files
    placed = blocks.join(F.broadcast(parts), "part").select(
        (F.col("first") + F.col("base")).alias("start"), "n_ids", "doc_ids", "lengths", "escapes",
        "words")
    return placed.mapInArrow(
        work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new folder among the shared ones and read the files back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, path)
    return read_ids(spark, path)
