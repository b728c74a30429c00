"""Similarity join of documents on sets of word shingles, by grouped prefixes.

Two sets with a Jaccard similarity of at least ``t`` percent share one of their first
``n - ceil(t * n / 100) + 1`` members in any common order. The order puts long shingles first, which
hardly recur by chance, and last those that many documents have, so that boilerplate does not
make candidates; within a length it is that of the hashes.

1. Rows with equal sets are one class. Classes with the same prefix and the same size are one group,
   and only groups enter the index of prefix members.
2. Hubs: in each group, and for each prefix member in its groups, the class with the fewest members of
   its own is the hub. Each class is paired with its group's hub, and each group's hub with the best
   hub it shares a prefix member with; then once more with a hub by chance, where groups that share
   a member are still in different components. Pairs are verified on the sets. Thousands of near
   copies so become one component by about as many pairs as there are copies.
3. The rest, exactly: all pairs of groups that share prefix members and are still in different
   components are filtered by sizes and the number of members shared, expanded to their classes, and
   verified. A sketch of each set (parities of hashed members) bounds a pair's overlap from above
   and spares most of the work.

Sets are rebuilt from the texts of those rows only that are in a pair. Hand-over tables are written
to the shared folder, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, mix, rows_of, small_batches, written
from .graph import components
from .shingles import set_key, shingle_sets

WORDS = 3
PERCENT = 90
COMMON = 32  # documents, from which on a shingle goes last
COMMON_KEPT = 1 << 17  # such shingles; the order of all others is by hash alone, which is as exact
IN_BATCH = 3
BROADCAST_ROWS = 1 << 20
NEAR_BITS = ((1500, 1 << 10), (24_000, 1 << 14), (1 << 62, 1 << 17))


def _scan(size: int):
    """Class key and size of each row; and shingles that recur in the documents of a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        keys: set[bytes] = set()

        def common() -> pa.RecordBatch:
            often = [(int(v), c) for v, c in seen.items() if c >= IN_BATCH]
            seen.clear()
            keys.clear()
            n = len(often)
            return pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                pa.array(np.array([v for v, _ in often], np.uint64).view(np.int64)),
                pa.array([c for _, c in often], pa.int64())], names=SCAN)

        for rows in rows_of(batches):
            sets = shingle_sets([text for _, text in rows], size)
            own = [set_key(s) if len(s) else None for s in sets]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([doc for doc, _ in rows], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=SCAN)
            new = [s for s, k in zip(sets, own) if k is not None and k not in keys]
            keys.update(k for k in own if k is not None)
            if len(keys) > 1 << 18:
                keys.clear()
            if new:
                values, counts = np.unique(np.concatenate(new), return_counts=True)
                several = counts > 1
                seen.update(dict(zip(values[several].tolist(), counts[several].tolist())))
            if len(seen) > 1 << 18:
                yield common()
        yield common()

    return work


SCAN = ["doc_id", "n", "key", "shingle", "hits"]
SCAN_TYPES = "doc_id long, n long, key binary, shingle long, hits long"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(values: np.ndarray) -> bytes:
    """For each place a set's members hash to, whether their number there is odd."""
    bits = next(b for n, b in NEAR_BITS if len(values) < n)
    places = mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=bits) & 1).tobytes()


def _prefixes(size: int, percent: int, common: np.ndarray):
    """Each class's prefix, group and sketch. ``common``: hashes to be put last, the rarer first."""
    order = np.argsort(common)
    by_hash = common[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for rows in rows_of(batches):
            out = []
            for values in shingle_sets([text for _, text in rows], size):
                if not len(values):
                    continue
                key, n = set_key(values), len(values)
                if key in done:
                    continue
                done.add(key)
                last = np.zeros(n, bool)
                if len(by_hash):
                    at = np.minimum(np.searchsorted(by_hash, values), len(by_hash) - 1)
                    last = by_hash[at] == values
                first = values[~last][:prefix_length(n, percent)]
                more = prefix_length(n, percent) - len(first)
                if more > 0:
                    first = np.concatenate((first, common[np.sort(order[at[last]])[:more]]))
                group = set_key(np.append(first, np.uint64(n)))
                out.append((key, group, n, int((~last).sum()), first.view(np.int64),
                            sketch(values)))
            if len(done) > 1 << 18:
                done.clear()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), PREFIX_TYPES)], names=PREFIX)

    return work


PREFIX = ["key", "grp", "n", "own", "prefix", "sketch"]
PREFIX_TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
PREFIX_SQL = "key binary, grp binary, n long, own long, prefix array<long>, sketch binary"


def _may_link(percent: int):
    """Pairs whose sketches leave room for a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            far = np.array([
                int.from_bytes(x, "big").__xor__(int.from_bytes(y, "big")).bit_count()
                if len(x) == len(y) else 0
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())],
                np.int64)
            # |x & y| <= (na + nb - far) / 2, and |x | y| is na + nb less that
            overlap = (na + nb - far) // 2
            passes = 100 * overlap >= percent * (na + nb - overlap)
            yield batch.select(["a", "b"]).filter(pa.array(passes, pa.bool_()))

    return work


def _links(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("va"), batch.column("vb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield out.filter(pa.array(linked, pa.bool_()))

    return work


class Join:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        self.docs, self.size, self.percent = documents(docs), size, percent
        scan = written(self.docs.mapInArrow(_scan(size), SCAN_TYPES), "shingle-scan")
        self.rows = scan.where("hits IS NULL").select("doc_id", "n", "key")
        often = (scan.where("hits IS NOT NULL").groupBy("shingle").agg(F.sum("hits").alias("c"))
                 .where(F.col("c") >= COMMON).orderBy(F.desc("c"), "shingle").limit(COMMON_KEPT)
                 .orderBy("c", "shingle").collect())
        common = np.array([r[0] for r in often], np.int64).view(np.uint64)
        known = self.docs.where("doc_id IS NOT NULL")
        prefixes = known.mapInArrow(_prefixes(size, percent, common), PREFIX_SQL)
        self.sets = written(prefixes.dropDuplicates(["key"]), "prefixes")

    def sizes(self, a: str, b: str):
        return ((100 * F.col(a) >= self.percent * F.col(b))
                & (100 * F.col(b) >= self.percent * F.col(a)))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs ``a``, ``b`` of classes that sizes and sketches leave possible, written."""
        own = self.sets.select("key", "n", "sketch")
        one = pairs.select("a", "b").distinct().join(
            own.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")),
            "a")
        two = one.join(
            own.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")),
            "b").where(self.sizes("na", "nb"))
        with small_batches(self.docs.sparkSession):  # two sketches a row, of up to 16 KB
            return written(two.mapInArrow(_may_link(self.percent), "a binary, b binary"), "pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link. ``pairs`` is a written table."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
        chosen = (self.rows.where("doc_id IS NOT NULL").join(wanted, "key", "left_semi").groupBy("key")
                  .agg(F.min("doc_id").alias("doc_id")))
        chosen = written(chosen, "wanted")
        few = chosen.count() <= BROADCAST_ROWS  # ids and keys of 24 bytes each
        ids = chosen.select("doc_id").distinct()
        texts = self.docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        size = self.size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in rows_of(batches):
                sets = [s for s in shingle_sets([text for _, text in rows], size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "members"])

        sets = written(texts.mapInArrow(work, "key binary, members binary")
                       .join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]),
                       "shingle-sets")
        one = pairs.select("a", "b").join(
            sets.select(F.col("key").alias("a"), F.col("members").alias("va")), "a")
        two = one.join(sets.select(F.col("key").alias("b"), F.col("members").alias("vb")), "b")
        with small_batches(self.docs.sparkSession):  # two sets a row, of any size
            return written(two.mapInArrow(_links(self.percent), "a binary, b binary"), "links")

    def run(self) -> DataFrame:
        """``node`` and ``root`` of classes that are linked with others."""
        groups = self.sets.groupBy("grp").agg(
            F.min(F.struct("own", "key")).alias("hub"), F.first("n").alias("n"),
            F.first("prefix").alias("prefix"), F.count("*").alias("members"))
        # the hub's own members, then 40 bits of hash: groups that share a code are treated as one
        code = F.shiftleft(F.least("hub.own", F.lit(1 << 22)), 40).bitwiseOR(
            F.xxhash64("grp").bitwiseAND(F.lit((1 << 40) - 1)))
        groups = written(groups.select(code.alias("code"), "grp", F.col("hub.key").alias("key"), "n",
                                       "prefix", "members"), "groups")
        several = groups.where("members > 1").select("grp", "code", F.col("key").alias("hub"))
        inside = written(self.sets.select("grp", "key").join(several, "grp").drop("grp"), "members")
        self.classes = written(groups.select("code", "key").unionByName(
            inside.where("key <> hub").select("code", "key")), "classes")
        self.hubs = groups.select("code", "key")

        index = groups.select(F.explode("prefix").alias("member"), "code", "n")
        tops = (index.groupBy("member").agg(F.count("*").alias("groups"), F.min("code").alias("top"),
                                            F.min_by("n", "code").alias("top_n"))
                .where("groups > 1").drop("groups"))
        shared = written(index.join(tops, "member"), "shared-members")
        best = (shared.where((F.col("code") != F.col("top")) & self.sizes("n", "top_n"))
                .groupBy("code").agg(F.min("top").alias("top")))
        pairs = self.between_hubs(best).unionByName(
            inside.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")))
        links = self.verified(self.filtered(pairs))
        roots = components(links)

        # once more with a hub by chance, where groups that share a member are still apart
        shared = self.open(shared.select("member", "code", "n"), roots)
        tops = shared.groupBy("member").agg(*(
            F.min_by(c, F.xxhash64("code")).alias(f"top_{c}") for c in ("code", "n", "low", "high")))
        best = (shared.join(tops, "member")
                .where((F.col("code") != F.col("top_code")) & self.sizes("n", "top_n")
                       & (F.least("low", "top_low") != F.greatest("high", "top_high")))
                .groupBy("code").agg(F.min("top_code").alias("top")))
        pairs = self.filtered(self.between_hubs(best))
        if not pairs.isEmpty():
            links = written(links.unionByName(self.verified(pairs)), "links")
            roots = components(links)

        pairs = self.apart(shared.select("member", "code", "n"), roots)
        if pairs.isEmpty():
            return roots
        return components(links.unionByName(self.verified(pairs)))

    def between_hubs(self, best: DataFrame) -> DataFrame:
        """Pairs of codes as pairs of their groups' hubs."""
        one = best.join(self.hubs.withColumnRenamed("key", "a"), "code").select("top", "a")
        two = self.hubs.select(F.col("code").alias("top"), F.col("key").alias("b"))
        return one.join(two, "top").select("a", "b")

    def open(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of groups in different components, with hashes of the lowest and highest root."""
        spans = self.rooted(roots).groupBy("code").agg(
            F.min("mark").alias("low"), F.max("mark").alias("high"))
        placed = shared.join(spans, "code")
        mixed = (placed.groupBy("member").agg(F.min("low").alias("l"), F.max("high").alias("h"))
                 .where("l <> h").select("member"))
        return written(placed.join(mixed, "member", "left_semi"), "shared-members")

    def rooted(self, roots: DataFrame) -> DataFrame:
        """Each class's group, and its root as 64 bits of hash."""
        own = roots.select(F.col("node").alias("key"), "root")
        return self.classes.join(own, "key", "left").select(
            "code", "key", F.xxhash64(F.coalesce("root", "key")).alias("mark"))

    def apart(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """All possible pairs of classes of different components.

        Pairs of groups are filtered by sizes and by the number of prefix members they share: what
        lies behind the prefixes adds at most ``ceil(percent * n / 100) - 1``, for the larger set.
        Those left are expanded to their classes, as are groups that are in several components.
        """
        shared = self.open(shared, roots)
        one = shared.select("member", *(F.col(c).alias(f"{c}_a") for c in ("code", "n", "low", "high")))
        two = shared.select("member", *(F.col(c).alias(f"{c}_b") for c in ("code", "n", "low", "high")))
        both = (one.join(two, "member")
                .where((F.col("code_a") < F.col("code_b")) & self.sizes("n_a", "n_b")
                       & (F.least("low_a", "low_b") != F.greatest("high_a", "high_b")))
                .groupBy("code_a", "code_b").agg(
                    F.count("*").alias("both"), F.min("n_a").alias("na"), F.min("n_b").alias("nb")))
        behind = F.ceil(self.percent * F.greatest("na", "nb") / 100) - 1
        overlap = F.least(F.col("both") + behind, "na", "nb")
        both = both.where(100 * overlap >= self.percent * (F.col("na") + F.col("nb") - overlap))
        rooted = self.rooted(roots)
        inner = (rooted.groupBy("code").agg(F.min("mark").alias("l"), F.max("mark").alias("h"))
                 .where("l <> h").select(F.col("code").alias("code_a"), F.col("code").alias("code_b")))
        pairs = both.select("code_a", "code_b").unionByName(inner)
        for side in ("a", "b"):
            pairs = pairs.join(rooted.select(F.col("code").alias(f"code_{side}"),
                                             F.col("key").alias(side),
                                             F.col("mark").alias(f"mark_{side}")), f"code_{side}")
        pairs = pairs.where("mark_a <> mark_b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.filtered(pairs)


def linked_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two rows link when ``100 * |x & y| >= percent * |x | y|`` for their sets of shingles of ``size``
    words. ``component_id`` is the smallest ``doc_id`` that links reach. A null or empty text, or one
    without words, has an empty set and its own id; a row without an id links nothing and has no component.
    Rows that repeat or share an id are judged row by row. Texts
    are compared whole, and columns other than ``doc_id`` and ``text`` are ignored.
    """
    join = Join(docs, size, percent)
    roots = join.run().select(F.col("node").alias("key"), "root")
    placed = join.rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = (placed.where("root IS NOT NULL").groupBy("root")
              .agg(F.min("doc_id").alias("lowest")))
    return placed.join(lowest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; rows without an id stay.

    Rows that share the smallest id all stay.
    """
    found = linked_documents(docs, size, percent)
    (other,) = fresh(docs, "_gone")
    gone = (found.where(F.col("doc_id").isNotNull() & (F.col("component_id") != F.col("doc_id")))
            .select(F.col("doc_id").alias(other)).distinct())
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(other), "left_anti")
