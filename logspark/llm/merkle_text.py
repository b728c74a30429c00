"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a few words.

All of it is column expressions. Sections stand between blank lines, paragraphs are lines, and pieces
are up to four words (of up to sixteen characters; what is longer counts as several) with the spaces
before them. A node's digest is that of its children's, so equal roots mean equal texts, and two
trees differ exactly below the branches whose digests differ.

A fingerprint is that tree as text, parted by spaces: ``#`` and the root's SHA-256, then for every
section ``/`` and 16 hex digits, for every paragraph in it ``-`` and 16 digits, and for every piece of
that 8 digits followed by the piece's length. Only the shown digits are cut; digests are made of whole
ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, written

# Up to four words with the spaces before them; the spaces that end a line stand alone.
PIECE = "(?: *[^ ]{1,16}){1,4}| +"
RANGE_BYTES = 8 << 20    # of text in a range of neighbours, on average
TASK_BYTES = 64 << 20    # of text in a task, on average: several ranges, so that tasks are even
MOST_RANGES = 1 << 16


def _digest(of: Column) -> Column:
    return F.sha2(of, 256)


def _joined(nodes: Column, field: str) -> Column:
    return F.array_join(F.transform(nodes, lambda node: node[field]), "")


def _paragraph(line: Column) -> Column:
    pieces = F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)),
                         lambda piece: F.struct(_digest(piece).alias("digest"),
                                                F.length(piece).alias("n")))
    # An array of one element binds the pieces to a name, so that they are made once.
    return F.transform(F.array(pieces), lambda p: F.struct(
        _digest(F.concat(F.lit("-"), _joined(p, "digest"))).alias("digest"),
        F.aggregate(p, F.lit(0), lambda n, piece: n + piece["n"]).alias("n"),
        F.transform(p, lambda piece: F.concat(F.left(piece["digest"], F.lit(8)),
                                              piece["n"].cast("string"))).alias("pieces")))[0]


def _section(text: Column) -> Column:
    paragraphs = F.transform(F.split(text, "\n", -1), _paragraph)
    return F.transform(F.array(paragraphs), lambda p: F.struct(
        _digest(F.concat(F.lit("/"), _joined(p, "digest"))).alias("digest"),
        p.alias("paragraphs")))[0]


def tree(text: Column) -> Column:
    """The sections of a text: digest and paragraphs, those with digest, characters and pieces.

    Null is the empty text, which is one section of one paragraph without pieces.
    """
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), _section)


def _short(digest: Column) -> Column:
    return F.left(digest, F.lit(16))


def as_text(sections: Column) -> Column:
    """A :func:`tree` as fingerprint."""
    def paragraph(p: Column) -> Column:
        return F.concat(F.lit(" -"), _short(p["digest"]), F.when(F.size(p["pieces"]) > 0, F.concat(
            F.lit(" "), F.array_join(p["pieces"], " "))).otherwise(""))

    def section(s: Column) -> Column:
        return F.concat(F.lit(" /"), _short(s["digest"]),
                        F.array_join(F.transform(s["paragraphs"], paragraph), ""))

    return F.concat(F.lit("#"), _digest(F.concat(F.lit("#"), _joined(sections, "digest"))),
                    F.array_join(F.transform(sections, section), ""))


def fingerprint(text: Column) -> Column:
    return F.transform(F.array(tree(text)), as_text)[0]


def root(of: Column) -> Column:
    """The root of a fingerprint: equal roots, equal texts."""
    return F.substring(of, 2, 64)


def _pieces(of: Column) -> Column:
    """The pieces of a fingerprint; each repetition of one is marked by its number."""
    def numbered(sorted_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (
            F.get(sorted_, i) != F.get(sorted_, i - 1)))
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(sorted_)))
        return F.flatten(F.zip_with(starts, ends, lambda start, end: F.transform(
            F.sequence(F.lit(1), end - start), lambda k: F.when(k == 1, F.get(sorted_, start)).otherwise(
                F.concat(F.get(sorted_, start), F.lit("#"), k.cast("string"))))))

    pieces = F.filter(F.split(of, " ", -1), lambda token: F.ascii(token) >= F.lit(48))
    return F.transform(F.array(pieces), lambda p: F.when(
        F.size(F.array_distinct(p)) == F.size(p), p).otherwise(
        F.transform(F.array(F.array_sort(p)), numbered)[0]))[0]


def _weight(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, piece: n + F.substring_index(
        F.substring(piece, 9, 20), "#", 1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """How much of two fingerprints' texts is alike, from 0 to 1.

    1 for equal roots; else twice the characters of the pieces that both have, each as often as in
    both, over the characters of either's pieces. 0 where they have no piece in common.
    """
    def shared(sides: Column) -> Column:
        whole = _weight(sides["a"]) + _weight(sides["b"])
        both = _weight(F.array_intersect(sides["a"], sides["b"]))
        return F.when(whole > 0, (2 * both) / whole).otherwise(F.lit(0.0))
    parts = F.array(F.struct(_pieces(a).alias("a"), _pieces(b).alias("b")))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.transform(parts, shared)[0])


def _flat(sections: Column) -> Column:
    """The paragraphs of all sections with the digest of theirs, and the numbers of both."""
    def of(section: Column, s: Column) -> Column:
        return F.transform(section["paragraphs"], lambda p, i: F.struct(
            s.alias("section"), i.alias("paragraph"), section["digest"].alias("branch"),
            p["digest"].alias("digest"), p["n"].alias("n")))
    return F.flatten(F.transform(sections, of))


def edits(pairs: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """The paragraphs of column ``a`` that ``b`` of the same row lacks: section, paragraph, characters.

    Only sections whose digest ``b`` lacks are looked into. ``key`` names the pair. Exchange the two
    columns for what ``b`` has anew.
    """
    own = pairs.select(F.col(key).alias("pair"), F.explode(_flat(tree(F.col(a)))).alias("p"))
    other = pairs.select(F.col(key).alias("pair"), tree(F.col(b)).alias("t"))
    branches = other.select("pair", F.explode("t.digest").alias("branch")).distinct()
    leaves = other.select("pair", F.explode(_flat(F.col("t"))["digest"]).alias("digest")).distinct()
    return (own.select("pair", "p.*").join(branches, ["pair", "branch"], "left_anti")
            .join(leaves, ["pair", "digest"], "left_anti")
            .select(F.col("pair").alias(key), "section", "paragraph", F.col("n").alias("n_chars")))


# Neighbours in the order of ids.

def _fraction(digest: Column) -> Column:
    """The place of a hex digest among all, from 0 to 1."""
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _range_of(order: Column, fraction: Column, bounds: list[int]) -> Column:
    """The number of the range that a row falls into, rising with (``order``, ``fraction``).

    A value that is several of the ``bounds``, as many rows have it, is parted by ``fraction``.
    """
    if not bounds:
        return F.lit(0)
    known = F.expr("array({})".format(", ".join(f"bigint({bound})" for bound in bounds)))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def below(test: Callable[[Column], Column]) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            test(F.get(known, at + step - 1)), at + step).otherwise(at))
    under = below(lambda bound: bound < order)
    until = below(lambda bound: bound <= order)
    return under + F.least(F.floor(fraction * (until - under + 1)).cast("int"), until - under)


def with_next(docs: DataFrame) -> DataFrame:
    """Add the next document's text and fingerprint, in ascending ``doc_id``, the first after the last.

    Rows without an id count as those of the least long, equal ids stand in the order of their texts'
    SHA-256. Rows are dealt into ranges of ids by quantiles, each of which gets the first row of the
    next one as well, so a neighbour is found by one window per range.
    """
    spark = docs.sparkSession
    least = F.lit(-2 ** 63).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"order": F.coalesce("doc_id", least), "tie": F.sha2("text", 256)})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, partitions_for(spark, size, RANGE_BYTES))
    bounds = []
    if ranges > 1:
        shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
        bounds = rows.agg(F.expr(f"percentile_approx(order, array({shares}), {max(10_000, 10 * ranges)})")
                          ).first()[0] or []
    rows = rows.withColumn("range", _range_of(F.col("order"), _fraction(F.col("tie")), bounds))
    # One row a range, at most MOST_RANGES of them: each range gets the first row of the next one, the
    # last that of the first.
    firsts = rows.groupBy("range").agg(F.min(F.struct("order", "tie")).alias("first"))
    firsts = written(rows.join(F.broadcast(firsts.select("range", "first.*")), ["range", "order", "tie"])
                     .dropDuplicates(["range"]).select("range", "order", "tie", "text"), "firsts")
    ring = W.orderBy("range")
    turn = firsts.select("range").withColumn("before", F.coalesce(
        F.lag("range").over(ring), F.max("range").over(
            ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    ends = firsts.join(F.broadcast(turn), "range")
    rows = rows.withColumn("guard", F.lit(False)).unionByName(ends.select(
        F.lit(None).cast("long").alias("doc_id"), "text", "order", "tie",
        F.col("before").alias("range"), F.lit(True).alias("guard")))
    here = W.partitionBy("range").orderBy("guard", "order", "tie")
    tasks = partitions_for(spark, size, TASK_BYTES)
    dealt = rows.repartition(tasks, "range").sortWithinPartitions("range", "guard", "order", "tie")
    made = dealt.withColumn("fingerprint", fingerprint(F.col("text")))
    return (made.withColumns({"next_text": F.lead("text").over(here),
                              "next_fingerprint": F.lead("fingerprint").over(here)})
            .where(~F.col("guard"))
            .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter replaced by as many first characters of ``other``, or all of it."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - quarter), F.left(other, quarter))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to this and the next.

    A null text is the empty one; empty texts are equal. A table of one document has it as its own
    next one; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
