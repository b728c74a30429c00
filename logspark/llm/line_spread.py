"""Removal of boilerplate lines: lines that stand on many distinct sites.

For each line's hash a HyperLogLog sketch counts the sites the line occurs on. Sketches are built per
task and merged by the aggregation, so a line of a third of all rows reaches its reducer as one sketch
a task. Lines whose estimate is clearly above the threshold are boilerplate, clearly below are not;
for the few in between the distinct sites are counted exactly.

Removal moves hashes, not lines: the hashes to drop are gathered per ``doc_id`` and joined with the
documents once. Everything is built-in functions; lines of a document never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

MIN_SITES = 10
MIN_WORDS = 3
LOG_K = 12
NEAR = 0.15  # nine standard errors of a sketch of 2**LOG_K registers
MAX_SHARE = 0.5

SPACES = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _key(line: Column) -> Column:
    """96 bits of hash of the trimmed line."""
    line = _trimmed(line)
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _countable(min_words: int):
    """Lines of at least ``min_words`` words: shorter ones recur by chance."""
    # Only from the line's start, and never back over a word: linear in a line without spaces as well.
    words = f"^[{SPACES}]*+(?:[^{SPACES}]++[{SPACES}]++){{{min_words - 1}}}[^{SPACES}]"
    return lambda line: line.rlike(words)  # looked at up to the last word needed


FEW = 64  # keys that are compared one after the other


def _among(keys: Column, key: Column) -> Column:
    """Whether ``key`` is one of the sorted array ``keys``, which is halved until it is found."""
    def narrower(at: Column, step: Column) -> Column:
        return F.when(F.get(keys, at + step - 1) <= key, at + step).otherwise(at)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))
    last = F.aggregate(steps, F.lit(0), narrower)
    return F.coalesce(F.get(keys, last - 1) == key, F.lit(False))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """``key`` and ``site`` of every line that counts, with the row's ``doc_id``.

    Repeated lines repeat here: what follows counts each once, and aggregates before it shuffles.
    """
    keys = F.transform(F.filter(_lines(F.col("text")), _countable(min_words)), _key)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("site"),
                       F.explode(keys).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """The keys of lines on at least ``min_sites`` distinct sites; a null site is none."""
    lines = occurrences(docs, min_words).select("key", "site")
    estimates = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"))
    wide = written(estimates.where(F.col("sites") >= min_sites * (1 - NEAR)), "line-spread")
    above = F.col("sites") > min_sites * (1 + NEAR)
    near = wide.where(~above).select("key")
    exact = (lines.join(near, "key", "left_semi").groupBy("key")
             .agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites))
    return wide.where(above).select("key").unionByName(exact.select("key"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
                       max_share: float | None = MAX_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are compared without the white space around them; lines of fewer than ``min_words`` words
    never count. A row that would lose more than ``max_share`` of its characters stays as it is: it is
    a copy of a whole document, or nothing but boilerplate, and is left to the steps that deal with
    those. With ``max_share`` None each line is decided by itself, however much a row loses; only a row
    with no countable line of its own stays as it is. All rows stay. A null text stays null with no
    lines; an empty text has one empty line.
    Rows that share an id, or have none, are each cleaned by the same list of lines. Columns other
    than ``doc_id``, ``source`` and ``text`` pass through, whatever their names but ``n_lines`` and
    ``n_removed``, which are replaced.
    """
    own, drop, kept, removes = fresh(docs, "_line_doc", "_line_drop", "_line_kept", "_line_takes")
    hits = (occurrences(docs, min_words)
            .join(boilerplate(docs, min_sites, min_words), "key", "left_semi")
            .groupBy(F.col("doc_id").alias(own))
            .agg(F.array_sort(F.collect_set("key")).alias(drop)))
    joined = docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    lines = _lines(F.col("text"))
    counts = _countable(min_words)
    # An array of one element binds the key to a name, so that it is made once.
    stays = F.filter(lines, lambda line: ~(counts(line) & F.when(
        F.size(drop) <= FEW, F.array_contains(drop, _key(line))).otherwise(
        F.exists(F.array(_key(line)), lambda key: _among(F.col(drop), key)))))
    changed = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), stays))
    lost = F.length("text") - F.length(F.array_join(kept, "\n"))
    stays_whole = (~F.exists(kept, counts) if max_share is None
                   else lost > max_share * F.length("text"))
    takes = F.col(kept).isNotNull() & (lost > 0) & ~stays_whole
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return (changed
            .withColumn(removes, F.coalesce(takes, F.lit(False)))
            .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines))
            .withColumn("n_removed", F.when(F.col(removes),
                                            F.col("n_lines") - F.size(kept)).otherwise(0))
            .withColumn("text", F.when(F.col(removes), F.array_join(kept, "\n"))
                        .otherwise(F.col("text")))
            .drop(own, drop, kept, removes))
