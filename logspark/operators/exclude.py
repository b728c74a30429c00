"""Exclusion of log lines by per-container patterns."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import PatternError, fold, required_literals, to_java
from ..functions.render import TOKENS_PER_FILTERED_LINE, savings
from ..model import PLACE, SOURCE
from ..session import materialize


@dataclass(frozen=True)
class LineFilter:
    """Patterns whose matches are left out; in force only if enabled and not empty."""

    patterns: tuple[str, ...] = ()
    enabled: bool = True


def check_filters(filters: Mapping[str, LineFilter]) -> None:
    """Raise on the first invalid pattern, naming container and index; disabled sets are skipped."""
    for name, rule in filters.items():
        for i, pattern in enumerate(rule.patterns if rule.enabled else ()):
            try:
                to_java(pattern)
            except PatternError as error:
                raise PatternError(f"patterns[{i}] of container {name!r}: {error}") from error


def rule_problems(rules: DataFrame) -> DataFrame:
    """The patterns of a rule table that are refused: ``name``, ``pattern_no``, ``pattern``, ``problem``.

    Every pattern of an enabled rule is checked, each distinct one once, where the table is read;
    ``pattern_no`` counts from 0 within its rule.
    """
    return _problems(_listed(rules))


def _listed(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled").select(
        "name", F.posexplode("patterns").alias("pattern_no", "pattern")).where("pattern IS NOT NULL")


def _problems(listed: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def problem(patterns: pd.Series) -> pd.Series:
        return patterns.map(_problem).astype(object)

    judged = listed.select("pattern").distinct().withColumn("problem", problem("pattern"))
    return listed.join(judged.filter("problem IS NOT NULL"), "pattern").select(
        "name", "pattern_no", "pattern", "problem")


def _problem(pattern: str) -> str | None:
    try:
        to_java(pattern)
    except PatternError as error:
        return str(error)
    return None


def matches_any(message: Column, patterns: tuple[str, ...]) -> Column:
    """True if any pattern matches. Literal patterns are compiled once per task."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | message.rlike(to_java(pattern))
    return F.coalesce(found, F.lit(False))


def excluded(filters: Mapping[str, LineFilter]) -> Column:
    """Whether the row's container has a filter in force that matches its message.

    The configuration is small and known on the driver, so it becomes a CASE with one branch per
    distinct pattern set: the rows are neither joined nor shuffled.
    """
    check_filters(filters)
    names = defaultdict(list)
    for name, rule in filters.items():
        if rule.enabled and rule.patterns:
            names[rule.patterns].append(name)
    if not names:
        return F.lit(False)
    branches = None
    for patterns, group in names.items():
        on, value = F.col("name").isin(*group), matches_any(F.col("message"), patterns)
        branches = F.when(on, value) if branches is None else branches.when(on, value)
    return branches.otherwise(F.lit(False))


def flag_excluded(logs: DataFrame, filters: Mapping[str, LineFilter]) -> DataFrame:
    return logs.withColumn("excluded", excluded(filters))


def exclude_lines(logs: DataFrame, filters: Mapping[str, LineFilter]) -> DataFrame:
    return logs.filter(~excluded(filters))


# Distinct patterns, and patterns in all distinct sets together, up to which every task holds all.
MOST_PATTERNS = 20_000
MOST_ENTRIES = 2_000_000
# Beyond that: about how many patterns of one name, and bytes of texts, are held together.
BLOCK_PATTERNS = 20_000
BLOCK_BYTES = 8 << 20
# Patterns without a required literal that are tried as one.
TOGETHER = 64


def exclude_by_table(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with ``rules(name, enabled, patterns)`` as a table.

    For pattern sets too many for a CASE of names. Patterns are translated and checked like configured
    ones, where the table is read; a bad one raises :class:`PatternError`. Several rules of one name
    count together.

    A line is not tried against every pattern: one automaton over the literals that the patterns
    require finds those that could match it, and only these are matched. Up to :data:`MOST_PATTERNS`
    distinct patterns are held by every task (:func:`candidates`), where names with equal patterns share
    a set and all sets together hold up to :data:`MOST_ENTRIES`; the join of lines with the number of
    their container's set is left to Catalyst. More patterns, of any number, stay tables
    (:func:`_exclude_by_blocks`).
    """
    listed = materialize(_listed(rules).groupBy("name", "pattern").agg(
        F.min("pattern_no").alias("pattern_no")), "rules")
    bad = _problems(listed).first()
    if bad:
        raise PatternError(f"patterns[{bad.pattern_no}] of container {bad.name!r}: {bad.problem}")
    listed = listed.where("name IS NOT NULL").select("name", "pattern")
    distinct = listed.select("pattern").distinct()
    # No more than is needed to tell is counted; the sets, which are wide, are made for few patterns.
    if distinct.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        return _exclude_by_blocks(logs, listed)
    sets = (listed.groupBy("name").agg(F.array_sort(F.collect_list("pattern")).alias("patterns"))
            .groupBy("patterns").agg(F.collect_list("name").alias("names"))
            .withColumn("number", F.row_number().over(W.orderBy("patterns")) - 1))
    total = sets.agg(F.sum(F.size("patterns"))).first()[0] or 0
    if total > MOST_ENTRIES:
        return _exclude_by_blocks(logs, listed)
    known = [tuple(r.patterns) for r in sets.orderBy("number").select("patterns").collect()]
    if not known:
        return logs
    of_set, tried = _fresh(logs, "_set"), _fresh(logs, "_tried")
    named = sets.select(F.explode("names").alias("name"), F.col("number").alias(of_set))
    placed = logs.join(named, "name", "left")
    lines = placed.withColumn(tried, F.when(
        F.col(of_set).isNotNull() & F.col("message").isNotNull(),
        candidates(known)(F.col(of_set), F.col("message"))))
    hit = F.exists(tried, lambda pattern: F.rlike("message", pattern))
    return lines.filter(~F.coalesce(hit, F.lit(False))).select(*logs.columns)


def _exclude_by_blocks(logs: DataFrame, listed: DataFrame) -> DataFrame:
    """Lines without a match among ``listed(name, pattern)``, which holds distinct valid patterns.

    The patterns of a name are dealt to blocks of about :data:`BLOCK_PATTERNS`, its lines to parts of
    about :data:`BLOCK_BYTES` of messages. A part meets one block in one group, and what is left of it
    the next block in the next pass, so what a task holds is bounded, however many patterns there are,
    or lines of one name. There are as many passes as the name with most patterns has blocks.
    """
    logs = materialize(logs, "lines")
    patterns = materialize(listed.mapInArrow(
        _translated, "name string, pattern string, java string, literals array<string>"), "patterns")
    blocks, part, tried = (_fresh(logs, c) for c in ("_blocks", "_part", "_tried"))
    sizes = (patterns.groupBy("name").agg(F.ceil(F.count("*") / BLOCK_PATTERNS).alias(blocks))
             .join(logs.groupBy("name").agg(F.coalesce(F.sum(F.octet_length("message")), F.lit(0))
                                            .alias("_bytes")), "name")
             .select("name", blocks, F.floor(F.col("_bytes") / BLOCK_BYTES + 1).alias(part)))
    sizes = materialize(sizes, "sizes")
    number = F.pmod(F.xxhash64(SOURCE, *PLACE), F.col(part))
    placed = logs.join(sizes, "name", "left").select(
        *logs.columns, blocks, number.alias(part))
    to_try = F.col(blocks).isNotNull() & F.col("message").isNotNull()
    done, rest = placed.where(~to_try), placed.where(to_try)
    dealt = patterns.join(sizes, "name").select(
        "name", F.pmod(F.xxhash64("pattern"), F.col(blocks)).alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(part) - 1)).alias(part), "java", "literals")
    passes = sizes.agg(F.max(blocks)).first()[0] or 0
    for i in range(passes):
        if i:
            rest = materialize(rest, "lines")
            done = done.unionByName(rest.where(F.col(blocks) <= i))
        own = dealt.where(F.col("_block") == i).drop("_block")
        met = (rest.where(F.col(blocks) > i).groupBy("name", part)
               .cogroup(own.groupBy("name", part))
               .applyInArrow(_tried(tried), T.StructType([*rest.schema, T.StructField(tried, TRIED)])))
        hit = F.exists(tried, lambda pattern: F.rlike("message", pattern))
        rest = met.where(~hit).drop(tried)
    return done.unionByName(rest).select(*logs.columns)


TRIED = T.ArrayType(T.StringType())


def _translated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns with their Java forms and required literals."""
    for batch in batches:
        own = batch.column("pattern").to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column("name"), batch.column("pattern"),
            pa.array([to_java(p) for p in own], pa.string()),
            pa.array([required_literals(p) for p in own], pa.list_(pa.string()))],
            names=["name", "pattern", "java", "literals"])


def _tried(column: str):
    """A part's lines with the Java patterns of a block that could match them, the longest first."""

    def work(lines: pa.Table, patterns: pa.Table) -> pa.Table:
        java, required = patterns.column("java").to_pylist(), patterns.column("literals").to_pylist()
        order = sorted(range(len(java)), key=lambda i: (-len(java[i]), java[i]))
        java, required = [java[i] for i in order], [required[i] for i in order]
        literals, members, rest = defaultdict(list), set(), []
        for i, own in enumerate(required):
            for literal in own or ():
                literals[literal].append(i)
            members.add(i) if own is not None else rest.append(java[i])
        automaton, always = _automaton(literals), _together(rest)
        messages = lines.column("message").combine_chunks().dictionary_encode()  # each text is tried once
        tried = pa.array((_could_match(automaton, java, [members], [always], 0, text.as_py())
                          for text in messages.dictionary), pa.list_(pa.string()))
        return pa.table([*lines.columns, tried.take(messages.indices)],
                        names=[*lines.column_names, column])

    return work


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def candidates(sets: list[tuple[str, ...]]):
    """A function of a set's number and a message: the Java patterns of the set that could match it.

    ``sets`` are RE2 patterns. Those with required literals are candidates where one of these is in
    the message, found for all patterns in one pass over it. Those without are always tried, joined to
    alternatives of :data:`TOGETHER` patterns.
    """
    numbers = {p: i for i, p in enumerate(sorted(set().union(*sets)))}
    java = [to_java(p) for p in numbers]
    literals = defaultdict(list)
    without = set()
    for pattern, i in numbers.items():
        required = required_literals(pattern)
        for literal in required or ():
            literals[literal].append(i)
        if required is None:
            without.add(i)
    members = [frozenset(numbers[p] for p in own) - without for own in sets]
    always = []
    for own in sets:
        rest = [java[i] for i in sorted(without & {numbers[p] for p in own})]
        always.append(_together(rest))
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast((java, dict(literals), members, always))

    @F.pandas_udf("array<string>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        java, literals, members, always = shared.value
        automaton = _automaton(literals)
        for numbers, messages in batches:
            yield pd.Series([_could_match(automaton, java, members, always, number, message)
                             for number, message in zip(numbers, messages)], dtype=object)

    return of


def _together(java: list[str]) -> list[str]:
    return ["|".join(f"(?:{p})" for p in java[i:i + TOGETHER])
            for i in range(0, len(java), TOGETHER)]


def _automaton(literals: dict[str, list[int]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for literal, patterns in literals.items():
        automaton.add_word(literal, patterns)
    if literals:
        automaton.make_automaton()
    return automaton


def _could_match(automaton, java: list[str], members: list[frozenset], always: list[list[str]],
                 number, message: str | None) -> list[str]:
    if message is None or number is None or number != number:
        return []
    own, found = members[int(number)], set()
    if own and len(automaton):
        for _, patterns in automaton.iter(fold(message)):
            found.update(patterns)
    return [*(java[i] for i in sorted(found & own)), *always[int(number)]]


def filter_stats(flagged: DataFrame) -> DataFrame:
    """Total, filtered and kept lines per container, with the savings derived from them."""
    counts = flagged.groupBy(SOURCE, "name").agg(
        F.count(F.lit(1)).alias("lines_total"),
        F.count_if("excluded").alias("lines_filtered"),
        F.count_if(~F.col("excluded")).alias("lines_kept"),
    )
    return counts.withColumns({
        "filter_reduction": savings(F.col("lines_total"), F.col("lines_kept")),
        "tokens_saved": F.col("lines_filtered") * TOKENS_PER_FILTERED_LINE,
    })
