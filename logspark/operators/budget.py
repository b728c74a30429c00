"""Token budget per container and the choice between one request and many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.render import budget_line, budget_line_bytes, log_line_bytes
from ..functions.render import log_line as render_line
from ..functions.text import sanitize
from ..functions.tokens import TokenCounter
from ..model import SOURCE

# Context size by default, room kept for the reply, share of the rest a chunk may use.
MAX_TOKENS = 128_000
RESPONSE_RESERVE = 4000
CHUNK_DIVISOR = 2

DIRECT, CHUNKED, EMPTY = "direct", "chunked", "empty"


def priced_lines(flagged: DataFrame, counter: TokenCounter,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Flagged lines with what budget and packing need; excluded lines lose their message.

    ``tokens`` is the price of a line in a chunk and ``text_size`` its share of the whole text:
    bytes where the counter counts bytes, else the line's own tokens.
    """
    ts, message = F.col("ts_raw"), F.col("message")
    kept = ~F.col("excluded")
    if counter.of_bytes:  # no line is built only to be measured
        tokens = counter.of_bytes(budget_line_bytes(ts, message))
        size = log_line_bytes(ts, message)
    else:
        tokens = counter.of_text(budget_line(ts, message))
        size = counter.of_text(render_line(ts, message))
    return flagged.select(
        SOURCE, "name", "segment", "seq", "ts_raw", "run_len", "excluded",
        F.when(kept, message).alias("message"),
        F.when(kept, tokens).alias("tokens"),
        F.when(kept, size).alias("text_size"), *keep,
    )


def container_stats(priced: DataFrame) -> DataFrame:
    """Row counts before and after each step, in one partially aggregated pass."""
    return priced.groupBy(SOURCE, "name").agg(
        F.sum("run_len").alias("original_count"),
        F.count(F.lit(1)).alias("lines_total"),
        F.count_if("excluded").alias("lines_filtered"),
        F.count_if(~F.col("excluded")).alias("lines_kept"),
        F.coalesce(F.sum("text_size"), F.lit(0)).alias("text_size"),
    ).withColumns({
        "processed_count": F.col("lines_kept"),
        "deduplicated": F.col("lines_total") < F.col("original_count"),
    })


def with_instructions(containers: DataFrame, ignore: DataFrame | None) -> DataFrame:
    """Add ``instructions`` from ``ignore(file_stem, instructions)`` by storage name; else empty."""
    if ignore is None:
        return containers.withColumn("instructions", F.lit(""))
    named = ignore.select(F.col("file_stem").alias("_stem"), F.col("instructions").alias("_text"))
    return (containers.join(named, sanitize(F.col("name")) == F.col("_stem"), "left")
            .withColumn("instructions", F.coalesce("_text", F.lit(""))).drop("_stem", "_text"))


def budget(stats: DataFrame, counter: TokenCounter, max_tokens: int = MAX_TOKENS,
           prompts: P.Prompts = P.Prompts()) -> DataFrame:
    """Token sizes, strategy and chunk limit of each container (``stats`` with ``instructions``).

    Decided from sums, so no text is built for a container before it is known to fit. For a counter
    that does not count bytes, the whole text is taken as the sum of its lines.
    """
    base = P.analysis_prompt(prompts, F.col("name"), F.lit(""), F.col("processed_count"))
    text = counter.of_bytes(F.col("text_size")) if counter.of_bytes else F.col("text_size")
    sized = stats.withColumns({
        "system_tokens": counter.of_message(P.system_prompt(prompts, F.col("instructions"))),
        "base_tokens": counter.of_text(base),
        "logs_tokens": text.cast("long"),
    })
    total = F.col("system_tokens") + F.col("base_tokens") + F.col("logs_tokens")
    fits = total + RESPONSE_RESERVE <= max_tokens
    free = F.lit(max_tokens - RESPONSE_RESERVE).cast("long") - F.col("system_tokens")
    return sized.withColumns({
        "total_tokens": total,
        "strategy": F.when(fits, DIRECT).when(F.col("lines_kept") == 0, EMPTY).otherwise(CHUNKED),
        # toward zero; may be zero or less, which gives one line per chunk
        "chunk_limit": F.when(~fits, F.call_function("div", free, F.lit(CHUNK_DIVISOR))),
    })


def lines_to_pack(priced: DataFrame, limits: DataFrame | int) -> DataFrame:
    """Kept lines with their rendered text and their container's chunk limit.

    ``limits`` has a ``chunk_limit`` per container, or is one limit for all.
    """
    kept = priced.filter(~F.col("excluded"))
    if isinstance(limits, int):
        # not a bare literal, which Catalyst would move out of the shared shuffle of the packing
        limited = kept.withColumn("chunk_limit", F.when(F.col("tokens").isNotNull(), limits)
                                  .cast("long"))
    else:
        limited = kept.join(limits.select(SOURCE, "chunk_limit"), SOURCE)
    return limited.select(SOURCE, "name", "segment", "seq", "tokens", "chunk_limit",
                          render_line(F.col("ts_raw"), F.col("message")).alias("line"))
