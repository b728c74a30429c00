"""Token counting as an extension point: any pair of column functions is a counter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tokens a chat message costs beyond its text.
MESSAGE_OVERHEAD = 4


@dataclass(frozen=True)
class TokenCounter:
    """``of_text`` counts a text column.

    ``of_bytes`` counts from a byte length and is given when the count depends on nothing else; the
    size of a long text is then known exactly from summed lengths, without building the text.
    """

    of_text: Callable[[Column], Column]
    of_bytes: Callable[[Column], Column] | None = None

    def of_message(self, text: Column) -> Column:
        return self.of_text(text) + F.lit(MESSAGE_OVERHEAD)

    def fits(self, text: Column, max_tokens: int) -> Column:
        return self.of_text(text) <= F.lit(max_tokens)


def byte_tokens(per_byte: float = 0.25) -> TokenCounter:
    """``floor(bytes * per_byte)`` tokens, entirely inside the JVM."""
    def of_bytes(n: Column) -> Column:
        return F.floor(n * F.lit(float(per_byte))).cast("long")

    return TokenCounter(lambda t: of_bytes(F.octet_length(t).cast("long")), of_bytes)
