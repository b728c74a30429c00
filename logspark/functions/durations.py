"""Duration parameters such as ``1h30m``."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of duration text, in microseconds.
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000,
         "m": 60_000_000, "h": 3_600_000_000}

_TERM = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """``1h30m`` and the like; the empty string is zero; anything else raises ``ValueError``."""
    body = text[1:] if text[:1] in "+-" else text
    if text == "" or body == "0":
        return timedelta(0)
    terms = _TERM.findall(body)
    if not terms or "".join(n + u for n, u in terms) != body:
        raise ValueError(f"invalid duration {text!r}")
    total = timedelta(microseconds=sum(float(n) * UNITS[u] for n, u in terms))
    return -total if text[0] == "-" else total


def duration_micros(text: Column) -> Column:
    """The microseconds of a duration text in a column; null for what is none."""
    number, unit = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)", "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
    body = F.regexp_replace(text, "^[+-]", "")
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in (pair[0], float(pair[1]))))
    terms = F.transform(F.regexp_extract_all(body, F.lit(number + unit), F.lit(0)), lambda term:
                        F.regexp_extract(term, number, 0).cast("double")
                        * F.element_at(units, F.regexp_replace(term, f"^{number}", "")))
    total = F.bround(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).cast("long")
    return (F.when((text == "") | (body == "0"), F.lit(0).cast("long"))
            .when(body.rlike(f"^(?:{number}{unit})+$"), F.when(text.startswith("-"), -total).otherwise(total)))
