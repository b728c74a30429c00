"""Raw log lines to fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stream name given to parsed lines, frame header length, frame stream ids.
STDOUT = "stdout"
FRAME_HEADER_BYTES = 8
FRAME_STREAMS = {1: "stdout", 2: "stderr"}

_RFC3339 = (r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):\d{2}:\d{2}(?:[.,]\d+)?"
            r"(?:Z|[+-]\d{2}:[0-5]\d)\z")


def _framed(line: Column) -> Column:
    first = F.substring(line.cast("binary"), 1, 1)
    return (F.octet_length(line) > FRAME_HEADER_BYTES) & first.isin(
        *[F.unhex(F.lit(f"{sid:02x}")) for sid in FRAME_STREAMS]
    )


def strip_frame_header(line: Column) -> Column:
    """Drop the 8-byte multiplexing header of a line longer than 8 bytes that starts with 1 or 2."""
    rest = F.substring(line.cast("binary"), FRAME_HEADER_BYTES + 1, 2**31 - 1).cast("string")
    return F.when(_framed(line), rest).otherwise(line)


def frame_stream(line: Column) -> Column:
    """The stream named by the frame header, NULL for an unframed line."""
    first = F.hex(F.substring(line.cast("binary"), 1, 1))
    name = F.lit(None).cast("string")
    for sid, stream in FRAME_STREAMS.items():
        name = F.when(first == f"{sid:02X}", stream).otherwise(name)
    return F.when(_framed(line), name)


def line_timestamp(line: Column) -> Column:
    """Text before the first space; empty without a space."""
    at = F.instr(line, " ")
    return F.when(at > 0, F.substr(line, F.lit(1), at - 1)).otherwise(F.lit(""))


def line_message(line: Column) -> Column:
    """Text after the first space; the whole line without a space."""
    at = F.instr(line, " ")
    return F.when(at > 0, F.substr(line, at + 1)).otherwise(line)


def rfc3339(text: Column) -> Column:
    """RFC 3339 text, with or without a fraction, as a UTC ``timestamp_ntz``; NULL when malformed.

    Built from the local part and the offset, so it does not depend on the session time zone.
    Digits beyond microseconds are dropped.
    """
    n = F.char_length(text)
    utc = text.endswith("Z")
    clock = F.substr(text, F.lit(1), F.when(utc, n - 1).otherwise(n - 6))
    local = F.left(F.replace(clock, F.lit(","), F.lit(".")), F.lit(26)).try_cast("timestamp_ntz")
    sign = F.when(F.substr(text, n - 5, F.lit(1)) == "-", -1).otherwise(1)
    hours = F.substr(text, n - 4, F.lit(2)).try_cast("int") * sign
    minutes = F.right(text, F.lit(2)).try_cast("int") * sign
    shifted = local - F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))
    return F.when(text.rlike(_RFC3339), F.when(utc, local).otherwise(shifted))
