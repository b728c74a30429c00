"""Values of JSON whose shape is not known beforehand, out of VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: Column, path: str) -> Column:
    """What stands at ``path``, as a variant; NULL where nothing does, or the way there is no object."""
    return F.try_variant_get(value, path, "variant")


def shape(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BOOLEAN``, ``VOID`` (JSON's null) or a kind of number."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.coalesce(shape(value) == "OBJECT", F.lit(False))


def present(value: Column) -> Column:
    """Whether there is a value other than JSON's null."""
    return F.coalesce(shape(value) != "VOID", F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """A JSON string; NULL for every other type."""
    found = at(value, path)
    return F.when(shape(found) == "STRING", F.try_variant_get(found, "$", "string"))


def integer_at(value: Column, path: str) -> Column:
    """A whole number, given as a number or as a string of one; NULL otherwise."""
    found = at(value, path)
    return F.when(shape(found) != "BOOLEAN", F.try_variant_get(found, "$", "bigint"))


def list_at(value: Column, path: str) -> Column:
    """The elements of a JSON array, as variants; NULL for every other type."""
    return F.try_variant_get(value, path, "array<variant>")
