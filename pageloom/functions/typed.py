"""Values of any type, and what they are taken as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What schema_of_variant() calls values of each type.
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN"}


def kind_of(value: Column) -> Column:
    """The type of a VARIANT's value: one of KINDS, or what it is otherwise; null if there is no value."""
    return F.schema_of_variant(value)


def extract_as(value: Column, kind: str) -> Column:
    """Struct (value, ok): the value of a VARIANT if it is of that very type; no type is cast to another."""
    if kind not in KINDS:
        raise ValueError(f"unsupported type: {kind}")
    ok = F.coalesce(kind_of(value) == KINDS[kind], F.lit(False))
    return F.struct(F.when(ok, F.try_variant_get(value, "$", kind)).alias("value"), ok.alias("ok"))


def mismatch(value: Column, kind: str, context: str = "") -> Column:
    """What must_extract_as() would say of a value; null if it is of the type."""
    said = F.concat(F.lit(f"{context}: " if context else ""), F.lit(f"expected type {kind}, got "), F.coalesce(F.lower(kind_of(value)), F.lit("nothing")))
    return F.when(~extract_as(value, kind)["ok"], said)


def must_extract_as(value: Column, kind: str, context: str = "") -> Column:
    """The value of a VARIANT of that very type; any other fails the job with a message that names both types."""
    said = mismatch(value, kind, context)
    return F.when(said.isNotNull(), F.raise_error(said)).otherwise(extract_as(value, kind)["value"])
