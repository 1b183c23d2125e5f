"""Metadata of events by type: a number that was written as text is no number, and a number is no text.

typed() parses an event's JSON once, into a variant; the getters read from it. What isn't there, is of another kind, or lies in metadata that isn't JSON is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = "_metadata_parsed"


def typed(events: DataFrame) -> DataFrame:
    """events with their metadata parsed; the column goes with the next select."""
    return events.withColumn(PARSED, F.try_parse_json("metadata"))


def _get(name: str, kind: str, source: Column | None) -> Column:
    return F.try_variant_get(F.col(PARSED) if source is None else F.try_parse_json(source), f"$.{name}", kind)


def _kind(name: str, source: Column | None = None) -> Column:
    return F.schema_of_variant(_get(name, "variant", source))


def text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _get(name, "string", None))


def number(name: str, source: Column | None = None) -> Column:
    """As a double. source: JSON text to read it from, where it is the only thing wanted of an event."""
    return F.when(F.rlike(_kind(name, source), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), _get(name, "double", source))


def shown(value: Column) -> Column:
    """A number as people write it: whole ones without a point."""
    whole = value.cast("decimal(38,0)")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))
