"""From raw events to weighted ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import known_type, normalize_type, type_weight
from clickloom.schema import DAY_MS, RECENT_DAYS


#: Unknown types that an error message names.
NAMED = 100


def with_keys(events: DataFrame) -> DataFrame:
    """Events whose session, item and time are known: nulls would all meet in one window."""
    return events.where("session IS NOT NULL AND aid IS NOT NULL AND ts IS NOT NULL")


def recent_threshold(events: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """One row, threshold: the latest time of all rows, also of those without an item, less some days; null for no events."""
    return events.agg((F.max("ts") - days * DAY_MS).alias("threshold"))


def filter_recent(events: DataFrame, threshold: int | Column) -> DataFrame:
    """Events after the threshold; one at it goes."""
    return events.where(F.col("ts") > threshold)


def unknown_types(events: DataFrame) -> DataFrame:
    """The distinct event types that are no known ones, as text, sorted; null counts as null."""
    kind = events.schema["type"].dataType
    return events.where(known_type(F.col("type"), kind).isNull()).select(F.coalesce(F.col("type").cast("string"), F.lit("null")).alias("type")).distinct().orderBy("type")


def check_types(events: DataFrame) -> DataFrame:
    """events; an unknown type is an error that tells how many there are, and names the first NAMED of them in order.

    The message alone is short; unknown_types has all of them.
    """
    unknown = unknown_types(events)
    n = unknown.count()
    if n:
        found = [r["type"] for r in unknown.limit(NAMED).collect()]
        raise ValueError(f"Unknown interaction types: {found}" + (f" and {n - NAMED} more" if n > NAMED else ""))
    return events


def with_type_names(events: DataFrame) -> DataFrame:
    return events.withColumn("type", normalize_type(F.col("type"), events.schema["type"].dataType))


def with_weight(events: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """events with the weight of their own type; it may be 0."""
    return events.withColumn("weight", type_weight(F.col("type"), weights))


def prepare(events: DataFrame, weights: Mapping[str, int], threshold: int | Column | None = None) -> DataFrame:
    """Known keys, then recency, then types and weights, in this order."""
    events = with_keys(events)
    events = events if threshold is None else filter_recent(events, threshold)
    return with_weight(with_type_names(events), weights)
