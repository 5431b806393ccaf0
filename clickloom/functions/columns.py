"""Column expressions: event types, weights, item lists and keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegralType, StringType

from clickloom.schema import EVENT_TYPES


def known_type(col: Column, kind: DataType) -> Column:
    """The name of an event type, null where unknown. A number is a code, a string a name: "0" is no name."""
    if isinstance(kind, StringType):
        return F.when(col.isin(*EVENT_TYPES), col)
    out = F.when(col == 0, EVENT_TYPES[0])
    for code, name in list(enumerate(EVENT_TYPES))[1:]:
        out = out.when(col == code, name)
    return out


def normalize_type(col: Column, kind: DataType) -> Column:
    """The name of an event type. An unknown or null one fails the job when the row is met, and is named."""
    return F.coalesce(known_type(col, kind), F.raise_error(F.concat(F.lit("Unknown interaction types: "), F.coalesce(col.cast("string"), F.lit("null")))).cast("string"))


def type_weight(name: Column, weights: Mapping[str, int]) -> Column:
    """The integer weight of a type name."""
    out = F.when(name == EVENT_TYPES[0], F.lit(weights[EVENT_TYPES[0]]))
    for t in EVENT_TYPES[1:]:
        out = out.when(name == t, F.lit(weights[t]))
    return out.cast("int")


def parse_items(col: Column, kind: DataType) -> Column:
    """A list of ids. Null gives an empty list; a string is cut at white space, and what is no number fails; nulls
    and NaNs of an array are dropped; a single number is a list of one."""
    empty = F.array().cast("array<bigint>")
    if isinstance(kind, StringType):
        parts = F.filter(F.split(col, r"\s+"), lambda x: x != "")
        return F.coalesce(F.transform(parts, lambda x: x.cast("bigint")), empty)
    if isinstance(kind, ArrayType):
        kept = F.filter(col, lambda x: x.isNotNull())
        if isinstance(kind.elementType, (FloatType, DoubleType)):
            kept = F.filter(kept, lambda x: ~F.isnan(x))
        return F.coalesce(F.transform(kept, lambda x: x.cast("bigint")), empty)
    lone = F.when(col.isNull() if isinstance(kind, IntegralType) else col.isNull() | F.isnan(col), empty)
    return lone.otherwise(F.array(col.cast("bigint")))


def session_key(session: Column, kind: Column) -> Column:
    """session_type: the session cut to an integer, an underscore, the event type."""
    return F.concat(session.cast("bigint").cast("string"), F.lit("_"), kind)


def key_type(session_type: Column) -> Column:
    """What stands behind the last underscore; all of it where there is none."""
    return F.substring_index(session_type, "_", -1)


def join_items(items: Column) -> Column:
    """Ids as text, joined by spaces; an empty list is an empty string."""
    return F.array_join(items.cast("array<string>"), " ")


def sanitize_field(col: Column) -> Column:
    """Text that fits one CSV field: a line feed becomes a space, a comma a semicolon."""
    return F.translate(col, "\n,", " ;")
