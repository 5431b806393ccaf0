"""Order over a whole table without one task that holds it: ranges of keys, places in them, and what lies before each."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


#: Types of which text is not taken for exact.
_INEXACT = r"double|float|decimal|timestamp|date|binary|boolean|interval|variant|array|map"


def _literal(value: object) -> Column:
    return F.struct(*[_literal(v).alias(k) for k, v in value.asDict().items()]) if isinstance(value, Row) else F.lit(value)


@dataclass(frozen=True)
class Ranges:
    """Ranges of rising keys, one after the other: the least key of each, and how many rows come before it."""

    keys: tuple[str, ...]
    types: tuple[str, ...]
    starts: tuple[Row, ...]
    before: tuple[int, ...]

    def __len__(self) -> int:
        return len(self.starts)

    def key(self) -> Column:
        return F.struct(*[F.col(k).cast(t).alias(k) for k, t in zip(self.keys, self.types, strict=True)])

    def _firsts(self) -> Column:
        """The least keys, as one constant. As text, where that is exact, so that thousands of ranges are one literal."""
        if all(re.fullmatch(r"(tinyint|smallint|int|bigint|string|struct<|>|[:,\w])+", t) and not re.search(_INEXACT, t) for t in self.types):
            told = json.dumps([row.asDict(recursive=True) for row in self.starts])
            fields = ",".join(f"`{k}`:{t}" for k, t in zip(self.keys, self.types, strict=True))
            return F.from_json(F.lit(told), f"array<struct<{fields}>>")
        return F.array(*[F.struct(*[_literal(v).cast(t).alias(k) for k, t, v in zip(self.keys, self.types, row, strict=True)]) for row in self.starts])

    def range_of(self) -> Column:
        """The number of a row's range, from 0, by bisection; -1 below the first one. Nulls come first."""
        if not self.starts:
            return F.lit(-1)
        firsts, own = self._firsts(), self.key()
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(firsts, at + step - 1) <= own, F.lit(False)), at + step).otherwise(at)) - 1

    def is_first(self, number: Column) -> Column:
        """Whether a row is the least of range number, its own."""
        return F.coalesce(F.get(self._firsts(), number) == self.key(), F.lit(False)) if self.starts else F.lit(False)

    def rows_before(self, number: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.before)).cast("array<bigint>"), number) if self.before else F.lit(None).cast("bigint")


def ranges(rows: DataFrame, keys: Sequence[str], n: int) -> Ranges:
    """At most n ranges of about as many rows each. Only the keys are moved; n rows reach the driver.

    Rows of equal keys stay together, so that keys should tell rows apart where one key may be hot.
    """
    dealt = rows.select(*keys).repartitionByRange(n, *keys)
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*keys)).alias("start"), F.count("*").alias("n")).collect()
    before, starts, total = [], [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        starts.append(r["start"])
        before.append(total)
        total += r["n"]
    return Ranges(tuple(keys), tuple(rows.schema[k].dataType.simpleString() for k in keys), tuple(starts), tuple(before))


def numbered(rows: DataFrame, keys: Sequence[str], n: int, name: str = "number") -> DataFrame:
    """rows with their place in the order of keys, from 1. rows are read twice and should come the same each time."""
    found = ranges(rows, keys, n)
    if not len(found):
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    part = f"{name}_range"
    placed = rows.withColumn(part, found.range_of())
    own = F.row_number().over(Window.partitionBy(part).orderBy(*keys)).cast("bigint")
    return placed.withColumn(name, own + found.rows_before(F.col(part))).drop(part)
