"""Type-weighted recall at 20."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.columns import key_type, parse_items, session_key
from clickloom.schema import EVENT_TYPES, RECALL_WEIGHTS, TOP_ITEMS


def _normalized(table: DataFrame, column: str, order_col: str | None, by: Sequence[str]) -> DataFrame:
    names = set(table.columns)
    if not ({"session_type", column} <= names or {"session", "type", column} <= names):
        raise ValueError(f"need session_type and {column}, or session, type and {column}; found {table.columns}")
    key = F.col("session_type").cast("string") if "session_type" in names else session_key(F.col("session"), F.col("type"))
    out = table.select(*by, key.alias("session_type"), parse_items(F.col(column), table.schema[column].dataType).alias("items"), *([order_col] if order_col else []))
    if order_col:
        return out.groupBy(*by, "session_type").agg(F.max_by("items", order_col).alias("items"))
    one = Window.partitionBy(*by, "session_type")
    lone = F.when(F.count("*").over(one) == 1, F.col("items")).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), F.coalesce("session_type", F.lit("null")))).cast("array<bigint>"))
    return out.withColumn("items", lone)


def normalize_predictions(table: DataFrame, order_col: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, session_type, items): the first 20 items before repeats go, so that repeats waste places.

    Either layout is accepted, session_type first; others are an error. Of rows with one key the last by order_col
    stays; without order_col a repeated key is an error.
    """
    return _normalized(table, "labels", order_col, by).withColumn("items", F.slice("items", 1, TOP_ITEMS))


def normalize_labels(table: DataFrame, order_col: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, session_type, items) of the true items, all of them."""
    return _normalized(table, "ground_truth", order_col, by)


def recall_by_type(predictions: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, event_type, hits, targets, rows, weight, recall), all three types always.

    hits: distinct predicted items among the true ones; targets: all true items, repeats too; a label without a
    prediction has no hit; predictions without a label and labels of other types do not count. With by, both sides
    have these columns, and every group of labels that has a row of a known type is reported.
    """
    none = F.array().cast("array<bigint>")
    truth = labels.select(*by, "session_type", F.coalesce("items", none).alias("truth"), key_type(F.col("session_type")).alias("event_type"))
    truth = truth.where(F.col("event_type").isin(*EVENT_TYPES))
    guess = predictions.select(*by, "session_type", F.slice(F.coalesce("items", none), 1, TOP_ITEMS).alias("guess"))
    both = truth.join(guess, [*by, "session_type"], "left")
    hits = F.size(F.array_intersect(F.coalesce("guess", none), F.col("truth"))).cast("bigint")
    # one row for each group: the three types side by side, so that a type without labels still shows
    wide = both.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_type") == t, x)), F.lit(0)).cast("bigint").alias(f"{t}_{name}")
            for t in EVENT_TYPES
            for name, x in (("hits", hits), ("targets", F.size("truth").cast("bigint")), ("rows", F.lit(1)))
        ]
    )
    kinds = F.array(
        *[
            F.struct(F.lit(t).alias("event_type"), *[F.col(f"{t}_{x}").alias(x) for x in ("hits", "targets", "rows")], F.lit(RECALL_WEIGHTS[t]).alias("weight"))
            for t in EVENT_TYPES
        ]
    )
    long = wide.select(*by, F.explode(kinds).alias("k")).select(*by, "k.*")
    return long.withColumn("recall", F.when(F.col("targets") > 0, F.col("hits") / F.col("targets")).otherwise(F.lit(0.0)))


def truth_by_session(labels: DataFrame) -> DataFrame:
    """(session, clicks, carts, orders): the true items of a session by type, null without a label of that type, from
    labels (session_type, items). session: what stands before the last underscore, null where that is no number;
    such labels stay rows of their own."""
    kind = key_type(F.col("session_type"))
    own = F.expr("try_cast(left(session_type, length(session_type) - length(substring_index(session_type, '_', -1)) - 1) AS bigint)")
    known = labels.select(own.alias("session"), kind.alias("kind"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.when(own.isNull(), F.col("session_type")).alias("odd"))
    return known.where(F.col("kind").isin(*EVENT_TYPES)).groupBy("session", "odd").agg(*[F.max(F.when(F.col("kind") == t, F.col("items"))).alias(t) for t in EVENT_TYPES]).drop("odd")


def recall_of_lists(both: DataFrame, lists: Sequence[str], name: str) -> DataFrame:
    """(name, event_type, hits, targets, rows, weight, recall) of several predictions at once.

    both: a row for each session of truth_by_session, with a column of predicted items for each of lists, null for
    none. All hits are sums side by side in one aggregation, so that no row is repeated by type or by list.
    """
    none = F.array().cast("array<bigint>")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    sums = [total(F.size(F.coalesce(t, none))).alias(f"{t}_targets") for t in EVENT_TYPES] + [total(F.when(F.col(t).isNotNull(), 1)).alias(f"{t}_rows") for t in EVENT_TYPES]
    for k, c in enumerate(lists):
        guess = F.slice(F.coalesce(c, none), 1, TOP_ITEMS)
        sums += [total(F.size(F.array_intersect(guess, F.coalesce(t, none)))).alias(f"{t}_hits_{k}") for t in EVENT_TYPES]
    kinds = F.array(
        *[
            F.struct(F.lit(c).alias(name), F.lit(t).alias("event_type"), F.col(f"{t}_hits_{k}").alias("hits"), F.col(f"{t}_targets").alias("targets"), F.col(f"{t}_rows").alias("rows"), F.lit(RECALL_WEIGHTS[t]).alias("weight"))
            for k, c in enumerate(lists)
            for t in EVENT_TYPES
        ]
    )
    long = both.agg(*sums).select(F.explode(kinds).alias("k")).select("k.*")
    return long.withColumn("recall", F.when(F.col("targets") > 0, F.col("hits") / F.col("targets")).otherwise(F.lit(0.0)))


def overall_recall(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, overall_recall): the weighted sum of the three recalls, added in the order of the types."""
    one = metrics.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("event_type") == t, F.col("recall"))), F.lit(0.0)).alias(t) for t in EVENT_TYPES])
    total = F.lit(RECALL_WEIGHTS["clicks"]) * F.col("clicks") + F.lit(RECALL_WEIGHTS["carts"]) * F.col("carts") + F.lit(RECALL_WEIGHTS["orders"]) * F.col("orders")
    return one.select(*by, total.alias("overall_recall"))
