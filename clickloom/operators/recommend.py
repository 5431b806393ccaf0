"""From a session's history and the candidate index to recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.columns import join_items, session_key
from clickloom.schema import EVENT_TYPES, TOP_ITEMS


def recent_items(events: DataFrame, topk: int = TOP_ITEMS, ties: Sequence[str] = ("aid",)) -> DataFrame:
    """(session, recent_aids): a session's items by their latest event, the newest first, each once, topk at most.

    Items are made distinct before anything is gathered, so that a long session is cut early.
    """
    last = F.max(F.struct("ts", *ties)).alias("last")
    newest = Window.partitionBy("session").orderBy(F.desc("last"))
    ranked = events.groupBy("session", "aid").agg(last).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= topk)
    return ranked.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("items")).select("session", F.col("items.aid").alias("recent_aids"))


def with_seed(recent: DataFrame) -> DataFrame:
    """recent with aid_key, the newest item, null for none."""
    return recent.withColumn("aid_key", F.get("recent_aids", F.lit(0)))


def predict(recent: DataFrame, index: DataFrame, topk: int = TOP_ITEMS, by: Sequence[str] = ()) -> DataFrame:
    """(by, session, items): the candidates of the newest item, then the history, each item once, topk at most.

    by: columns of both sides, such as a variant, that must agree. recent may have its newest item as aid_key already, as
    rows stored in buckets by it do; against an index in as many buckets the join then moves nothing. Without history there are no items; without
    candidates there is the history alone. The index is cut to topk before the join; Spark decides at run time
    whether it is small enough to be broadcast.
    """
    seeds = recent if "aid_key" in recent.columns else with_seed(recent)
    short = index.select(*by, "aid_key", F.slice("candidates", 1, topk).alias("candidates"))
    joined = seeds.join(short, [*by, "aid_key"], "left")
    items = F.concat(F.coalesce("candidates", F.array().cast("array<bigint>")), F.coalesce("recent_aids", F.array().cast("array<bigint>")))
    return joined.select(*by, "session", F.slice(F.array_distinct(items), 1, topk).alias("items"))


def submission(predictions: DataFrame, by: Sequence[str] = (), order: bool = False) -> DataFrame:
    """(by, session_type, labels): each session's items as text, once for each event type.

    With order also session and turn, the place of the event type, by which rows are written in order.
    """
    kind = F.posexplode(F.array(*[F.lit(t) for t in EVENT_TYPES])).alias("turn", "kind")
    rows = predictions.select(*by, "session", join_items(F.col("items")).alias("labels"), kind)
    return rows.select(*by, *(["session", "turn"] if order else []), session_key(F.col("session"), F.col("kind")).alias("session_type"), "labels")
