"""Candidates of several recall sources in one table, and rows to train a ranker on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuse(sources: Mapping[str, DataFrame]) -> DataFrame:
    """(session, aid, best_score, n_sources, sources) from tables (session, aid, score) by source name.

    sources: the distinct names, sorted and comma-joined.
    """
    tagged = [df.select("session", "aid", F.col("score").cast("double").alias("score"), F.lit(name).alias("source")) for name, df in sources.items()]
    return fuse_rows(reduce(DataFrame.unionByName, tagged))


def fuse_rows(rows: DataFrame) -> DataFrame:
    """fuse for one table (source, session, aid, score)."""
    names = F.array_sort(F.collect_set("source"))
    return rows.groupBy("session", "aid").agg(F.max("score").alias("best_score"), F.size(F.collect_set("source")).cast("bigint").alias("n_sources"), F.array_join(names, ",").alias("sources"))


def predictions_as_candidates(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, session, aid, score) from recommendation lists: the score falls from 1 with the place."""
    placed = predictions.select(*by, "session", F.posexplode("items").alias("place", "aid"))
    return placed.select(*by, "session", "aid", (F.lit(1.0) / (F.col("place") + 1)).alias("score"))


def ranker_rows(candidates: DataFrame, labels: DataFrame, event_types: tuple[str, ...]) -> DataFrame:
    """Candidates once for each event type, with label 1 where the item is true for the session and type, else 0.

    labels: (session_type, items).
    """
    kind = F.explode(F.array(*[F.lit(t) for t in event_types])).alias("type")
    each = candidates.select("*", kind).withColumn("session_type", F.concat_ws("_", F.col("session").cast("string"), "type"))
    true = labels.select("session_type", F.explode(F.array_distinct("items")).alias("aid")).withColumn("hit", F.lit(1))
    return each.join(true, ["session_type", "aid"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit", "session_type")
