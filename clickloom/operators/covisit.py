"""Item to item co-visitation inside sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from clickloom.operators.ranges import numbered
from clickloom.sources.shared import kept

TIES = ("aid", "type")
#: Pairs of one task, where they are dealt out to a number of parts.
PAIRS_A_TASK = 1_000_000


def session_order(ties: Sequence[str] = TIES, shard_col: str | None = None):
    """The window of a session: by time, ties by the columns named; with shard_col, of a session's rows in one file."""
    return Window.partitionBy("session", *([shard_col] if shard_col else [])).orderBy("ts", *ties)


def ordered_events(events: DataFrame, ties: Sequence[str] = TIES, longest: int | None = None) -> DataFrame:
    """events with their place in the session, from 1. Sessions of more than longest events are ordered by ranges."""
    whole = lambda df: df.withColumn("place", F.row_number().over(session_order(ties)).cast("bigint"))
    if not longest or (parts := _by_length(events, longest, ties, None)) is None:
        return whole(events)
    short, long = parts
    first = long.groupBy("session").agg((F.min("number") - 1).alias("before"))
    placed = long.join(first, "session").withColumn("place", F.col("number") - F.col("before"))
    return whole(short).unionByName(placed.select(*events.columns, "place"))


def _by_length(events: DataFrame, longest: int, ties: Sequence[str], shard_col: str | None) -> tuple[DataFrame, DataFrame] | None:
    """events of sessions of at most longest events, and those of longer ones with their number in the order of all of
    these; nothing where no session is longer.

    The latter are written to the shared folder, so that equal events keep their places. Equal ones may stand in any
    order, but are told apart, so that a range never holds more than its share.
    """
    by = ["session", *([shard_col] if shard_col else [])]
    long = kept(events.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > longest).select(*by))
    if long.isEmpty():
        return None
    rows = kept(events.join(long, by, "left_semi").withColumn("copy", F.monotonically_increasing_id()))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.join(long, by, "left_anti"), numbered(rows, [*by, "ts", *ties, "copy"], n).drop("copy")


def _lagged(events: DataFrame, lookback: int, keep: Sequence[str], window: WindowSpec) -> DataFrame:
    """The pairs of covisit_pairs inside a window. One window serves all lags."""
    before = [F.lag(F.struct(F.col("aid").alias("aid"), F.col("ts").alias("ts"), F.lit(i).alias("lag")), i).over(window) for i in range(1, lookback + 1)]
    lagged = events.select(F.col("aid").alias("aid_future"), *keep, *[b.alias(f"before_{i}") for i, b in enumerate(before)])
    past = F.explode(F.array_compact(F.array(*[f"before_{i}" for i in range(lookback)])))
    return lagged.select(past.alias("past"), "aid_future", *keep).select(F.col("past.aid").alias("aid_key"), "aid_future", F.col("past.ts").alias("key_ts"), F.col("past.lag").alias("lag"), *keep)


def covisit_pairs(events: DataFrame, lookback: int, keep: Sequence[str] = ("weight",), ties: Sequence[str] = TIES, shard_col: str | None = None, longest: int | None = None) -> DataFrame:
    """(aid_key, aid_future, key_ts, lag, and the current event's columns in keep) for each event and each of the
    lookback events before it in the session.

    Directed from past to future; pairs of one item with itself stay, and repeats count. A session of more than longest
    events is cut into stretches of as many (or of lookback, if that is more); each stretch also gets the last lookback
    events of the one before, which are keys of pairs there and nothing else. The pairs are the same either way.
    """
    if not longest or (parts := _by_length(events, longest, ties, shard_col)) is None:
        return _lagged(events, lookback, keep, session_order(ties, shard_col))
    short, long = parts
    size = max(longest, lookback)
    at, stretch = F.pmod(F.col("number") - 1, F.lit(size)), F.floor((F.col("number") - 1) / size)
    own, next_ = F.struct(stretch.alias("stretch"), F.lit(False).alias("halo")), F.struct((stretch + 1).alias("stretch"), F.lit(True).alias("halo"))
    dealt = long.withColumn("seat", F.explode(F.when(at >= size - lookback, F.array(own, next_)).otherwise(F.array(own)))).select("*", "seat.*").drop("seat")
    inside = Window.partitionBy("session", *([shard_col] if shard_col else []), "stretch").orderBy("number")
    more = _lagged(dealt, lookback, [*keep, "halo"], inside).where(~F.col("halo")).drop("halo")
    return _lagged(short, lookback, keep, session_order(ties, shard_col)).unionByName(more)


def parts_for(spark: SparkSession, n_events: int, lookback: int) -> int:
    """The parts that pairs of n_events events are dealt out to, so that a task has PAIRS_A_TASK of them however many
    events there are; fewer of them keep all cores busy."""
    return max(spark.sparkContext.defaultParallelism, -(-n_events * lookback // PAIRS_A_TASK))


def covisit_scores(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """(aid_key, aid_future, score). Pairs whose current event weighs 0 go here, after they have taken their places.

    Pairs are summed before the shuffle, and Spark packs partitions by their bytes; packed pairs are few, so that one task
    may hold many millions. With parts, for wide item spaces, whose pairs are nearly all distinct, they are dealt out as
    they are to that many partitions, which Spark does not pack, and summed there alone.
    """
    rows = pairs.where("weight <> 0").select("aid_key", "aid_future", "weight")
    dealt = rows.repartition(parts, "aid_key", "aid_future") if parts else rows
    return dealt.groupBy("aid_key", "aid_future").agg(F.sum("weight").cast("bigint").alias("score"))


def merge_scores(*parts: DataFrame) -> DataFrame:
    """Scores of parts of the log, added up: new shards join stored scores."""
    return reduce(DataFrame.unionByName, parts).groupBy("aid_key", "aid_future").agg(F.sum("score").cast("bigint").alias("score"))


def topk_per_key(scores: DataFrame, k: int, keys: Sequence[str] = ("aid_key",)) -> DataFrame:
    """scores with rank, the k best futures of each key, ties to the lesser item.

    The rank limit is pushed below the shuffle, so that a hot key sends k rows a task at most.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "aid_future")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def candidate_index(ranked: DataFrame, keys: Sequence[str] = ("aid_key",)) -> DataFrame:
    """(keys, candidates, scores): the best futures of each key, best first; keys without any have no row."""
    best = F.array_sort(F.collect_list(F.struct("rank", "aid_future", "score")))
    gathered = ranked.groupBy(*keys).agg(best.alias("best"))
    return gathered.select(*keys, F.col("best.aid_future").alias("candidates"), F.col("best.score").alias("scores"))
