"""All named variants at once, and their leaderboard."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.columns import type_weight
from clickloom.operators import covisit, evaluate, prepare, recommend
from clickloom.schema import TOP_ITEMS, VARIANTS, Variant


def direct_scores(events: DataFrame, v: Variant, threshold: int | Column | None = None, shard_col: str | None = None, ties: Sequence[str] = covisit.TIES, longest: int | None = None, parts: int | None = None) -> DataFrame:
    """Scores of one variant. Where it wants recent events alone and no threshold is given, it is found from all rows of
    events, those without an item too. With shard_col, events pair inside one file only; ties order events of one time;
    sessions of more than longest events are cut, which changes no score; parts is as in covisit_scores."""
    if v.recent and threshold is None:
        threshold = prepare.recent_threshold(events).scalar()
    ready = prepare.prepare(events, v.weights, threshold if v.recent else None)
    return covisit.covisit_scores(covisit.covisit_pairs(ready, v.lookback, ties=ties, shard_col=shard_col, longest=longest), parts)


def _sums(variants: Iterable[Variant]) -> dict[tuple, str]:
    """The name of the sum of each weights, lookback and recency that variants have: equal ones share a sum."""
    out: dict[tuple, str] = {}
    for v in variants:
        out.setdefault(_sum_key(v), f"s{len(out)}")
    return out


def _sum_key(v: Variant) -> tuple:
    return v.clicks, v.carts, v.orders, v.lookback, v.recent


def shared_scores(events: DataFrame, variants: Iterable[Variant], threshold: int | Column | None = None, shard_col: str | None = None, ties: Sequence[str] = covisit.TIES, longest: int | None = None) -> DataFrame:
    """(aid_key, aid_future, and a column for each sum that variants have) from one scan, one window and one aggregation.

    Pairs of a short lookback are those of the longest at a small lag; dropping old events before pairing is keeping
    pairs whose key is recent, as time orders a session. Each sum is conditional, beside the others, and not a row:
    most pairs of a wide item space are distinct, and rows would multiply the shuffle. A sum is null just where its
    variants have no pair. With shard_col, events pair inside one file only; ties and longest are as in direct_scores.
    """
    variants = list(variants)
    recent = any(v.recent for v in variants)
    if recent and threshold is None:
        threshold = prepare.recent_threshold(events).scalar()
    ready = prepare.with_type_names(prepare.with_keys(events))
    pairs = covisit.covisit_pairs(ready, max(v.lookback for v in variants), keep=("type",), ties=ties, shard_col=shard_col, longest=longest)
    if recent:
        pairs = pairs.withColumn("is_recent", F.col("key_ts") > threshold)
    sums = []
    for (clicks, carts, orders, lookback, late), name in _sums(variants).items():
        weight = type_weight(F.col("type"), {"clicks": clicks, "carts": carts, "orders": orders})
        use = (F.col("lag") <= lookback) & (weight != 0)
        use = use & F.col("is_recent") if late else use
        sums.append(F.sum(F.when(use, weight)).cast("bigint").alias(name))
    return pairs.groupBy("aid_key", "aid_future").agg(*sums)


def folded_scores(events: DataFrame, variants: Iterable[Variant] = VARIANTS.values(), threshold: int | Column | None = None, shard_col: str | None = None, ties: Sequence[str] = covisit.TIES, longest: int | None = None) -> DataFrame:
    """(variant, aid_key, aid_future, score) of all variants: shared_scores with a row for each variant."""
    variants = list(variants)
    wide, sums = shared_scores(events, variants, threshold, shard_col, ties, longest), _sums(variants)
    rows = F.array(*[F.struct(F.lit(v.name).alias("variant"), F.col(sums[_sum_key(v)]).alias("score")) for v in variants])
    return wide.select(F.explode(rows).alias("r"), "aid_key", "aid_future").select("r.variant", "aid_key", "aid_future", "r.score").where("score IS NOT NULL")


def _ranked(scores: DataFrame, variants: list[Variant]) -> DataFrame:
    """scores with rank, each variant's own number of candidates."""
    own = F.lit(0)
    for v in variants:
        own = F.when(F.col("variant") == v.name, v.topk).otherwise(own)
    best = Window.partitionBy("variant", "aid_key").orderBy(F.desc("score"), "aid_future")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(v.topk for v in variants)).where(F.col("rank") <= own)


def folded_index(scores: DataFrame, variants: Iterable[Variant] = VARIANTS.values()) -> DataFrame:
    """(variant, aid_key, candidates, scores), each variant with its own number of candidates."""
    return covisit.candidate_index(_ranked(scores, list(variants)), ("variant", "aid_key"))


def wide_index(scores: DataFrame, variants: Iterable[Variant] = VARIANTS.values(), topk: int = TOP_ITEMS) -> DataFrame:
    """(aid_key, and for each variant a column of that name): candidates of all variants side by side, topk at most.

    scores: shared_scores of these variants. Each sum is ranked once, however many variants have it.
    """
    variants, of = list(variants), lambda v: min(v.topk, topk)
    sums = _sums(variants)
    most = {name: max(of(v) for v in variants if sums[_sum_key(v)] == name) for name in sums.values()}
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("sum"), F.col(name).alias("score")) for name in most])).alias("r")
    long = scores.select(rows, "aid_key", "aid_future").select("r.sum", "aid_key", "aid_future", "r.score").where("score IS NOT NULL")
    best = Window.partitionBy("sum", "aid_key").orderBy(F.desc("score"), "aid_future")
    ranked = long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(most.values()))
    one = lambda name: F.array_sort(F.collect_list(F.when(F.col("sum") == name, F.struct("rank", "aid_future"))))["aid_future"].alias(name)
    lists = ranked.groupBy("aid_key").agg(*[one(name) for name in most])
    return lists.select("aid_key", *[F.slice(sums[_sum_key(v)], 1, of(v)).alias(v.name) for v in variants])


def _listed(sessions: DataFrame, history: DataFrame, variants: list[Variant], topk: int, threshold: int | Column | None, longest: int | None) -> DataFrame:
    """sessions (with recent_aids), and for each variant a column of that name: what it recommends."""
    index = wide_index(shared_scores(history, variants, threshold, longest=longest), variants, topk)
    joined = sessions.withColumn("aid_key", F.get("recent_aids", F.lit(0))).join(index, "aid_key", "left")
    none = F.array().cast("array<bigint>")
    lists = {v.name: F.slice(F.array_distinct(F.concat(F.coalesce(v.name, none), F.coalesce("recent_aids", none))), 1, topk) for v in variants}
    return joined.withColumns(lists).drop("aid_key")


def sweep(history: DataFrame, variants: Iterable[Variant] = VARIANTS.values(), topk: int = TOP_ITEMS, threshold: int | Column | None = None, longest: int | None = None) -> DataFrame:
    """(variant, session, items): recommendations of every variant for every session of history."""
    variants = list(variants)
    found = _listed(recommend.recent_items(prepare.with_keys(history), topk), history, variants, topk, threshold, longest)
    rows = F.explode(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.col(v.name).alias("items")) for v in variants])).alias("r")
    return found.select("session", rows).select("r.variant", "session", "r.items")


def leaderboard(history: DataFrame, labels: DataFrame, variants: Iterable[Variant] = VARIANTS.values(), topk: int = TOP_ITEMS, threshold: int | Column | None = None, longest: int | None = None) -> DataFrame:
    """(variant, overall_recall) of the recommendations from history against labels (session_type, items).

    A session is one row throughout: its true items by type and its recent items meet by session, then the candidates
    of all variants by its newest item; each variant's hits are sums beside the others.
    """
    variants = list(variants)
    truth = evaluate.truth_by_session(labels)
    sessions = truth.join(recommend.recent_items(prepare.with_keys(history), topk), "session", "left")
    names = [v.name for v in variants]
    return evaluate.overall_recall(evaluate.recall_of_lists(_listed(sessions, history, variants, topk, threshold, longest), names, "variant"), by=("variant",))
