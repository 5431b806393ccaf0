"""The registered queries of the session library, and DuckDB SQL that says the same another way.

The SQL pairs events by a self-join on row numbers where the library uses lags, and orders lists by row numbers where
it uses arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.columns import join_items
from clickloom.jobs import run, sinks, upkeep
from clickloom.jobs.sinks import ledger_rows as as_ledger
from clickloom.operators import covisit, evaluate, fuse, prepare, recommend, sweep
from clickloom.operators.ranges import numbered
from clickloom.schema import EVENT_TYPES, RECALL_WEIGHTS, VARIANTS, variant
from clickloom.sources.events import events_as_sessions, fingerprint, orders_as_sessions, read_events, read_table, shard_fingerprints
from clickloom.sources.shared import fresh_folder

#: Between history and truth in the evaluation queries: 2024-01-21, in ms.
CUT = 1_705_795_200_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_sessions(_table(spark, sf_dir, "events"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_sessions(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"))


def _line_scores(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scores of one variant from order lines, whose item space is wide: their number, from footers, tells the parts."""
    v = variant(name)
    parts = covisit.parts_for(spark, _table(spark, sf_dir, "lineitem").count(), v.lookback)
    return sweep.direct_scores(_lines(spark, sf_dir), v, parts=parts)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(F.col("ts") < CUT)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the second layout: the distinct items of each session and type after the cut."""
    after = _events(spark, sf_dir).where(F.col("ts") >= CUT)
    return after.groupBy("session", "type").agg(F.array_sort(F.collect_set("aid")).alias("ground_truth"))


def _direct(events: DataFrame, name: str) -> DataFrame:
    return sweep.direct_scores(events, variant(name))


def _index(events: DataFrame, name: str = "base") -> DataFrame:
    return covisit.candidate_index(covisit.topk_per_key(_direct(events, name), variant(name).topk))


def _predictions(history: DataFrame, all_events: DataFrame) -> DataFrame:
    return recommend.predict(recommend.recent_items(history), _index(all_events))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.unknown_types(_table(spark, sf_dir, "events").select(F.col("event_type").alias("type")))


def type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare.prepare(_events(spark, sf_dir), variant("base").weights)
    return ready.groupBy("type", "weight").agg(F.count("*").alias("n"))


def recent_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.recent_threshold(_events(spark, sf_dir))


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return prepare.filter_recent(events, prepare.recent_threshold(events).scalar())


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covisit.ordered_events(_events(spark, sf_dir))


def covisit_pairs_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare.prepare(_events(spark, sf_dir), variant("base").weights)
    return covisit.covisit_pairs(ready, 2).withColumn("lag", F.col("lag").cast("bigint"))


def _scores(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _direct(_events(spark, sf_dir), name)


def covisit_scores_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_scores(spark, sf_dir, "base")


def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    parts = [_direct(events.where(F.pmod("session", F.lit(3)) == k), "base") for k in range(3)]
    return covisit.merge_scores(*parts)


def covisit_topk_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covisit.topk_per_key(_line_scores(spark, sf_dir, "v14"), 100).withColumn("rank", F.col("rank").cast("bigint"))


def covisit_topk_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covisit.topk_per_key(_line_scores(spark, sf_dir, "v19"), 300).withColumn("rank", F.col("rank").cast("bigint"))


def candidate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(_events(spark, sf_dir)).select("aid_key", join_items(F.col("candidates")).alias("candidates"), join_items(F.col("scores")).alias("scores"))


def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recent_items(_events(spark, sf_dir)).select("session", join_items(F.col("recent_aids")).alias("recent_aids"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return _predictions(events, events).select("session", join_items(F.col("items")).alias("labels"))


def predictions_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = covisit.topk_per_key(_line_scores(spark, sf_dir, "base"), variant("base").topk)
    found = recommend.predict(recommend.recent_items(_lines(spark, sf_dir)), covisit.candidate_index(ranked))
    return found.select("session", join_items(F.col("items")).alias("labels"))


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return recommend.submission(_predictions(events, events))


def normalized_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    rows = evaluate.normalize_predictions(recommend.submission(_predictions(history, history)))
    return rows.select("session_type", join_items(F.col("items")).alias("items"))


def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.normalize_labels(_truth(spark, sf_dir))
    return rows.select("session_type", join_items(F.col("items")).alias("items"))


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    guess = evaluate.normalize_predictions(recommend.submission(_predictions(history, history)))
    return evaluate.recall_by_type(guess, evaluate.normalize_labels(_truth(spark, sf_dir)))


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir)


def overall_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overall_recall(_recall(spark, sf_dir))


def variant_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.leaderboard(_history(spark, sf_dir), evaluate.normalize_labels(_truth(spark, sf_dir)))


def sweep_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of three variants, which differ in weights, lookback and recency."""
    found = sweep.sweep(_history(spark, sf_dir), [VARIANTS[n] for n in ("v12", "v14", "v17")])
    return found.select("variant", "session", join_items(F.col("items")).alias("labels"))


def folded_sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.folded_scores(_events(spark, sf_dir))


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger line for each session type of the events: a run's name holds a comma and a line feed."""
    runs = _events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return as_ledger(
        runs.select(
            F.concat(F.lit("run,"), "type", F.lit("\n1")).alias("exp_name"),
            F.when(F.col("type") == "clicks", "validation").otherwise("train").alias("pipeline"),
            F.lit("ok").alias("status"),
            F.col("n").alias("score"),
        )
    )


def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(_history(spark, sf_dir))


def _fused(history: DataFrame) -> DataFrame:
    recent = recommend.recent_items(history)
    own = fuse.predictions_as_candidates(recent.select("session", F.col("recent_aids").alias("items")))
    return fuse.fuse({"covisit": fuse.predictions_as_candidates(recommend.predict(recent, _index(history))), "recent": own})


def ranker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = evaluate.normalize_labels(_truth(spark, sf_dir))
    return fuse.ranker_rows(_fused(_history(spark, sf_dir)).select("session", "aid", "best_score"), labels, EVENT_TYPES)


def _stored(spark: SparkSession, events: DataFrame) -> str:
    """A new folder with events as an input of two shards: even sessions to train on, odd ones behind them."""
    folder = fresh_folder(spark, "jobs")
    for name, rest in (("train_parquet/a", 0), ("test_parquet/b", 1)):
        events.where(F.pmod("session", F.lit(2)) == rest).write.parquet(f"{folder}/in/{name}.parquet")
    return folder


def read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shard of a stored input."""
    return read_events(spark, f"{_stored(spark, _events(spark, sf_dir))}/in", max_shards=1)


def read_shards_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards of an input whose types are codes, with names."""
    code = F.when(F.col("type") == EVENT_TYPES[0], 0).when(F.col("type") == EVENT_TYPES[1], 1).otherwise(2)
    folder = _stored(spark, _events(spark, sf_dir).withColumn("type", code.cast("tinyint")))
    return prepare.with_type_names(read_events(spark, f"{folder}/in"))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of two variants, as the job writes it and the next one reads it."""
    folder = _stored(spark, _events(spark, sf_dir))
    run.build_index(spark, f"{folder}/in", folder, [variant("base"), variant("v14")])
    index = sinks.read_index(spark, f"{folder}/index")
    return index.select("variant", "aid_key", join_items(F.col("candidates")).alias("candidates"), join_items(F.col("scores")).alias("scores"))


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters that the index job keeps beside the index, of each variant, with the number of its keys."""
    folder = _stored(spark, _events(spark, sf_dir))
    run.build_index(spark, f"{folder}/in", folder, [variant("base"), variant("v14")])
    found = spark.read.schema("variants array<struct<name:string,clicks:int,carts:int,orders:int,lookback:int,topk:int,recent:boolean>>").json(f"{folder}/metadata")
    keys = sinks.read_index(spark, f"{folder}/index").groupBy(F.col("variant").alias("name")).agg(F.count("*").alias("n_keys"))
    return found.select(F.explode("variants").alias("v")).select("v.*").join(keys, "name")


def cached_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent items from the cache of the prediction job; other events on the same files are not looked at."""
    events, folder = _events(spark, sf_dir), _stored(spark, _events(spark, sf_dir))
    source = fingerprint(spark, f"{folder}/in")
    sinks.cached_recent_items(read_events(spark, f"{folder}/in"), f"{folder}/sessions", 20, source)
    found = sinks.cached_recent_items(events.where("session < 0"), f"{folder}/sessions", 20, source)
    return found.select("session", join_items(F.col("recent_aids")).alias("recent_aids"))


def _submitted(spark: SparkSession, history: DataFrame) -> str:
    """The folder of a stored input, with its index and submission."""
    folder = _stored(spark, history)
    run.build_index(spark, f"{folder}/in", folder, [variant("base")])
    run.predict(spark, f"{folder}/in", folder, folder)
    return folder


def stored_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission file of the prediction job, read back."""
    return spark.read.option("header", True).schema("session_type string, labels string, variant string").csv(f"{_submitted(spark, _events(spark, sf_dir))}/submission")


def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from a CSV file, as the evaluation reads them."""
    folder = _submitted(spark, _history(spark, sf_dir))
    stored = spark.read.option("header", True).csv(f"{folder}/submission").select("session_type", "labels")
    stored.write.option("header", True).csv(f"{folder}/guess.csv")
    rows = evaluate.normalize_predictions(read_table(spark, f"{folder}/guess.csv"))
    return rows.select("session_type", join_items(F.col("items")).alias("items"))


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that the evaluation job writes for a submission file against labels in a Parquet file."""
    folder = _submitted(spark, _history(spark, sf_dir))
    spark.read.option("header", True).csv(f"{folder}/submission").select("session_type", "labels").write.option("header", True).csv(f"{folder}/guess.csv")
    _truth(spark, sf_dir).write.parquet(f"{folder}/truth.parquet")
    run.run_evaluate(spark, f"{folder}/guess.csv", f"{folder}/truth.parquet", folder)
    return spark.read.schema("event_type string, hits bigint, targets bigint, rows bigint, weight double, recall double").json(f"{folder}/recall")


def covisit_scores_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the longest lookback, from sessions cut into stretches of 20 events."""
    return sweep.direct_scores(_events(spark, sf_dir), variant("v17"), longest=20)


def read_mixed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events from shards whose types are names, bytes, shorts and longs, with integers of other widths."""
    events, folder = _events(spark, sf_dir), fresh_folder(spark, "jobs")
    code = F.when(F.col("type") == EVENT_TYPES[0], 0).when(F.col("type") == EVENT_TYPES[1], 1).otherwise(2)
    for k, (name, kind, narrow) in enumerate((("train_parquet/a", None, "bigint"), ("train_parquet/b", "tinyint", "int"), ("test_parquet/a", "bigint", "int"), ("test_parquet/b", "smallint", "bigint"))):
        part = events.where(F.pmod("session", F.lit(4)) == k).withColumns({c: F.col(c).cast(narrow) for c in ("session", "aid")})
        (part if kind is None else part.withColumn("type", code.cast(kind))).write.parquet(f"{folder}/in/{name}.parquet")
    return read_events(spark, f"{folder}/in")


def covisit_scores_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of events whose times are whole hours, from files that hold the latest events first: those of one hour stay
    in that order."""
    events, folder = _table(spark, sf_dir, "events"), fresh_folder(spark, "jobs")
    hours = events_as_sessions(events.withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")), keep=("event_id",))
    hours.repartitionByRange(4, F.desc("event_id")).sortWithinPartitions(F.desc("event_id")).drop("event_id").write.parquet(f"{folder}/in/train_parquet/a.parquet")
    return sweep.direct_scores(read_events(spark, f"{folder}/in", place_col="place"), variant("base"), ties=("place",))


def stored_recent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of recent events alone, as the job writes it: rows without an item count for the latest time."""
    events, folder = _table(spark, sf_dir, "events"), fresh_folder(spark, "jobs")
    others = events_as_sessions(events.where("event_type = 'error'").withColumn("event_type", F.lit("view"))).withColumn("aid", F.lit(None).cast("bigint"))
    _events(spark, sf_dir).unionByName(others).write.parquet(f"{folder}/in/train_parquet/a.parquet")
    run.build_index(spark, f"{folder}/in", folder, [variant("v12")])
    return sinks.read_index(spark, f"{folder}/index").select("aid_key", join_items(F.col("candidates")).alias("candidates"), join_items(F.col("scores")).alias("scores"))


def _by_session(spark: SparkSession, events: DataFrame, n: int) -> str:
    """A new input of n shards, with whole sessions."""
    folder = fresh_folder(spark, "jobs")
    for k in range(n):
        events.where(F.pmod("session", F.lit(n)) == k).write.parquet(f"{folder}/in/train_parquet/{k}.parquet")
    return folder


def index_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that follows three shards, of which one is withdrawn, added again, and another withdrawn."""
    folder = _by_session(spark, _events(spark, sf_dir), 3)
    store = upkeep.IndexStore(spark, f"{folder}/store", variant("base"), buckets=16)
    store.follow(f"{folder}/in")
    shards = sorted(shard_fingerprints(spark, f"{folder}/in").items(), key=lambda x: x[1])
    store.withdraw(shards[0][0])
    store.add(shards[0][1])
    store.add(shards[1][1])
    store.withdraw(shards[2][0])
    return store.index().select("aid_key", join_items(F.col("candidates")).alias("candidates"), join_items(F.col("scores")).alias("scores"))


def sessions_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent items from last times by shard: two shards that share their sessions, the second of which comes later."""
    events, folder = _events(spark, sf_dir), fresh_folder(spark, "jobs")
    store = upkeep.RecencyStore(spark, f"{folder}/store")
    for k, part in enumerate((events.where(F.col("ts") >= CUT), events.where(F.col("ts") < CUT))):
        part.write.parquet(f"{folder}/in/train_parquet/{k}.parquet")
        store.update(f"{folder}/in")
    return store.recent_items(f"{folder}/in").select("session", join_items(F.col("recent_aids")).alias("recent_aids"))


def last_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from a CSV file that has each key twice, those that count behind the others."""
    history, folder = _history(spark, sf_dir), fresh_folder(spark, "jobs")
    good = recommend.submission(_predictions(history, history))
    rows = good.withColumn("labels", F.lit("1 2 3")).withColumn("turn", F.lit(0)).unionByName(good.withColumn("turn", F.lit(1)))
    rows.repartitionByRange(4, "turn", "session_type").sortWithinPartitions("turn", "session_type").drop("turn").write.option("header", True).csv(f"{folder}/guess.csv")
    found = evaluate.normalize_predictions(read_table(spark, f"{folder}/guess.csv", "place"), "place")
    return found.select("session_type", join_items(F.col("items")).alias("items"))


def colocated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from an index and recent items in equal buckets."""
    folder = _stored(spark, _events(spark, sf_dir))
    run.build_index(spark, f"{folder}/in", folder, [variant("base")])
    names = run.store_colocated(spark, f"{folder}/in", folder, f"{folder}/buckets", buckets=8)
    return run.predict_colocated(spark, names, "base").select("session", join_items(F.col("items")).alias("labels"))


def ordered_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission file of one variant, with the number of each line behind the header."""
    folder = _stored(spark, _events(spark, sf_dir))
    run.build_index(spark, f"{folder}/in", folder, [variant("base")])
    run.predict(spark, f"{folder}/in", folder, folder, single=True)
    rows = read_table(spark, f"{folder}/submission/submission_base.csv", "place")
    return numbered(rows, ["place"], 4, "line").select("session_type", "labels", "line")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (session_events, unknown_types, type_weights, recent_threshold, recent_events, ordered_events, covisit_pairs_l2)
    more = (
        covisit_scores_lineitem, merge_scores, covisit_topk_100, covisit_topk_300, candidate_index, recent_items, predictions, predictions_lineitem, submission_rows,
        normalized_predictions, normalized_labels, recall_by_type, overall_recall, folded_sweep_scores, sweep_predictions, variant_leaderboard, ledger_rows, fused_candidates, ranker_rows,
        read_shards, read_shards_by_code, stored_index, stored_metadata, cached_sessions, stored_submission, stored_predictions, stored_metrics,
        covisit_scores_long_sessions, read_mixed_shards, covisit_scores_file_order, stored_recent_index, index_by_shard, sessions_by_shard, last_predictions, colocated_predictions, ordered_submission,
    )
    scores = {f"covisit_scores_{n}": _scores(n) for n in ("base", "v12", "v13", "v14", "v15", "v16", "v17", "v18")}
    return {f.__name__: f for f in plain} | scores | {f.__name__: f for f in more}


_EV = """ev AS (SELECT * FROM (SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid, epoch_us(ts) // 1000 AS ts,
 CASE WHEN event_type IN ('view', 'click') THEN 'clicks' WHEN event_type = 'signup' THEN 'carts' WHEN event_type = 'purchase' THEN 'orders' END AS type FROM events) WHERE type IS NOT NULL)"""
_LI = """ev AS (SELECT o_custkey AS session, l_partkey AS aid, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 86400000 AS ts,
 CASE l_returnflag WHEN 'N' THEN 'clicks' WHEN 'R' THEN 'carts' WHEN 'A' THEN 'orders' END AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_HISTORY = f"hist AS (SELECT * FROM ev WHERE ts < {CUT})"


def _placed(source: str, name: str = "placed") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, aid, type) AS place FROM {source})"


def _weight_sql(name: str, col: str) -> str:
    v = VARIANTS[name]
    return f"CASE {col} WHEN 'clicks' THEN {v.clicks} WHEN 'carts' THEN {v.carts} WHEN 'orders' THEN {v.orders} END"


def _scores_sql(name: str, source: str, out: str = "scores") -> str:
    """CTEs of one variant's scores."""
    v = VARIANTS[name]
    kept = f"(SELECT * FROM {source} WHERE ts > (SELECT max(ts) - 1209600000 FROM {source}))" if v.recent else source
    return f"""{_placed(kept, f"p_{out}")}, {out} AS (SELECT a.aid AS aid_key, b.aid AS aid_future, CAST(sum({_weight_sql(name, "b.type")}) AS BIGINT) AS score
 FROM p_{out} a JOIN p_{out} b ON a.session = b.session AND b.place - a.place BETWEEN 1 AND {v.lookback} WHERE {_weight_sql(name, "b.type")} <> 0 GROUP BY 1, 2)"""


def _top_sql(k: int, scores: str = "scores", out: str = "top") -> str:
    return f'{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid_key ORDER BY score DESC, aid_future) AS "rank" FROM {scores}) WHERE "rank" <= {k})'


def _recent_sql(source: str, k: int = 20) -> str:
    return f"""recent AS (SELECT * FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY last DESC, aid DESC) AS place
 FROM (SELECT session, aid, max(ts) AS last FROM {source} GROUP BY 1, 2)) WHERE place <= {k})"""


def _guess_sql(top: str = "top", out: str = "guess", k: int = 20) -> str:
    """CTE of (session, aid, place): candidates of the newest item, then the history."""
    return f"""{out} AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY place) AS place FROM
 (SELECT session, aid, min(place) AS place FROM (SELECT r.session, t.aid_future AS aid, t."rank" AS place FROM recent r JOIN {top} t ON t.aid_key = r.aid AND r.place = 1 AND t."rank" <= {k}
 UNION ALL SELECT session, aid, 1000 + place FROM recent) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session ORDER BY place) <= {k})"""


_TRUTH = f"truth AS (SELECT DISTINCT session, type, aid FROM ev WHERE ts >= {CUT})"
_TYPES = "types(event_type, weight) AS (VALUES " + ", ".join(f"('{t}', CAST({RECALL_WEIGHTS[t]} AS DOUBLE))" for t in EVENT_TYPES) + ")"


def _recall_sql(guess: str = "guess", out: str = "recalls") -> str:
    return f"""{out} AS (SELECT y.event_type, CAST(count(g.aid) AS BIGINT) AS hits, CAST(count(t.aid) AS BIGINT) AS targets, CAST(count(DISTINCT t.session) AS BIGINT) AS "rows", y.weight,
 CASE WHEN count(t.aid) > 0 THEN CAST(count(g.aid) AS DOUBLE) / count(t.aid) ELSE 0.0 END AS recall
 FROM types y LEFT JOIN truth t ON t.type = y.event_type LEFT JOIN {guess} g ON g.session = t.session AND g.aid = t.aid GROUP BY y.event_type, y.weight)"""


def _overall_sql(recalls: str = "recalls") -> str:
    of = lambda t: f"max(CASE WHEN event_type = '{t}' THEN recall END)"
    return " + ".join(f"CAST({RECALL_WEIGHTS[t]} AS DOUBLE) * {of(t)}" for t in EVENT_TYPES) + f" AS overall_recall FROM {recalls}"


def oracle_sql() -> dict[str, str]:
    items = lambda col="aid", order="place": f"string_agg(CAST({col} AS VARCHAR), ' ' ORDER BY {order})"
    base = f"WITH {_EV}, {_scores_sql('base', 'ev')}, {_top_sql(100)}"
    predicted = f"{base}, {_recent_sql('ev')}, {_guess_sql()}"
    lines = f"WITH {_LI}, {_scores_sql('base', 'ev')}, {_top_sql(100)}, {_recent_sql('ev')}, {_guess_sql()}"
    held = f"WITH {_EV}, {_HISTORY}, {_TRUTH}, {_TYPES}, {_scores_sql('base', 'hist')}, {_top_sql(100)}, {_recent_sql('hist')}, {_guess_sql()}"
    kinds = "(VALUES " + ", ".join(f"('{t}')" for t in EVENT_TYPES) + ") AS k(kind)"
    out = {
        "session_events": f"WITH {_EV} SELECT session, aid, ts, type FROM ev",
        "unknown_types": "SELECT DISTINCT coalesce(event_type, 'null') AS type FROM events WHERE event_type IS NULL OR event_type NOT IN ('clicks', 'carts', 'orders')",
        "type_weights": f"WITH {_EV} SELECT type, CAST({_weight_sql('base', 'type')} AS INTEGER) AS weight, count(*) AS n FROM ev GROUP BY 1, 2",
        "recent_threshold": f"WITH {_EV} SELECT max(ts) - 1209600000 AS threshold FROM ev",
        "recent_events": f"WITH {_EV} SELECT * FROM ev WHERE ts > (SELECT max(ts) - 1209600000 FROM ev)",
        "ordered_events": f"WITH {_EV}, {_placed('ev')} SELECT * FROM placed",
        "covisit_pairs_l2": f"WITH {_EV}, {_placed('ev')} SELECT a.aid AS aid_key, b.aid AS aid_future, a.ts AS key_ts, b.place - a.place AS lag, CAST({_weight_sql('base', 'b.type')} AS INTEGER) AS weight FROM placed a JOIN placed b ON a.session = b.session AND b.place - a.place BETWEEN 1 AND 2",
        "covisit_scores_lineitem": f"WITH {_LI}, {_scores_sql('base', 'ev')} SELECT * FROM scores",
        "merge_scores": f"WITH {_EV}, {_scores_sql('base', 'ev')} SELECT * FROM scores",
        "covisit_topk_100": f"WITH {_LI}, {_scores_sql('v14', 'ev')}, {_top_sql(100)} SELECT * FROM top",
        "covisit_topk_300": f"WITH {_LI}, {_scores_sql('v19', 'ev')}, {_top_sql(300)} SELECT * FROM top",
        "candidate_index": f"""{base} SELECT aid_key, {items("aid_future", '"rank"')} AS candidates, {items("score", '"rank"')} AS scores FROM top GROUP BY aid_key""",
        "recent_items": f"WITH {_EV}, {_recent_sql('ev')} SELECT session, {items()} AS recent_aids FROM recent GROUP BY session",
        "predictions": f"{predicted} SELECT session, {items()} AS labels FROM guess GROUP BY session",
        "predictions_lineitem": f"{lines} SELECT session, {items()} AS labels FROM guess GROUP BY session",
        "submission_rows": f"{predicted} SELECT concat(session, '_', kind) AS session_type, labels FROM (SELECT session, {items()} AS labels FROM guess GROUP BY session) CROSS JOIN {kinds}",
        "normalized_predictions": f"{held} SELECT concat(session, '_', kind) AS session_type, items FROM (SELECT session, {items()} AS items FROM guess GROUP BY session) CROSS JOIN {kinds}",
        "normalized_labels": f"WITH {_EV}, {_TRUTH} SELECT concat(session, '_', type) AS session_type, {items(order='aid')} AS items FROM truth GROUP BY session, type",
        "recall_by_type": f"{held}, {_recall_sql()} SELECT * FROM recalls",
        "overall_recall": f"{held}, {_recall_sql()} SELECT {_overall_sql()}",
        "ledger_rows": f"WITH {_EV} SELECT '' AS timestamp, concat('run;', type, ' 1') AS exp_name, CASE WHEN type = 'clicks' THEN 'validation' ELSE 'train' END AS pipeline, 'ok' AS status, '' AS config_path, '' AS enable_convisitation, '' AS enable_nn, '' AS enable_fusion, '' AS enable_ranker, CASE WHEN type = 'clicks' THEN CAST(count(*) AS VARCHAR) ELSE '' END AS score, '' AS notes FROM ev GROUP BY type",
    }
    for n in ("base", "v12", "v13", "v14", "v15", "v16", "v17", "v18"):
        out[f"covisit_scores_{n}"] = f"WITH {_EV}, {_scores_sql(n, 'ev')} SELECT * FROM scores"
    every = ", ".join(_scores_sql(n, "ev", f"s_{n}") for n in VARIANTS)
    out["folded_sweep_scores"] = f"WITH {_EV}, {every} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM s_{n}" for n in VARIANTS)
    boards = ", ".join(f"{_scores_sql(n, 'hist', f's_{n}')}, {_top_sql(v.topk, f's_{n}', f't_{n}')}, {_guess_sql(f't_{n}', f'g_{n}')}, {_recall_sql(f'g_{n}', f'r_{n}')}" for n, v in VARIANTS.items())
    out["variant_leaderboard"] = f"WITH {_EV}, {_HISTORY}, {_TRUTH}, {_TYPES}, {_recent_sql('hist')}, {boards} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, {_overall_sql(f'r_{n}')}" for n in VARIANTS)
    two = ("base", "v14")
    ranked = ", ".join(f"{_scores_sql(n, 'ev', f's_{n}')}, {_top_sql(100, f's_{n}', f't_{n}')}" for n in two)
    lists = f"""{items("aid_future", '"rank"')} AS candidates, {items("score", '"rank"')} AS scores"""
    out["read_shards"] = f"WITH {_EV} SELECT session, aid, ts, type FROM ev WHERE session % 2 = 0"
    out["read_shards_by_code"] = out["session_events"]
    out["stored_index"] = f"WITH {_EV}, {ranked} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, aid_key, {lists} FROM t_{n} GROUP BY aid_key" for n in two)
    named = ", ".join(f"('{n}', {VARIANTS[n].clicks}, {VARIANTS[n].carts}, {VARIANTS[n].orders}, {VARIANTS[n].lookback}, {VARIANTS[n].topk}, {VARIANTS[n].recent})" for n in two)
    out["stored_metadata"] = f"WITH {_EV}, {ranked}, sizes AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(DISTINCT aid_key) AS n_keys FROM t_{n}" for n in two) + f") SELECT v.*, n_keys FROM (VALUES {named}) AS v(name, clicks, carts, orders, lookback, topk, recent) JOIN sizes USING (name)"
    out["cached_sessions"] = out["recent_items"]
    out["stored_submission"] = f"SELECT *, 'base' AS variant FROM ({out['submission_rows']})"
    out["stored_predictions"], out["stored_metrics"] = out["normalized_predictions"], out["recall_by_type"]
    out["covisit_scores_long_sessions"] = out["covisit_scores_v17"]
    out["read_mixed_shards"] = out["session_events"]
    hours = _EV.replace("epoch_us(ts) // 1000 AS ts", "epoch_us(ts) // 3600000000 * 3600000 AS ts, event_id")
    weight = _weight_sql("base", "b.type")
    out["covisit_scores_file_order"] = f"""WITH {hours}, placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id DESC) AS place FROM ev)
 SELECT a.aid AS aid_key, b.aid AS aid_future, CAST(sum({weight}) AS BIGINT) AS score FROM placed a JOIN placed b ON a.session = b.session AND b.place - a.place BETWEEN 1 AND 2 GROUP BY 1, 2"""
    flat = f"""{items("aid_future", '"rank"')} AS candidates, {items("score", '"rank"')} AS scores"""
    out["stored_recent_index"] = f"WITH {_EV}, late AS (SELECT * FROM ev WHERE ts > (SELECT max(epoch_us(ts) // 1000) - 1209600000 FROM events)), {_scores_sql('base', 'late')}, {_top_sql(100)} SELECT aid_key, {flat} FROM top GROUP BY aid_key"
    out["index_by_shard"] = f"WITH {_EV}, part AS (SELECT * FROM ev WHERE session % 3 <> 2), {_scores_sql('base', 'part')}, {_top_sql(100)} SELECT aid_key, {flat} FROM top GROUP BY aid_key"
    out["sessions_by_shard"], out["last_predictions"], out["colocated_predictions"] = out["recent_items"], out["normalized_predictions"], out["predictions"]
    turns = "(VALUES " + ", ".join(f"('{t}', {k})" for k, t in enumerate(EVENT_TYPES)) + ") AS k(kind, turn)"
    out["ordered_submission"] = f"{predicted} SELECT concat(session, '_', kind) AS session_type, labels, row_number() OVER (ORDER BY session, turn) AS line FROM (SELECT session, {items()} AS labels FROM guess GROUP BY session) CROSS JOIN {turns}"
    three = ("v12", "v14", "v17")
    lists = ", ".join(f"{_scores_sql(n, 'hist', f's_{n}')}, {_top_sql(VARIANTS[n].topk, f's_{n}', f't_{n}')}, {_guess_sql(f't_{n}', f'g_{n}')}" for n in three)
    out["sweep_predictions"] = f"WITH {_EV}, {_HISTORY}, {_recent_sql('hist')}, {lists} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, session, {items()} AS labels FROM g_{n} GROUP BY session" for n in three)
    pooled = "pooled AS (SELECT session, aid, CAST(1.0 AS DOUBLE) / place AS score, 'covisit' AS source FROM guess UNION ALL SELECT session, aid, CAST(1.0 AS DOUBLE) / place, 'recent' FROM recent)"
    fused = "fused AS (SELECT session, aid, max(score) AS best_score, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pooled GROUP BY 1, 2)"
    out["fused_candidates"] = f"{held}, {pooled}, {fused} SELECT * FROM fused"
    out["ranker_rows"] = f"{held}, {pooled}, {fused} SELECT f.session, f.aid, f.best_score, kind AS type, CAST(t.aid IS NOT NULL AS INTEGER) AS label FROM fused f CROSS JOIN {kinds} LEFT JOIN truth t ON t.session = f.session AND t.type = kind AND t.aid = f.aid"
    return out
