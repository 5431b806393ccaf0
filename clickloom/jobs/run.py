"""The jobs: build an index, or let one follow its shards, recommend, evaluate, compare all variants, fuse candidates, label them for a ranker.

    python -m clickloom.jobs.run index --events IN --out DIR [--variant NAME ...] [--max-shards N] [--per-shard]
        [--clicks N] [--carts N] [--orders N] [--lookback N] [--topk N] [--file-order] [--longest-session N]
    python -m clickloom.jobs.run follow --events IN --out DIR [--variant NAME]
    python -m clickloom.jobs.run predict --events IN --index DIR --out DIR [--topk N] [--versions NAME ...] [--refresh-cache] [--single-file]
    python -m clickloom.jobs.run evaluate --predictions FILE --labels FILE --out DIR
    python -m clickloom.jobs.run leaderboard --events HISTORY --labels FILE --out DIR [--variant NAME ...]
    python -m clickloom.jobs.run fuse --events IN --index DIR --out DIR [--versions NAME ...]
    python -m clickloom.jobs.run ranker-rows --candidates DIR --labels FILE --out DIR

With --ledger DIR, index, predict and evaluate add a line to the run ledger (--exp-name, --config, --notes describe the run).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.jobs import sinks, upkeep
from clickloom.operators import covisit, evaluate, fuse, prepare, recommend, sweep
from clickloom.schema import DAY_MS, EVENT_TYPES, LEDGER, RECENT_DAYS, TOP_ITEMS, VARIANTS, Variant, variant
from clickloom.sources.events import latest_time, read_events, read_table
from clickloom.sources.shared import claimed, remove

#: Parameters of a variant that a run may set otherwise.
OVERRIDES = ("clicks", "carts", "orders", "lookback", "topk")
#: The stages that the ledger tells about.
STAGES = ("convisitation", "nn", "fusion", "ranker")
#: Events of a session beyond which it is cut into stretches for several tasks.
LONGEST = 1_000_000


def recency_limit(spark: SparkSession, events_path: str) -> int | None:
    """The time after which events are recent: that of the latest one, in whatever row, less some days."""
    latest = latest_time(spark, events_path)
    return None if latest is None else latest - RECENT_DAYS * DAY_MS


def build_index(spark: SparkSession, events_path: str, out: str, chosen: list[Variant], max_shards: int | None = None, type_codes: bool | None = None, per_shard: bool = False, file_order: bool = False, longest: int | None = LONGEST) -> None:
    """The index of some variants; the time threshold is that of all shards, also where only some are read.

    One variant is counted by itself; several share a pass. per_shard: events pair inside one file only. file_order:
    events of one time in a session stay in the order of the files, and are not ordered by item and type. Sessions of
    more than longest events are cut into stretches, which changes no pair. No pairs at all is an error.
    """
    shard, place = "shard" if per_shard else None, "place" if file_order else None
    events = read_events(spark, events_path, max_shards, type_codes, shard, place)
    limit = recency_limit(spark, events_path) if any(v.recent for v in chosen) else None
    ties = (place,) if place else covisit.TIES
    if len(chosen) == 1:
        scores = sweep.direct_scores(events, chosen[0], limit, shard, ties, longest).withColumn("variant", F.lit(chosen[0].name))
    else:
        scores = sweep.folded_scores(events, chosen, limit, shard, ties, longest)
    sinks.write_index(sweep.folded_index(scores, chosen), f"{out}/index")
    if sinks.read_index(spark, f"{out}/index").limit(1).count() == 0:
        raise RuntimeError("no pairs were generated")
    sinks.write_metadata(spark, f"{out}/metadata", {"variants": [vars(v) for v in chosen], "events": events_path, "max_shards": max_shards, "per_shard": per_shard})


def follow(spark: SparkSession, events_path: str, out: str, chosen: Variant) -> tuple[int, int]:
    """Let the index under out follow the shards of an input; how many shards came and went. The first call builds it."""
    return upkeep.IndexStore(spark, out, chosen).follow(events_path)


def _index(spark: SparkSession, index_path: str, versions: list[str] | None) -> tuple[DataFrame, list[str]]:
    """An index cut to the named variants, or to all that it has; one that it lacks is an error."""
    if told := claimed(spark, f"{index_path}/made_for"):  # an index that follows its shards
        kept = Variant(**{k: v for k, v in json.loads(told).items() if k != "buckets"})
        index = upkeep.IndexStore(spark, index_path, kept, json.loads(told)["buckets"]).index().withColumn("variant", F.lit(kept.name))
    else:
        index = sinks.read_index(spark, f"{index_path}/index")
    known = {r["variant"] for r in index.select("variant").distinct().collect()}  # partition folders, as many as variants
    names = sorted(known if versions is None else set(versions))
    if missing := [n for n in names if n not in known]:
        raise FileNotFoundError(f"no index of {', '.join(missing)} under {index_path}")
    return index.where(F.col("variant").isin(*names)) if names else index, names


def _recommended(spark: SparkSession, events_path: str, index_path: str, cache: str, topk: int, type_codes: bool | None, versions: list[str] | None, refresh: bool) -> tuple[DataFrame, DataFrame]:
    """Recent items by session, and (variant, session, items). Last times by shard are kept under cache; refresh drops them."""
    index, names = _index(spark, index_path, versions)
    if refresh:
        remove(spark, cache)
    recent = upkeep.RecencyStore(spark, cache).recent_items(events_path, topk, type_codes)
    each = recent.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    return recent, recommend.predict(each, index, topk, by=("variant",))


def predict(spark: SparkSession, events_path: str, index_path: str, out: str, topk: int = TOP_ITEMS, type_codes: bool | None = None, versions: list[str] | None = None, refresh: bool = False, single: bool = False) -> None:
    """Submissions by variant, as folders of parts or, if single, as one file a variant in the order of sessions. Last times of items are kept by shard under out, so that a later call reads new and
    changed shards only, unless refreshed."""
    _, found = _recommended(spark, events_path, index_path, f"{out}/sessions", topk, type_codes, versions, refresh)
    if single:
        sinks.write_ordered_submission(recommend.submission(found, by=("variant",), order=True), f"{out}/submission")
    else:
        sinks.write_submission(recommend.submission(found, by=("variant",)), f"{out}/submission")


def store_colocated(spark: SparkSession, events_path: str, index_path: str, out: str, topk: int = TOP_ITEMS, buckets: int = 64) -> tuple[str, str]:
    """Tables of the index and of recent items under out, in equal buckets by aid_key; their names.

    For many predictions from one index, or one history against many: each join of the two moves nothing. Names are new
    each time; DROP TABLE forgets them, and leaves the files.
    """
    index, _ = _index(spark, index_path, None)
    recent = recommend.recent_items(prepare.with_keys(read_events(spark, events_path)), topk)
    names = tuple(f"{x}_{uuid.uuid4().hex}" for x in ("candidates", "seeds"))
    for rows, name, folder in ((index, names[0], "index"), (recommend.with_seed(recent), names[1], "seeds")):
        sinks.write_buckets(rows, name, f"{out}/{folder}", buckets)
    return names


def predict_colocated(spark: SparkSession, names: tuple[str, str], version: str, topk: int = TOP_ITEMS) -> DataFrame:
    """(session, items) of one variant from the tables of store_colocated."""
    return recommend.predict(spark.table(names[1]), spark.table(names[0]).where(F.col("variant") == version), topk)


def score(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(event_type, hits, targets, rows, weight, recall). Of rows with one key the last counts, where both tables have a
    column place; else such a key is an error."""
    place = lambda df: "place" if "place" in df.columns else None
    return evaluate.recall_by_type(evaluate.normalize_predictions(predictions, place(predictions)), evaluate.normalize_labels(labels, place(labels)))


def run_evaluate(spark: SparkSession, predictions_path: str, labels_path: str, out: str) -> float:
    """Metrics by type and the overall recall under out; returns the latter. Of rows with one key the last in the file
    counts, files in the order of their names."""
    sinks.write_metrics(score(read_table(spark, predictions_path, "place"), read_table(spark, labels_path, "place")), f"{out}/recall")
    sinks.write_metrics(evaluate.overall_recall(spark.read.json(f"{out}/recall")), f"{out}/overall")
    return spark.read.json(f"{out}/overall").first()["overall_recall"]


def run_leaderboard(spark: SparkSession, events_path: str, labels_path: str, out: str, chosen: list[Variant], topk: int = TOP_ITEMS, type_codes: bool | None = None) -> None:
    """(variant, overall_recall) under out, of recommendations from the history at events_path."""
    labels = evaluate.normalize_labels(read_table(spark, labels_path, "place"), "place")
    sinks.write_metrics(sweep.leaderboard(read_events(spark, events_path, None, type_codes), labels, chosen, topk, recency_limit(spark, events_path) if any(v.recent for v in chosen) else None, LONGEST), f"{out}/leaderboard")


def run_fuse(spark: SparkSession, events_path: str, index_path: str, out: str, topk: int = TOP_ITEMS, type_codes: bool | None = None, versions: list[str] | None = None, refresh: bool = False) -> None:
    """Candidates of each variant and of the recent items in one table under out."""
    recent, found = _recommended(spark, events_path, index_path, f"{out}/sessions", topk, type_codes, versions, refresh)
    own = recent.select(F.lit("recent").alias("source"), "session", F.col("recent_aids").alias("items"))
    listed = found.select(F.col("variant").alias("source"), "session", "items").unionByName(own)
    sinks.write_candidates(fuse.fuse_rows(fuse.predictions_as_candidates(listed, by=("source",))), f"{out}/candidates")


def run_ranker_rows(spark: SparkSession, candidates_path: str, labels_path: str, out: str) -> None:
    """The fused candidates by event type, with their labels, under out."""
    labels = evaluate.normalize_labels(read_table(spark, labels_path, "place"), "place")
    sinks.write_candidates(fuse.ranker_rows(spark.read.parquet(f"{candidates_path}/candidates"), labels, EVENT_TYPES), f"{out}/ranker_rows")


def note_run(spark: SparkSession, ledger: str, pipeline: str, score: float | None = None, exp_name: str = "", config_path: str = "", notes: str = "", enabled: Iterable[str] = ("convisitation",)) -> None:
    """A line in the ledger for a run that has ended well; enabled: the stages that took part in it."""
    now = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    row = {"timestamp": now, "exp_name": exp_name, "pipeline": pipeline, "status": "completed", "config_path": config_path, **{f"enable_{x}": "1" if x in set(enabled) else "0" for x in STAGES}, "score": "" if score is None else str(score), "notes": notes}
    sinks.append_ledger(spark.createDataFrame([row], LEDGER), ledger)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser()
    jobs = top.add_subparsers(dest="job", required=True)
    own = {name: jobs.add_parser(name) for name in ("index", "follow", "predict", "evaluate", "leaderboard", "fuse", "ranker-rows")}
    for name, p in own.items():
        p.add_argument("--out", required=True)
        if name in ("index", "follow", "predict", "leaderboard", "fuse"):
            p.add_argument("--events", required=True)
        if name in ("index", "predict", "leaderboard", "fuse"):
            p.add_argument("--type-codes", action=argparse.BooleanOptionalAction, help="by default the type column tells")
        if name in ("index", "leaderboard"):
            p.add_argument("--variant", nargs="+", default=["base"] if name == "index" else list(VARIANTS), choices=list(VARIANTS))
        if name in ("predict", "fuse"):
            p.add_argument("--index", required=True)
            p.add_argument("--versions", nargs="+")
            p.add_argument("--refresh-cache", action="store_true")
        if name in ("predict", "fuse", "leaderboard"):
            p.add_argument("--topk", type=int, default=TOP_ITEMS)
        if name in ("evaluate", "leaderboard", "ranker-rows"):
            p.add_argument("--labels", required=True)
        if name in ("index", "predict", "evaluate"):
            p.add_argument("--ledger")
            p.add_argument("--enabled", nargs="*", default=["convisitation"], choices=STAGES, help="stages that took part, for the ledger")
            for x in ("--exp-name", "--config", "--notes"):
                p.add_argument(x, default="")
    own["follow"].add_argument("--variant", default="base", choices=[n for n, v in VARIANTS.items() if not v.recent])
    own["predict"].add_argument("--single-file", action="store_true")
    own["index"].add_argument("--max-shards", type=int)
    own["index"].add_argument("--per-shard", action="store_true")
    own["index"].add_argument("--file-order", action="store_true")
    own["index"].add_argument("--longest-session", type=int, default=LONGEST)
    for x in OVERRIDES:
        own["index"].add_argument(f"--{x}", type=int)
    own["evaluate"].add_argument("--predictions", required=True)
    own["ranker-rows"].add_argument("--candidates", required=True)
    return top


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    reached = None
    if a.job == "index":
        changed = {x: getattr(a, x) for x in OVERRIDES if getattr(a, x) is not None}
        build_index(spark, a.events, a.out, [dataclasses.replace(variant(n), **changed) for n in a.variant], a.max_shards, a.type_codes, a.per_shard, a.file_order, a.longest_session)
    elif a.job == "follow":
        follow(spark, a.events, a.out, variant(a.variant))
    elif a.job == "predict":
        predict(spark, a.events, a.index, a.out, a.topk, a.type_codes, a.versions, a.refresh_cache, a.single_file)
    elif a.job == "evaluate":
        reached = run_evaluate(spark, a.predictions, a.labels, a.out)
    elif a.job == "leaderboard":
        run_leaderboard(spark, a.events, a.labels, a.out, [variant(n) for n in a.variant], a.topk, a.type_codes)
    elif a.job == "fuse":
        run_fuse(spark, a.events, a.index, a.out, a.topk, a.type_codes, a.versions, a.refresh_cache)
    else:
        run_ranker_rows(spark, a.candidates, a.labels, a.out)
    if getattr(a, "ledger", None):
        pipeline = {"index": "train", "predict": "submit", "evaluate": "validation"}[a.job]
        note_run(spark, a.ledger, pipeline, reached, a.exp_name, a.config, a.notes, a.enabled)


if __name__ == "__main__":
    main()
