"""Sessions cut into stretches, file order, shards of many kinds, thresholds from footers, and results kept by shard."""

from __future__ import annotations

import dataclasses
import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from clickloom.jobs import run, sinks, upkeep
from clickloom.operators import covisit, evaluate, prepare, ranges, recommend, sweep
from clickloom.schema import EVENTS, variant
from clickloom.sources import events as sources
from clickloom.sources import shared


def _log(spark, sizes, seed=1, items=6, times=40):
    rng = random.Random(seed)
    rows = [(s, rng.randrange(items), rng.randrange(times), rng.choice(["clicks", "carts", "orders"])) for s, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EVENTS)


def _bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


# sessions cut into stretches


@pytest.mark.parametrize("lookback", [2, 5, 20])
@pytest.mark.parametrize("longest", [1, 7, 30])
def test_cut_sessions_give_the_same_pairs(spark, lookback, longest):
    ready = prepare.prepare(_log(spark, [100, 1, 31, 30, 8, 0, 64]), variant("base").weights).repartition(3)
    whole = covisit.covisit_pairs(ready, lookback, keep=("weight", "type"))
    assert _bag(covisit.covisit_pairs(ready, lookback, keep=("weight", "type"), longest=longest)) == _bag(whole)


def test_cut_sessions_in_all_scores(spark):
    events = _log(spark, [90, 3, 40], seed=2)
    for name in ("v12", "v13", "v17"):
        assert _bag(sweep.direct_scores(events, variant(name), longest=10)) == _bag(sweep.direct_scores(events, variant(name)))
    chosen = [variant(n) for n in ("base", "v12", "v16")]
    assert _bag(sweep.folded_scores(events, chosen, longest=10)) == _bag(sweep.folded_scores(events, chosen))
    assert _bag(covisit.ordered_events(events, longest=10)) == _bag(covisit.ordered_events(events))


def test_events_all_alike_are_cut(spark):
    """Rows that no key tells apart: every range still gets its share."""
    events = spark.range(3000).selectExpr("1L AS session", "7L AS aid", "5L AS ts", "'clicks' AS type")
    got = sweep.direct_scores(events, variant("base"), longest=100).collect()
    assert [tuple(r) for r in got] == [(7, 7, 2 * 3000 - 3)]


def test_one_session_of_a_million_events_is_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 1_000_000
        events = spark.range(n).selectExpr("1L AS session", "pmod(xxhash64(id), 1000) AS aid", "id AS ts", "1 AS weight")
        pairs = covisit.covisit_pairs(events, 2, ties=("aid",), longest=10_000)
        tasks = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 2 * n - 3 and len(tasks) > 30 and max(tasks) < 0.12 * sum(tasks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers(spark):
    rows = [(None if x % 13 == 0 else x % 7, chr(97 + x % 5), x) for x in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(5)
    got = {(r["a"], r["b"], r["c"]): r["number"] for r in ranges.numbered(df, ["a", "b", "c"], 9).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got == {r: i + 1 for i, r in enumerate(want)}
    assert ranges.numbered(df.limit(0), ["a"], 4).collect() == []


def test_boards_of_cut_sessions(spark):
    history = _log(spark, [60, 3, 40, 25], seed=3, items=12)
    labels = evaluate.normalize_labels(spark.createDataFrame([(f"{s}_{t}", [1, 2, 5]) for s in range(4) for t in ("clicks", "orders")], "session_type string, ground_truth array<long>"))
    assert _bag(sweep.leaderboard(history, labels, longest=10)) == _bag(sweep.leaderboard(history, labels))


def test_lists_of_a_shared_sum(spark):
    """Variants of one sum and different numbers of candidates: each has its own from one ranking."""
    history = _log(spark, [80, 50], seed=4, items=40)
    chosen = [variant(n) for n in ("base", "v20", "v14", "v19", "v12")]
    chosen = [dataclasses.replace(v, topk=k) for v, k in zip(chosen, (3, 5, 30, 2, 4), strict=True)]
    got = {r["aid_key"]: r for r in sweep.wide_index(sweep.shared_scores(history, chosen), chosen, topk=20).collect()}
    for v in chosen:
        best = covisit.candidate_index(covisit.topk_per_key(sweep.direct_scores(history, v), min(v.topk, 20)))
        assert {k: r[v.name] for k, r in got.items() if r[v.name]} == {r["aid_key"]: r["candidates"] for r in best.collect()}
    plan = sweep.wide_index(sweep.shared_scores(history, chosen), chosen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 1 and "s3" not in plan and "s2" in plan  # five variants, three sums


# shards as they are


def _mixed(spark, root):
    """Three shards: names, bytes and longs as types, narrow and wide integers, one more column, a row without item."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    frame([(1, 10, 1, "clicks"), (1, 20, 2, "carts")], "session long, aid long, ts long, type string").write.parquet(f"{root}/in/train_parquet/a.parquet")
    frame([(9, 1, 30, 3, 2)], "extra int, session int, aid short, ts long, type byte").write.parquet(f"{root}/in/train_parquet/b.parquet")
    frame([(2, 20, 4, 0), (2, None, 99, 1)], "session long, aid int, ts int, type long").write.parquet(f"{root}/in/test_parquet/c.parquet")
    return f"{root}/in"


def test_shards_of_many_kinds(spark, tmp_path):
    path = _mixed(spark, tmp_path)
    events = sources.read_events(spark, path)
    assert [f.dataType.simpleString() for f in events.schema] == ["bigint", "bigint", "bigint", "string"]
    want = [(1, 10, 1, "clicks"), (1, 20, 2, "carts"), (1, 30, 3, "orders"), (2, 20, 4, "clicks"), (2, None, 99, "carts")]
    assert _bag(events) == sorted(want, key=repr)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "extra" not in plan
    spark.createDataFrame([(3, 5, 6, 7)], "session long, aid long, ts long, type short").write.parquet(f"{path}/train_parquet/d.parquet")
    with pytest.raises(ValueError, match="'7'"):
        prepare.check_types(sources.read_events(spark, path))
    with pytest.raises(ValueError, match="types are"):
        sources.read_events(spark, path, type_codes=True)
    spark.createDataFrame([(1, 2)], "session long, ts long").write.parquet(f"{tmp_path}/bad.parquet")
    with pytest.raises(ValueError, match="no column aid, type"):
        sources.read_events(spark, f"{tmp_path}/bad.parquet")


def test_files_of_one_kind_are_one_scan(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 1, 1, "clicks")], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/train_parquet/{k}.parquet")
    events = sources.read_events(spark, f"{tmp_path}/in")
    assert events._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1 and events.count() == 3


def test_latest_time_comes_from_footers(spark, tmp_path):
    path = _mixed(spark, tmp_path)
    asked = sources._latest(spark, sources.event_paths(spark, path))
    assert all("PushedAggregation: [MAX(ts)]" in df._jdf.queryExecution().executedPlan().toString() for df in asked)
    assert sources.latest_time(spark, path) == 99 and run.recency_limit(spark, path) == 99 - 14 * 86_400_000
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/none.parquet")
    assert sources.latest_time(spark, f"{tmp_path}/none.parquet") is None


def test_latest_time_without_statistics(spark, tmp_path):
    one = spark.createDataFrame([(1, 2, 30, "clicks"), (1, 2, 50, "clicks")], EVENTS)
    one.write.option("parquet.column.statistics.enabled", "false").parquet(f"{tmp_path}/a.parquet")
    assert sources.latest_time(spark, f"{tmp_path}/a.parquet") == 50


def test_a_late_row_without_item_sets_the_threshold_on_all_paths(spark, tmp_path):
    day = 86_400_000
    rows = [(1, 10, 0, "clicks"), (1, 20, 1, "carts"), (1, 10, 10 * day, "clicks"), (1, 20, 10 * day + 1, "carts"), (1, None, 20 * day, "clicks")]
    events = spark.createDataFrame(rows, EVENTS)
    want = [(10, 20, 3)]
    assert _bag(sweep.direct_scores(events, variant("v12"))) == want
    assert _bag(sweep.folded_scores(events, [variant("v12"), variant("base")]).where("variant = 'v12'").drop("variant")) == want
    events.coalesce(1).write.parquet(f"{tmp_path}/in/train_parquet/a.parquet")
    for names in (["v12"], ["v12", "base"]):
        run.build_index(spark, f"{tmp_path}/in", f"{tmp_path}/out", [variant(n) for n in names])
        got = sinks.read_index(spark, f"{tmp_path}/out/index").where("variant = 'v12'").collect()
        assert [(r["aid_key"], r["candidates"], r["scores"]) for r in got] == [(10, [20], [3])]


def test_ties_in_the_order_of_files(spark, tmp_path):
    """Equal times: train before test, files by name, rows as they lie."""
    frame = lambda aids: spark.createDataFrame([(1, a, 5, "clicks") for a in aids], EVENTS).coalesce(1)
    frame([9, 3, 7]).write.parquet(f"{tmp_path}/in/train_parquet/b.parquet")
    frame([8]).write.parquet(f"{tmp_path}/in/train_parquet/a.parquet")
    frame([1, 5]).write.parquet(f"{tmp_path}/in/test_parquet/a.parquet")
    events = sources.read_events(spark, f"{tmp_path}/in", place_col="place")
    placed = covisit.ordered_events(events.withColumnRenamed("place", "row"), ties=("row",)).orderBy("place")
    assert [r["aid"] for r in placed.collect()] == [8, 9, 3, 7, 1, 5]
    run.build_index(spark, f"{tmp_path}/in", f"{tmp_path}/out", [variant("base")], file_order=True, longest=2)
    got = {r["aid_key"]: r["candidates"] for r in sinks.read_index(spark, f"{tmp_path}/out/index").collect()}
    assert got == {8: [3, 9], 9: [3, 7], 3: [1, 7], 7: [1, 5], 1: [5]}


def test_the_last_row_of_a_key_counts(spark, tmp_path):
    """Parquet of several row groups and files, and CSV that is read in several splits."""
    keys = [f"{i % 50}_clicks" for i in range(2000)]
    rows = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "session_type string, labels string").coalesce(1)
    want = {k: [i] for i, k in enumerate(keys)}
    rows.write.option("parquet.block.size", "1024").parquet(f"{tmp_path}/guess.parquet")
    rows.write.option("header", True).csv(f"{tmp_path}/guess.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for kind in ("parquet", "csv"):
            read = sources.read_table(spark, f"{tmp_path}/guess.{kind}", "place")
            if kind == "csv":
                assert read.rdd.getNumPartitions() > 3
            assert {r["session_type"]: r["items"] for r in evaluate.normalize_predictions(read, "place").collect()} == want
            spark.createDataFrame([("0_clicks", "1950"), ("1_clicks", "1"), ("1_clicks", "1951")], "session_type string, ground_truth string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/truth.parquet")
            assert run.run_evaluate(spark, f"{tmp_path}/guess.{kind}", f"{tmp_path}/truth.parquet", f"{tmp_path}/scored_{kind}") == pytest.approx(0.1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# claims


def test_one_claim_wins(spark, tmp_path):
    path, won = f"{tmp_path}/log/1", []
    each = [threading.Thread(target=lambda k=k: won.append((k, shared.claim(spark, path, f"text {k}")))) for k in range(8)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    winners = [k for k, ok in won if ok]
    assert len(winners) == 1 and shared.claimed(spark, path) == f"text {winners[0]}"
    assert not shared.claim(spark, path, "late") and shared.claimed(spark, path) == f"text {winners[0]}"
    assert shared.claimed(spark, f"{tmp_path}/log/2") is None


def test_a_claim_between_look_and_move(spark, tmp_path, monkeypatch):
    """Another one takes the path after this one has seen it free."""
    path = f"{tmp_path}/log/1"

    class Late:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def exists(self, at):
            found = self.fs.exists(at)
            if not found:
                monkeypatch.undo()
                assert shared.claim(spark, path, "first")
            return found

    real = shared._file_system
    monkeypatch.setattr(shared, "_file_system", lambda spark, at: Late(real(spark, at)))
    assert not shared.claim(spark, path, "second")
    assert shared.claimed(spark, path) == "first"


# an index kept up to date


def _shards(spark, root, n=4):
    for k in range(n):
        _log(spark, [12, 9, 14], seed=k, items=30).coalesce(1).write.parquet(f"{root}/in/train_parquet/{k}.parquet")
    return f"{root}/in", [f"{root}/in/train_parquet/{k}.parquet" for k in range(n)]


def _full(spark, paths, name="base"):
    parts = [sweep.direct_scores(sources.read_events(spark, p), variant(name)) for p in paths]
    return _bag(covisit.candidate_index(covisit.topk_per_key(covisit.merge_scores(*parts), variant(name).topk))) if parts else []


def _times(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/index/bucket=*/*.parquet")}


def test_index_follows_its_shards(spark, tmp_path):
    path, shards = _shards(spark, tmp_path)
    store = upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=16)
    assert store.index().collect() == []
    assert [store.add(s) for s in shards[:3]] == [True] * 3 and _bag(store.index()) == _full(spark, shards[:3])
    before = _times(f"{tmp_path}/ix")
    assert not store.add(shards[1]) and _times(f"{tmp_path}/ix") == before
    digests = {at.rpartition("/")[2]: d for d, at in sources.shard_fingerprints(spark, path).items()}
    assert store.withdraw(digests["1.parquet"]) and _bag(store.index()) == _full(spark, [shards[0], shards[2]])
    before = _times(f"{tmp_path}/ix")
    assert not store.withdraw(digests["1.parquet"]) and _times(f"{tmp_path}/ix") == before
    assert store.follow(path) == (2, 0) and _bag(store.index()) == _full(spark, shards)
    # a changed shard is another one
    _log(spark, [5, 5], seed=99, items=30).coalesce(1).write.mode("overwrite").parquet(shards[2])
    assert store.follow(path) == (1, 1) and _bag(store.index()) == _full(spark, shards)
    for d in list(store.active()):
        store.withdraw(d)
    assert store.index().collect() == [] and store.active() == {}
    with pytest.raises(ValueError, match="other parameters"):
        upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("v14"), buckets=16)
    with pytest.raises(ValueError, match="recent"):
        upkeep.IndexStore(spark, f"{tmp_path}/iy", variant("v12"))


def test_only_touched_buckets_are_rebuilt(spark, tmp_path):
    _, shards = _shards(spark, tmp_path, 2)
    store = upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=64)
    store.add(shards[0])
    before = _times(f"{tmp_path}/ix")
    spark.createDataFrame([(1, 3, 1, "clicks"), (1, 4, 2, "carts")], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/small.parquet")
    store.add(f"{tmp_path}/small.parquet")
    after = _times(f"{tmp_path}/ix")
    lost = {f.rpartition("/")[0] for f in before if f not in after}
    assert len(lost) <= 1 and all(after[f] == t for f, t in before.items() if f in after)
    assert _bag(store.index()) == _full(spark, [shards[0], f"{tmp_path}/small.parquet"])


def test_a_change_reads_totals_and_its_own_shard(spark, tmp_path):
    """Partial sums of shards that are applied are read again only to take them off."""
    _, shards = _shards(spark, tmp_path)
    store = upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=8)
    for s in shards[:3]:
        store.add(s)
    gone = [e["data"] for e in store.entries()]
    for data in gone[:2]:
        os.rename(f"{tmp_path}/ix/partials/{data}", f"{tmp_path}/{data}")
    store.add(shards[3])
    assert _bag(store.index()) == _full(spark, shards)
    assert store.withdraw(store.entries()[2]["shard"]) and _bag(store.index()) == _full(spark, [*shards[:2], shards[3]])
    assert len(os.listdir(f"{tmp_path}/ix/totals")) <= 2 + 8  # those that no bucket lies in any more are gone
    # several entries at once, one shard added and withdrawn among them
    for data in gone[:2]:
        os.rename(f"{tmp_path}/{data}", f"{tmp_path}/ix/partials/{data}")
    ((digest, at),) = sources.shard_fingerprints(spark, shards[2]).items()
    assert store._add(digest, at) and store._withdraw(digest) and store._withdraw(store.entries()[0]["shard"]) and store._add(digest, at)
    assert store.apply() and _bag(store.index()) == _full(spark, shards[1:])


def test_index_after_crashes(spark, tmp_path, monkeypatch):
    _, shards = _shards(spark, tmp_path)
    store = upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=8)
    store.add(shards[0])
    fails = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with monkeypatch.context() as m:  # partial sums without an entry
        m.setattr(upkeep.IndexStore, "_write", fails)
        with pytest.raises(RuntimeError):
            store.add(shards[1])
    assert _bag(store.index()) == _full(spark, shards[:1])
    with monkeypatch.context() as m:  # an entry that is not applied
        m.setattr(upkeep.IndexStore, "apply", fails)
        with pytest.raises(RuntimeError):
            store.add(shards[1])
    assert not store.add(shards[1]) and _bag(store.index()) == _full(spark, shards[:2])
    with monkeypatch.context() as m:  # applied half-way: no mark
        m.setattr(upkeep, "claim", lambda spark, path, text: fails() if "/applied/" in path else shared.claim(spark, path, text))
        with pytest.raises(RuntimeError):
            store.add(shards[2])
    again = upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=8)
    assert again.apply() and again.apply() == [] and _bag(again.index()) == _full(spark, shards[:3])


def test_two_write_entries_at_a_time(spark, tmp_path):
    _, shards = _shards(spark, tmp_path)
    one, two = (upkeep.IndexStore(spark, f"{tmp_path}/ix", variant("base"), buckets=8) for _ in range(2))
    digests = {at: d for s in shards for d, at in sources.shard_fingerprints(spark, s).items()}
    added = []
    each = [threading.Thread(target=lambda store=store, at=at, d=d: added.append((d, store._add(d, at)))) for at, d in digests.items() for store in (one, two)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert sorted(d for d, new in added if new) == sorted(digests.values())
    assert len(one.entries()) == len(shards)
    one.apply()
    assert _bag(two.index()) == _full(spark, shards)


def test_jobs_on_an_index_that_follows(spark, tmp_path):
    """follow, predict; then a shard comes, follow and predict again: as a new index per shard would give."""
    path, shards = _shards(spark, tmp_path, 2)
    zone = spark.conf.get("spark.sql.session.timeZone")
    job = lambda *a: run.main([x.replace("@", str(tmp_path)) for x in a])

    def predicted():
        job("follow", "--events", "@/in", "--out", "@/kept", "--variant", "v14")
        job("predict", "--events", "@/in", "--index", "@/kept", "--out", "@/guess", "--single-file", "--ledger", "@/ledger", "--enabled", "convisitation", "fusion")
        return sorted(open(f"{tmp_path}/guess/submission/submission_v14.csv").read().splitlines())

    def wanted():
        run.build_index(spark, f"{tmp_path}/in", f"{tmp_path}/full", [variant("v14")], per_shard=True)
        run.predict(spark, f"{tmp_path}/in", f"{tmp_path}/full", f"{tmp_path}/again", single=True)
        return sorted(open(f"{tmp_path}/again/submission/submission_v14.csv").read().splitlines())

    assert predicted() == wanted()
    _log(spark, [12, 9, 14], seed=77, items=30).coalesce(1).write.parquet(f"{tmp_path}/in/test_parquet/9.parquet")
    assert predicted() == wanted()
    lines = spark.read.option("header", True).csv(f"{tmp_path}/ledger").collect()
    assert {(r["pipeline"], r["enable_fusion"]) for r in lines} == {("submit", "1")} and len(lines) == 2
    spark.conf.set("spark.sql.session.timeZone", zone)


# last times by shard


def test_recent_items_by_shard(spark, tmp_path):
    path, shards = _shards(spark, tmp_path)  # sessions 0 to 2 lie in all shards
    store = upkeep.RecencyStore(spark, f"{tmp_path}/sessions")
    whole = lambda k=20: _bag(recommend.recent_items(sources.read_events(spark, path), k))
    assert len(store.update(path)) == 4 and _bag(store.recent_items(path)) == whole() and _bag(store.recent_items(path, 3)) == whole(3)
    assert store.update(path) == []
    _log(spark, [30], seed=50, items=30, times=90).coalesce(1).write.mode("overwrite").parquet(shards[2])
    assert [p.rpartition("/")[2] for p in store.update(path)] == ["2.parquet"]
    assert _bag(store.recent_items(path)) == whole()
    spark.createDataFrame([], EVENTS).coalesce(1).write.parquet(f"{path}/test_parquet/empty.parquet")
    assert _bag(store.recent_items(path)) == whole()


def test_recency_after_a_crash(spark, tmp_path, monkeypatch):
    path, _ = _shards(spark, tmp_path)
    store = upkeep.RecencyStore(spark, f"{tmp_path}/sessions")
    seen = []

    def second_fails(spark, at, text):
        seen.append(at)
        if len(seen) == 2:
            raise RuntimeError("crash")
        return shared.claim(spark, at, text)

    monkeypatch.setattr(upkeep, "claim", second_fails)
    with pytest.raises(RuntimeError):
        store.update(path)
    monkeypatch.undo()
    assert len(store.update(path)) == 3
    assert _bag(store.recent_items(path)) == _bag(recommend.recent_items(sources.read_events(spark, path)))


# index and seeds in equal buckets


def test_join_of_equal_buckets_moves_nothing(spark, tmp_path):
    path, _ = _shards(spark, tmp_path)
    run.build_index(spark, path, f"{tmp_path}/out", [variant("base"), variant("v14")])
    names = run.store_colocated(spark, path, f"{tmp_path}/out", f"{tmp_path}/buckets", buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run.predict_colocated(spark, names, "v14")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = recommend.predict(recommend.recent_items(sources.read_events(spark, path)), sinks.read_index(spark, f"{tmp_path}/out/index").where("variant = 'v14'"))
        assert _bag(found) == _bag(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def test_ledger_tells_stages(spark, tmp_path):
    run.note_run(spark, f"{tmp_path}/ledger", "submit", 0.5, enabled=("convisitation", "fusion"))
    row = spark.read.option("header", True).csv(f"{tmp_path}/ledger").first()
    assert (row["pipeline"], row["enable_convisitation"], row["enable_nn"], row["enable_fusion"], row["enable_ranker"], row["score"]) == ("submit", "1", "0", "1", "0", None)


def test_fuse_job_plans_the_join_once(spark, tmp_path, monkeypatch):
    path, _ = _shards(spark, tmp_path)
    run.build_index(spark, path, f"{tmp_path}/out", [variant("base"), variant("v14"), variant("v16")])
    plans, write = [], sinks.write_candidates
    monkeypatch.setattr(sinks, "write_candidates", lambda rows, at: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, at)))
    run.run_fuse(spark, path, f"{tmp_path}/out", f"{tmp_path}/fused")
    assert plans[0].count("Join") == 1


# one submission file a variant


def _guesses(spark, n):
    """Sessions in no order, of two variants; one has no items."""
    rows = spark.range(n).selectExpr("pmod(id * 7919, 100003) AS session", "IF(id = 5, array(), array(id, id + 1)) AS items")
    return rows.withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("v16")))).repartition(7)


def test_one_file_in_the_order_of_sessions(spark, tmp_path):
    predictions = _guesses(spark, 3000)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "submission_base.csv").write_text("old")
    paths = sinks.write_ordered_submission(recommend.submission(predictions, by=("variant",), order=True), f"{tmp_path}/out")
    assert [p.rpartition("/")[2] for p in paths] == ["submission_base.csv", "submission_v16.csv"]
    want = ["session_type,labels"]
    for r in sorted(predictions.where("variant = 'base'").collect(), key=lambda r: r["session"]):
        want += [f"{r['session']}_{t},{' '.join(map(str, r['items']))}" for t in ("clicks", "carts", "orders")]
    for p in paths:
        assert open(p).read().splitlines() == want
    assert sorted(x for x in os.listdir(f"{tmp_path}/out") if x[0] != ".") == ["submission_base.csv", "submission_v16.csv"]
    back = evaluate.normalize_predictions(sources.read_table(spark, paths[0]))
    assert back.count() == 9000


def test_a_store_that_cannot_join_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "concatenate", lambda *a: False)
    (path,) = sinks.write_ordered_submission(recommend.submission(_guesses(spark, 50).where("variant = 'base'"), by=("variant",), order=True), f"{tmp_path}/out")
    names = sorted(x for x in os.listdir(path) if x[0] not in "._")
    assert names[0] == "part-0-header" and "".join(open(f"{path}/{x}").read() for x in names).count("\n") == 151
