"""Results that follow their input shard by shard: an index from stored partial sums, recent items from stored last times.

Both keep what one shard gives under the digest of the shard's files, so that only new or changed shards are read again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from clickloom.operators import covisit, prepare, recommend, sweep
from clickloom.schema import INDEX, SCORES, TOP_ITEMS, Variant
from clickloom.sources.events import read_events, shard_fingerprints
from clickloom.sources.shared import claim, claimed, remove

#: Folders that an index is parted into by its keys.
BUCKETS = 64
#: Shards whose last times one job finds.
_AT_ONCE = 64


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


class IndexStore:
    """The candidate index of one variant over the shards that count, under a folder that driver and executors share.

    partials/*/bucket=*/ hold the pair scores of a shard, parted by a hash of aid_key. log/ numbers the changes: a shard
    comes to count, or no longer, from the moment its entry is there, and an entry is claimed by one writer alone.
    totals/*/bucket=*/ hold the sums over the shards that count, index/bucket=*/ the candidate lists; applied/ tells up to
    which entry, and where the totals of each bucket lie. Only buckets that new entries touch are rebuilt, from their
    totals and the partial sums of the new entries' shards, added or taken off; the others keep their files. So a change
    costs what the buckets that it touches hold, however many shards there are.

    Adding a shard that counts already changes nothing, nor does withdrawing one that does not. After a crash, partial
    sums without an entry are never read, totals without a mark neither, and entries that are not applied are applied by
    the next call. Several may write entries at a time; one at a time may apply them. Events pair inside one shard.
    """

    def __init__(self, spark: SparkSession, folder: str, variant: Variant, buckets: int = BUCKETS):
        if variant.recent:
            raise ValueError(f"{variant.name} wants recent events alone: each new shard would change all others' scores")
        self.spark, self.folder, self.variant, self.buckets = spark, folder, variant, buckets
        told = json.dumps({**vars(variant), "buckets": buckets}, sort_keys=True)
        if not claim(spark, f"{folder}/made_for", told) and claimed(spark, f"{folder}/made_for") != told:
            raise ValueError(f"{folder} holds an index of other parameters")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("aid_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def entries(self) -> list[dict]:
        """The log, from its beginning."""
        numbers = [x for x in _children(self.spark, f"{self.folder}/log") if not x.startswith("_")]
        if not numbers:
            return []
        rows = self.spark.read.text([f"{self.folder}/log/{x}/claim" for x in numbers], wholetext=True)
        own = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("number"), F.substring_index("value", "\n", -1).alias("told"))
        return [json.loads(r["told"]) for r in own.orderBy("number").collect()]

    def _write(self, entry: dict, still_open) -> bool:
        """entry as the next one in the log, unless by then still_open(active) no longer holds."""
        while still_open(self.active(entries := self.entries())):
            if claim(self.spark, f"{self.folder}/log/{len(entries):09d}", json.dumps(entry)):
                return True
        return False

    def active(self, entries: list[dict] | None = None) -> dict[str, dict]:
        """The entry by which each shard that counts was added, by the shard's digest."""
        out: dict[str, dict] = {}
        for e in self.entries() if entries is None else entries:
            if e["change"] == "add":
                out[e["shard"]] = e
            else:
                out.pop(e["shard"], None)
        return out

    def _add(self, shard: str, path: str) -> bool:
        if shard in self.active():
            return False
        data = uuid.uuid4().hex
        scores = sweep.direct_scores(read_events(self.spark, path), self.variant).select("*", self._bucket())
        scores.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/partials/{data}")
        touched = [int(x.partition("=")[2]) for x in _children(self.spark, f"{self.folder}/partials/{data}") if x.startswith("bucket=")]
        entry = {"change": "add", "shard": shard, "path": path, "data": data, "buckets": touched}
        if self._write(entry, lambda active: shard not in active):
            return True
        remove(self.spark, f"{self.folder}/partials/{data}")
        return False

    def _withdraw(self, shard: str) -> bool:
        if not (known := self.active().get(shard)):
            return False
        return self._write({"change": "withdraw", "shard": shard, "buckets": known["buckets"]}, lambda active: shard in active)

    def add(self, path: str) -> bool:
        """Let the shard at a path count; whether it did not before."""
        (shard, at), = shard_fingerprints(self.spark, path).items()
        new = self._add(shard, at)
        self.apply()
        return new

    def withdraw(self, shard: str) -> bool:
        """Let a shard, named by the digest of its files, count no longer; whether it did before."""
        gone = self._withdraw(shard)
        self.apply()
        return gone

    def follow(self, events_path: str) -> tuple[int, int]:
        """Let exactly the shards of an input count; how many were added and withdrawn. A changed shard is both."""
        now = shard_fingerprints(self.spark, events_path)
        gone = sum(self._withdraw(s) for s in self.active() if s not in now)
        new = sum(self._add(s, at) for s, at in now.items())
        self.apply()
        return new, gone

    def _changes(self, entries: list[dict], done: int) -> list[tuple[int, str, list[int]]]:
        """(1 or -1, where the partial sums lie, their buckets) of the entries from number done on."""
        out, active = [], {}
        for k, e in enumerate(entries):
            if e["change"] == "add":
                sign, added = 1, e
                active[e["shard"]] = e
            else:
                sign, added = -1, active.pop(e["shard"])
            if k >= done:
                out.append((sign, added["data"], added["buckets"]))
        return out

    def _signed(self, sign: int, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCORES).parquet(*paths) if paths else self.spark.createDataFrame([], SCORES)
        return rows.withColumn("score", F.col("score") * sign)

    def apply(self) -> list[int]:
        """Rebuild the buckets that entries touch which are not applied yet; their numbers."""
        entries = self.entries()
        done = max((int(x) for x in _children(self.spark, f"{self.folder}/applied") if not x.startswith("_")), default=0)
        if done == len(entries):
            return []
        totals = json.loads(claimed(self.spark, f"{self.folder}/applied/{done:09d}")) if done else {}
        changes = self._changes(entries, done)
        touched = {b for _, _, buckets in changes for b in buckets}
        before = [f"{self.folder}/totals/{name}/bucket={b}" for b, name in totals.items() if int(b) in touched]
        parts = [self._signed(1, before)]
        parts += [self._signed(sign, [f"{self.folder}/partials/{data}/bucket={b}" for x, data, buckets in changes if x == sign for b in buckets]) for sign in (1, -1)]
        now, path = uuid.uuid4().hex, f"{self.folder}/totals"
        sums = covisit.merge_scores(*parts).where("score <> 0")  # weights are positive: a sum of 0 is a pair that is gone
        sums.select("*", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{now}")
        filled = {int(x.partition("=")[2]) for x in _children(self.spark, f"{path}/{now}") if x.startswith("bucket=")}
        if filled:
            best = covisit.topk_per_key(self._signed(1, [f"{path}/{now}/bucket={b}" for b in sorted(filled)]), self.variant.topk)
            lists = covisit.candidate_index(best).select("*", self._bucket())
            lists.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/index")
        for b in touched - filled:
            remove(self.spark, f"{self.folder}/index/bucket={b}")
        totals = {b: name for b, name in totals.items() if int(b) not in touched} | {str(b): now for b in filled}
        claim(self.spark, f"{self.folder}/applied/{len(entries):09d}", json.dumps(totals))
        for name in set(_children(self.spark, path)) - set(totals.values()):
            remove(self.spark, f"{path}/{name}")
        return sorted(touched)

    def index(self) -> DataFrame:
        """(aid_key, candidates, scores) over the shards that count, as far as entries are applied."""
        if not any(x.startswith("bucket=") for x in _children(self.spark, f"{self.folder}/index")):
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(StructType([*INDEX.fields, StructField("bucket", IntegerType())])).parquet(f"{self.folder}/index").drop("bucket")


class RecencyStore:
    """The last time of each session and item, by shard, under a folder that driver and executors share.

    data/*/shard=*/ hold (session, aid, ts); shards/ tells for the digest of each shard where its rows lie. A shard whose
    files have changed has another digest, and is read anew; all others are not read again. The latest of last times is
    the last time over all shards, so that a session may lie in several.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def update(self, events_path: str, type_codes: bool | None = None) -> list[str]:
        """Store what is missing for the shards of an input; their paths."""
        known = set(_children(self.spark, f"{self.folder}/shards"))
        missing = [(s, path) for s, path in shard_fingerprints(self.spark, events_path).items() if s not in known]
        for at in range(0, len(missing), _AT_ONCE):
            data, rows = uuid.uuid4().hex, None
            for shard, path in missing[at : at + _AT_ONCE]:
                own = prepare.with_keys(read_events(self.spark, path, None, type_codes)).select(F.lit(shard).alias("shard"), "session", "aid", "ts")
                rows = own if rows is None else rows.unionByName(own)
            last = rows.groupBy("shard", "session", "aid").agg(F.max("ts").alias("ts"))
            last.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.folder}/data/{data}")
            for shard, _ in missing[at : at + _AT_ONCE]:
                claim(self.spark, f"{self.folder}/shards/{shard}", data)
        return [path for _, path in missing]

    def last_times(self, events_path: str, type_codes: bool | None = None) -> DataFrame:
        """(session, aid, ts) of the shards of an input: one row for each shard that has the session and the item."""
        self.update(events_path, type_codes)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [f"{self.folder}/data/{claimed(self.spark, f'{self.folder}/shards/{s}')}/shard={s}" for s in shard_fingerprints(self.spark, events_path)]
        filled = [p for p in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]  # a shard may have no events
        schema = StructType([StructField(c, LongType()) for c in ("session", "aid", "ts")])
        return self.spark.read.schema(schema).parquet(*filled) if filled else self.spark.createDataFrame([], schema)

    def recent_items(self, events_path: str, topk: int = TOP_ITEMS, type_codes: bool | None = None) -> DataFrame:
        """recommend.recent_items over all shards of an input."""
        return recommend.recent_items(self.last_times(events_path, type_codes), topk)
