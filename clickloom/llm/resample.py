"""Importance resampling: documents drawn so that their words come to be distributed as in a target.

Features are runs of one or more words, hashed into buckets by CRC-32. A task keeps the words that it meets in a trie: a
node stands for a run, and holds the CRC of the run so far, from which the next word goes on, and how often the run came.
Totals of buckets are added up over tasks; a document is then scored by walking its words along a trie whose nodes hold
the gains of their buckets. Gumbel noise from a document's id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import cut, sliced
from clickloom.operators.ranges import numbered

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Nodes of a task's trie, beyond which its counts are added to the buckets, and it begins anew.
MOST_NODES = 200_000
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of digits, letters and whatever is beyond ASCII, A-Z lowered. Null has none."""
    return text.translate(_WORD).split() if text else []


class Node(dict):
    """A run of words: its longer runs by their last word."""

    __slots__ = ("count", "crc", "trie", "value")

    def __init__(self, trie: Trie, crc: int):
        self.trie, self.crc, self.count = trie, crc, 0
        self.value = trie.gains[crc % trie.buckets] if trie.gains else 0
        trie.size += 1

    def __missing__(self, word: bytes) -> Node:
        """The run that goes on with word: its CRC goes on from this one's."""
        found = self[word] = Node(self.trie, crc32(word, crc32(b" ", self.crc)) if self is not self.trie.root else crc32(word))
        return found


class Trie:
    def __init__(self, buckets: int, gains: list[int] | None = None):
        self.buckets, self.gains, self.size = buckets, gains, 0
        self.root = Node(self, 0)

    def add(self, runs: Counter) -> None:
        """Runs (tuples of words) and how often they came."""
        for run, n in runs.items():
            node = self.root
            for word in run:
                node = node[word]
            node.count += n

    def totals(self) -> np.ndarray:
        """How often runs of each bucket came."""
        out, wait = np.zeros(self.buckets, np.int64), [self.root]
        while wait:
            for node in wait.pop().values():
                out[node.crc % self.buckets] += node.count
                if node:
                    wait.append(node)
        return out

    def walk(self, found: list[bytes], longest: int) -> int:
        """The gains of all runs of up to longest words of a text, added up."""
        root = self.root
        if longest == 1:
            return sum([root[w].value for w in found])
        total = 0
        for i in range(len(found)):
            node = root
            for word in found[i : i + longest]:
                node = node[word]
                total += node.value
        return total


def _counted(longest: int, buckets: int):
    """mapInArrow over (text as bytes): (bucket, n), once for each bucket that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie = np.zeros(buckets, np.int64), Trie(buckets)
        for batch in sliced(batches):
            runs = Counter()
            for text in batch.column("text").to_pylist():
                found = words(text)
                for k in range(1, longest + 1):
                    runs.update(zip(*[found[i:] for i in range(k)], strict=False))
            trie.add(runs)
            if trie.size > MOST_NODES:
                total, trie = total + trie.totals(), Trie(buckets)
        total += trie.totals()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket. Only a row a bucket reaches the driver."""
    counted = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_counted(longest, buckets), "bucket int, n long")
    out = [0] * buckets
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """Of each bucket 1000 times the log of how much likelier the target makes it, rounded down; counts are raised by 1."""
    all_raw, all_target = float(sum(raw) + len(raw)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw, target, strict=True)]


def noise(doc_id: str, seed: int) -> int:
    """Gumbel noise, times 1000 and rounded down, from the hash of an id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: list[int], longest: int, seed: int):
    """mapInArrow over (name, text as bytes, id): counts, weight and score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(gains), gains)
        for batch in sliced(batches):
            rows = []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                n = sum(max(0, len(found) - k) for k in range(longest))
                weight = trie.walk(found, longest) // n if n else 0
                rows.append((len(found), n, weight, weight + noise(name, seed)))
                if trie.size > MOST_NODES:
                    trie = Trie(len(gains), gains)
            made = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(made[:, k]) for k in range(4))], names=["id", "n_words", "n_features", "weight", "score"])

    return run


def score(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) for every row of docs.

    weight: the mean gain of the row's features, rounded down, 0 where it has none; score: weight and noise. Null texts
    have no words; bytes that are no UTF-8 count as letters; the noise of a null id is that of an empty one.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(_scored(gains, longest, seed), f"id {kind}, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: of the rows with at least least_words words, so many percent, rounded down, of the highest scores
    are drawn and ranked from 1, ties to the lesser id (a null id is the least), copies in any order; others have null.

    scored is computed once and kept in the shared folder. Ranks come from ranges of scores, so that no task sorts all.
    """
    kept = cut(scored.withColumns({"order": -F.col("score"), "place": F.monotonically_increasing_id()}))
    able = kept.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, ["order", "id", "place"], int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(kept.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("order", "place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of docs, drawn towards the texts of target.

    Counts cover all rows of both tables, repeated ones as often as they come. Other columns are not read; an empty
    table of documents gives an empty one, an empty target makes all gains follow the raw counts alone.
    """
    gains = bucket_gains(bucket_totals(docs, text_col, longest, buckets), bucket_totals(target, target_col, longest, buckets))
    return draw(score(docs, gains, id_col, text_col, longest, seed), percent, least_words)
