"""Importance resampling against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from clickloom.llm import queries, resample

SCHEMA = "doc_id long, text string, id long, rank string"


def _features(text, longest=1):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return [" ".join(found[i : i + k]) for i in range(len(found)) for k in range(1, longest + 1) if i + k <= len(found)], len(found)


def _brute(docs, target, longest=1, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    raw, want = (Counter(bucket(f) for t in texts for f in _features(t, longest)[0]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(raw.values()) + 10_000, sum(want.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * s_all / ((raw[b] + 1) * t_all)))
    rows = []
    for i, text in docs:
        found, n_words = _features(text, longest)
        weight = math.floor(sum(gain(bucket(f)) for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[5] = k + 1
    return rows


def _docs():
    rng = random.Random(3)
    vocabulary = ["Loom", "weft", "thread", "über", "日本", "x1", "and", "OF", "İ", "é"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -", "\t"]) for _ in range(n))
    texts = [None, "", "  ,. ", "one", prose(19), prose(20), prose(20_000), "z" * 50_000] + [prose(rng.randrange(5, 60)) for _ in range(150)]
    return list(enumerate(texts)) + [(7, "copy " * 25), (7, "copy " * 25), (None, prose(30))]


def _key(r):
    return tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("longest", [1, 3])
def test_brute_force(spark, longest):
    docs, target = _docs(), ["thread of the loom", "weft and thread", None, ""] * 20
    frame = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], SCHEMA).repartition(5)
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest).collect()
    assert sorted((list(r) for r in got), key=_key) == sorted(_brute(docs, target, longest), key=_key)


def test_a_small_trie_makes_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame(_docs(), "doc_id long, text string")
    target = spark.createDataFrame([("thread of the loom",)], "text string")
    whole = sorted(map(tuple, resample.resample(docs, target, longest=2).collect()), key=_key)
    monkeypatch.setattr(resample, "MOST_NODES", 3)
    monkeypatch.setattr("clickloom.llm.shared.SLICE", 100)
    assert sorted(map(tuple, resample.resample(docs, target, longest=2).collect()), key=_key) == whole


def test_nodes_hold_counts_and_crcs():
    trie = resample.Trie(64)
    trie.add(Counter({(b"a",): 3, (b"a", b"b"): 2}))
    node = trie.root[b"a"]
    assert (node.count, node.crc) == (3, zlib.crc32(b"a")) and (node[b"b"].count, node[b"b"].crc) == (2, zlib.crc32(b"a b"))
    totals = trie.totals()
    assert totals.sum() == 5 and totals[zlib.crc32(b"a b") % 64] >= 2


def test_edges(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert [r["rank"] for r in resample.resample(some, none).collect()] == [None]
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61FF6220C3' AS string) AS text")
    assert resample.resample(bad, some).first()["n_words"] == 2


def test_one_id_in_every_row(spark):
    """A hot id: equal scores are still ranked 1, 2, 3 ..."""
    docs = spark.range(400).selectExpr("7L AS doc_id", "repeat('same words here ', 10) AS text").repartition(6)
    got = resample.resample(docs, docs).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41))


def test_query(spark, tmp_path):
    docs = [(i, t) for i, t in _docs() if i is not None][:-2]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "weft of the loom")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = [[r[0], *r[2:]] for r in _brute(docs, ["weft of the loom"])]
    assert sorted((list(r) for r in got.collect()), key=_key) == sorted(want, key=_key)
