"""Spelling variants against a brute-force version."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from clickloom.llm import queries, spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute_counts(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def _brute_groups(counts):
    near = {w: [o for o in counts if o != w and _near(w, o)] for w in counts}
    best = {w: min(os, key=lambda o: (-counts[o], o)) for w, os in near.items() if os}
    form = {w: o for w, o in best.items() if counts[o] >= 10 * counts[w]}
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=lambda r: r[0])


def _edit(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + ("" if kind == 0 else rng.choice(letters)) + word[i + (kind != 2) :]


def _vocabulary(rng, letters, roots, sizes=(7, 16)):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))) for _ in range(roots)}
    for w in list(words):
        for _ in range(rng.randrange(6)):
            w = _edit(rng, w, letters)
            words.add(w)
    return {w: rng.choice([2, 3, 30, 40, 300, 3000]) for w in sorted(words) if len(w) >= 2}


@pytest.mark.parametrize("letters,sizes,hot", [("abéü", (7, 10), 512), ("ab", (3, 9), 8), ("abcdefghijklmnopqrstuvwxyzß", (7, 16), 512), ("ab", (60, 70), 4)])
def test_groups_against_brute_force(spark, letters, sizes, hot):
    counts = _vocabulary(random.Random(9), letters, 150, sizes)
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), hot_key=hot).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == _brute_groups(counts)


def test_each_pair_comes_once(spark):
    counts = _vocabulary(random.Random(4), "ab", 60, (4, 9))
    got = [(r["word"], r["other"]) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), hot_key=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in counts for b in counts if a != b and _near(a, b)}


def test_hot_keys_are_cut(spark):
    """Thousands of words with one beginning: few pairs meet at one key, and all near ones are found."""
    rng = random.Random(2)
    words = sorted({"internat" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)})
    words += [_edit(rng, w[8:], "abcdefghij") and w[:8] + _edit(rng, w[8:], "abcdefghij") for w in words[:50]]
    words = sorted(set(words))
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    keyed = spelling._halved(spelling._placed(rows))
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] > 2000
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    want = {(a, b) for s in gaps.values() for a in s for b in s if a != b}
    known = set(words)
    want |= {p for (_, rest), s in gaps.items() if rest in known for w in s for p in ((w, rest), (rest, w))}
    got = spelling.near_words(rows, hot_key=64)
    assert {(r["word"], r["other"]) for r in got.collect()} == want


def test_counts_and_query(spark, tmp_path):
    rng = random.Random(8)
    common = ["Weaving", "ÜBERALL", "threads", "Loomwork", "façade×÷", "naïvetés", "shuttle", "warping"]
    docs = [(i, " ".join(rng.choice(common) + rng.choice([" ", "-", "1", "ā"]) for _ in range(60))) for i in range(200)]
    docs += [(200, None), (201, ""), (None, "shuttle shuttle"), (202, "q" * 5000 + " " + "q" * 5000), (203, "q" * 4999 + "z " + "q" * 4999 + "z"), (3, docs[3][1])]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = _brute_counts(docs)
    assert dict(map(tuple, spelling.count_words(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())) == counts
    got = queries.op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == _brute_groups(counts)
    assert any(r["form"] for r in got) and any(r["n_near"] and not r["form"] for r in got)


def test_small_portions_make_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"weaving threads {'loom' * (i % 5 + 2)}") for i in range(100)], "doc_id long, text string")
    whole = dict(map(tuple, spelling.count_words(docs).collect()))
    monkeypatch.setattr(spelling, "_COUNTED", 1)
    assert dict(map(tuple, spelling.count_words(docs).collect())) == whole


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.count_words(none)).collect() == []
    bad = spark.sql("SELECT 1L AS doc_id, cast(concat(X'77656176696E67FF', X'77656176696E67') AS string) AS text")
    assert [tuple(r) for r in spelling.count_words(bad, typo=10**9).collect()] == [("weaving", 2)]
    one = spelling.group_variants(spark.createDataFrame([("weaving", 2)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("weaving", None, "weaving", 2, 0, None)]


def test_chains_of_forms(spark):
    rows = [("aaaaaaaa", 2), ("aaaaaaab", 20), ("aaaaaabb", 200), ("aaaaabbb", 2000), ("aaaabbbb", 20_000), ("aaabbbbb", 200_000)]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r["root"] for r in got} == {"aaabbbbb"}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_keys_stay_whole_behind_the_cut(spark, broadcast):
    """Hot keys among many others: whichever way Spark drops them, the words of one key that stay reach one task."""
    rng = random.Random(12)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(7, 9))) for _ in range(6000)}
    words |= {"".join(rng.choice("efghijkl") for _ in range(rng.randrange(7, 9))) for _ in range(20_000)}
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    pairs = {(a, b) for s in gaps.values() for a in s for b in s if a != b} | {p for (_, rest), s in gaps.items() if rest in words for w in s for p in ((w, rest), (rest, w))}
    rows = spelling.cut(spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long").repartition(7))
    settings = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = [(r["word"], r["other"]) for r in spelling.near_words(rows, hot_key=40).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(set(got)) and set(got) == pairs
