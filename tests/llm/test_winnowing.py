"""Winnowing against a brute-force version, and the edits that its query makes."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clickloom.llm import queries, winnowing


@pytest.fixture(scope="module")
def hashed(spark):
    """The library's hash of a gram, from Spark, for the brute-force version."""

    def of(grams):
        rows = spark.createDataFrame([(g,) for g in sorted(set(grams))], "g string")
        return {r["g"]: r["h"] for r in rows.select("g", F.expr("shiftrightunsigned(xxhash64(encode(g, 'UTF-32')), 32)").alias("h")).collect()}

    return of


def _grams(text):
    k = winnowing.GRAM
    return [text[i : i + k] for i in range(max(1, len(text) - k + 1))]


def _brute(text, hashes):
    """Of each window the least hash, the rightmost of equal ones."""
    found = [hashes[g] for g in _grams(text)]
    width = 1 if len(found) < 16 else 4 if len(found) < 64 else winnowing.WINDOW
    picked = set()
    for i in range(len(found) - width + 1):
        least = min(found[i : i + width])
        picked.add((least, max(j for j in range(i, i + width) if found[j] == least)))
    return sorted(picked, key=lambda x: x[1])


def _likeness(a, b):
    a, b = {x[0] for x in a}, {x[0] for x in b}
    return len(a & b) / len(a | b)


def _texts():
    rng = random.Random(5)
    words = ["loom", "über", "naïve", "日本語", "thread", "weft", "a", "𝒳𝒴", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [None, "", "a", "abcd", "abcdefgh", "abcdefghi", "x" * 400, "ab" * 150, prose(3), prose(6), prose(20), prose(60), prose(60), prose(400), prose(3000), "same text of some length, twice", "same text of some length, twice"]


def test_brute_force(spark, hashed):
    texts = _texts()
    rows = winnowing.compare_with_edits(spark.createDataFrame([(3 * i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, next string").repartition(3)).collect()
    texts = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    hashes = hashed([g for t in texts + edited for g in _grams(t)])
    got = {r["id"] // 3: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        own, other, after = (_brute(x, hashes) for x in (t, edited[i], texts[(i + 1) % len(texts)]))
        assert got[i]["n_chars"] == len(t) and got[i]["edited"] == edited[i]
        assert [tuple(x) for x in got[i]["prints"]] == own
        assert [tuple(x) for x in got[i]["edited_prints"]] == other
        assert got[i]["near_edited"] == pytest.approx(_likeness(own, other))
        assert got[i]["near_next"] == pytest.approx(_likeness(own, after))


def test_shared_passages_share_a_fingerprint(spark):
    """Any shared passage of GRAM + WINDOW - 1 code points gives both texts a fingerprint of one hash inside it."""
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    least = winnowing.GRAM + winnowing.WINDOW - 1
    rows = []
    for i in range(40):
        passage = draw(least)
        for k in range(2):
            head = draw(rng.randrange(100, 300))
            rows.append((2 * i + k, head + passage + draw(200), len(head)))
    begins = {r[0]: r[2] for r in rows}
    found = {r["id"]: r["prints"] for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, at long")).collect()}
    for i in range(40):
        inside = [{x["hash"] for x in found[d] if begins[d] <= x["place"] <= begins[d] + winnowing.WINDOW - 1} for d in (2 * i, 2 * i + 1)]
        assert inside[0] & inside[1]


def test_stretches_make_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    columns = ["id", "edited", "packed", "edited_packed"]
    whole = sorted(map(tuple, winnowing.compare_packed(docs).select(*columns).collect()), key=lambda r: r[0])
    monkeypatch.setattr(winnowing, "_STRETCH", 64)
    assert sorted(map(tuple, winnowing.compare_packed(docs).select(*columns).collect()), key=lambda r: r[0]) == whole


def test_a_very_long_text(spark):
    """8 million code points: the fingerprints are about an eighth of them, and the rest is not held at once."""
    docs = spark.range(1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1000000), x -> substr(sha2(cast(x AS string), 256), 1, 7)), ' ') AS text")
    row = winnowing.fingerprints(docs).selectExpr("n_chars", "size(prints) AS n").first()
    assert row["n_chars"] == 7_999_999 and 0.1 < row["n"] / row["n_chars"] < 0.14


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert winnowing.compare_with_edits(none).collect() == [] and winnowing.fingerprints(none).collect() == []
    one = winnowing.compare_with_edits(spark.createDataFrame([(5, "one document alone")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited"] == "one document aone d"[: len("one document alone") - 4] + "one "
    # null ids, one id many times, copies of one row
    rows = [(None, "null id"), (None, "another null id")] + [(7, f"text {i % 3}") for i in range(60)] + [(8, "last")]
    found = winnowing.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(((r["id"] is None, r["id"] or 0, r["n_chars"]) for r in found)) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    assert all(r["near_next"] is not None and r["edited"] is not None for r in found)
    bad = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.expr("cast(X'61FF62' AS string)").alias("text"))
    assert winnowing.fingerprints(bad).first()["n_chars"] == 3


def test_texts_are_moved_once_and_no_python_runs(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(300)], "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = winnowing.compare_with_edits(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert found.where("near_next IS NULL").count() == 0


def test_query(spark, tmp_path):
    texts = _texts()
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_winnowing(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}
    whole = [t or "" for t in texts]
    for i, r in enumerate(got):
        t, after = whole[i], whole[(i + 1) % len(whole)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        for j, other in enumerate(got):
            assert (r["fingerprint"] == other["fingerprint"]) == (t == whole[j])
