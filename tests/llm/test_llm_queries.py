"""The registered queries, column by column, against plain Python over whole tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from clickloom.llm import pii, quality_cnn, quality_rules, queries
from tests.llm.conftest import ODD
from tests.llm.test_text import _base, _components, _fingerprint, _license_row, _ratio, _spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels of the smallest scale with odd rows: nulls, repeats, an id that no double holds."""
    at = str(tmp_path_factory.mktemp("tables"))
    more = spark.createDataFrame([(None if i is None else 10_000 + i, t) for i, t in ODD] + [((1 << 60) + 1, "call +1 415 555 1234, MIT license")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(more, allowMissingColumns=True)
    docs.coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op1(spark, folder, docs):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weights = quality_rules.ratio_weights(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("quality = 1"))
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for i, text in docs:
        grams, _ = _ratio(text, weights)
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    n, s = quality_rules.BUCKETS, quality_rules.SMOOTHING
    mine = [np.log((target[b] + s) / (sum(target.values()) + s * n)) - np.log((raw[b] + s) / (sum(raw.values()) + s * n)) for b in range(n)]
    want = Counter()
    for i, text in docs:
        *counts, failed = _base(text)
        want[i, *counts, failed, not failed and _ratio(text, mine)[1] >= quality_rules.THRESHOLD] += 1
    rows = queries.op1_quality_rules(spark, folder).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(tuple(r[c] for c in columns) for r in rows) == want


def test_op3(spark, folder, docs):
    rows = queries.op3_quality_cnn(spark, folder).collect()
    model = quality_cnn.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    logits = quality_cnn._logits([(t or "").encode() for _, t in docs], model, model.tables())
    scores = {}
    for (i, _), x in zip(docs, logits, strict=True):
        scores.setdefault(i, []).append(1 / (1 + np.exp(-x)))
    got = {}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got.keys() == scores.keys() and all(np.allclose(sorted(got[i]), sorted(scores[i]), atol=1e-6) for i in got)


def test_op4(spark, folder, docs):
    want = Counter()
    for i, text in docs:
        base = _spans(text)
        kinds = Counter(x.partition(":")[0] for x in base.split(",") if x)
        want[i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(base.encode()).hexdigest()] += 1
    rows = queries.op4_pii(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    own = {k.name for k in pii.KINDS if k.own}
    order = [k.name for k in pii.KINDS]
    for r in rows:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert hashlib.sha256(",".join(":".join(x) for x in spans if x[0] in own).encode()).hexdigest() == r["base_sha256"]
        assert spans == sorted(spans, key=lambda x: (order.index(x[0]), int(x[1])))


def _remainder(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_op4_ibans_against_brute_force(spark, tmp_path):
    """IBANs without blanks, between other words: every token of that shape with remainder 1, and no other."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(300):
        words = []
        for _ in range(6):
            body = "".join(rng.choice(list("0123456789ABC"), rng.integers(11, 31)))
            good = next(f"DE{k:02d}{body}" for k in range(2, 99) if _remainder(f"DE{k:02d}{body}") == 1)
            words.append(good if rng.random() < 0.5 else good[:-1] + ("1" if good[-1] != "1" else "2"))
        texts.append(" é ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op4_pii(spark, str(tmp_path)).collect():
        at, want = 0, []
        for w in texts[r["doc_id"]].split(" é "):
            want += [f"iban:{at}:{at + len(w)}"] if _remainder(w) == 1 else []
            at += len(w) + 3
        assert [x for x in r["spans"].split(",") if x.startswith("iban")] == want


def test_op8(spark, folder, docs):
    rows = queries.op8_license_scan(spark, folder).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    assert got == Counter((i, *_license_row(t)) for i, t in docs)
    assert all(0 <= r["score"] <= 1 and (r["labels"] == "") == (r["base_labels"] == "" and r["labels"] == "") and r["labels"].split(",") == sorted(set(r["labels"].split(","))) for r in rows)


def test_op10(spark, folder, docs):
    rows = queries.op10_simhash_dedup(spark, folder).collect()
    fps = {}
    for _, text in docs:
        fps.setdefault(text, _fingerprint(text))
    marked = [(i, fps[t]) for i, t in docs]
    distinct = sorted(set(fps.values()))
    root = dict(zip(distinct, _components(distinct), strict=True))
    least = {}
    for i, fp in marked:
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    want = Counter((i, f"{fp:016x}", least.get(root[fp])) for i, fp in marked)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want


def test_entry_knows_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{k}" for k in range(1, 11)} <= {n.partition("_")[0] for n in names} and "pipeline" in names
