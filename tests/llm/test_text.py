"""Quality rules, personal data, classifier, licences and fingerprints against plain Python."""

from __future__ import annotations

import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import licenses, pii, quality_cnn, quality_rules, simhash
from clickloom.llm.components import connected_components
from clickloom.llm.text_ids import encoder

WORD = re.compile("[^\x20\x09-\x0d]+")


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _ratio(text, weights):
    hashes = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    n = quality_rules.BUCKETS
    two = []
    for a, b in zip(hashes, hashes[1:], strict=False):
        seed = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        two.append(_signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed)) % n)
    grams = [h % n for h in hashes] + two
    return grams, sum(weights[g] for g in grams) / len(grams) if grams else 0.0


def test_quality_rules(spark, odd, some):
    docs = some.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    trusted = some.where("doc_id % 2 = 0").select("doc_id")
    weights = quality_rules.ratio_weights(docs, trusted.union(trusted))
    raw, target = Counter(), Counter()
    for r in docs.collect():
        grams, _ = _ratio(r["text"], weights)
        raw.update(grams)
        if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["doc_id"] in {x["doc_id"] for x in trusted.collect()}:
            target.update(grams)
    n, s = quality_rules.BUCKETS, quality_rules.SMOOTHING
    want = np.log([(target[b] + s) / (sum(target.values()) + s * n) for b in range(n)]) - np.log([(raw[b] + s) / (sum(raw.values()) + s * n) for b in range(n)])
    assert np.allclose(weights, want)
    for r in docs.select("text", quality_rules.rules(F.col("text"), weights).alias("r")).collect():
        got, base = r["r"], _base(r["text"])
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["base_failed"]) == base
        assert np.isclose(got["llr"], _ratio(r["text"], weights)[1])
        assert got["kept"] == (not base[5] and got["llr"] >= quality_rules.THRESHOLD)


def test_quality_rules_edges(spark, odd, some):
    assert quality_rules.judge(odd.limit(0), odd.select("doc_id")).count() == 0
    assert quality_rules.judge(odd, odd.select("doc_id").limit(0)).count() == odd.count()
    kept = quality_rules.keep_good(odd.unionByName(some, allowMissingColumns=True), some.select("doc_id"))
    assert kept.columns == odd.columns and 0 < kept.count() < some.count()


@pytest.mark.parametrize("ids", ["doc_id", "concat('d', doc_id)"])
def test_texts_meet_trusted_ids_either_way(spark, odd, some, monkeypatch, ids):
    docs = some.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    trusted = odd.unionByName(some, allowMissingColumns=True).where("doc_id IS NULL OR doc_id % 3 = 0").selectExpr(f"{ids} AS doc_id")
    docs = docs.selectExpr(f"{ids} AS doc_id", "text")
    plan = lambda: quality_rules._marked(docs, trusted, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    near = quality_rules.ratio_weights(docs, trusted)
    assert "BroadcastHashJoin" in plan() and "Exchange hashpartitioning" not in plan()
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 1_000)
    far = quality_rules.ratio_weights(docs, trusted)
    assert "ShuffledHashJoin" in plan() and "Broadcast" not in plan() and "Sort" not in plan()
    assert near == far and any(near)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits))) % 10 == 0


def _spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if good else []
    return ",".join(out)


def test_pii(spark, odd, some):
    texts = [
        "é a@b.c.d_x@d.com a@b a.b@c..d x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.2.3", "4111-1111 1111 1111, 4111111111111111 5", "+1 (415) 555-1234 +1+2 +12345678 +123456789. +49 30 123456-",
        " ".join(f"a{i}@b{i}.com" for i in range(400)), "1." * 3000, "+1" + "(" * 3000, "a@" + "b." * 3000,
    ]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice(list("ab@..--++ ()0123456789é_%"), 60)) for _ in range(300)]
    docs = some.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string"))
    rows = docs.select("text", pii.spans(F.col("text")).alias("s")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["s"] if s["base"]) == _spans(r["text"])


def test_pii_more_kinds_and_redaction(spark, odd):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 x GB82WEST12345698765432 DE89370400440532013001"), (2, "ssn 123-45-6789 and 123-45-6789"), (3, f"token = {'a1' * 20} 😀 {'a1' * 20}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert found == {1: [("iban", 5, 32), ("iban", 35, 57)], 2: [("ssn", 4, 15)], 3: [("secret", 8, 48)]}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == "IBAN <IBAN> x <IBAN> DE89370400440532013001" and clean[3] == f"token = <SECRET> 😀 {'a1' * 20}"
    over = spark.createDataFrame([("w a@1.2.3.4 é +4222222222222.",)], "text string")
    assert pii.redact(over).first()["text"] == "w <EMAIL> é <PHONE>."
    same = pii.redact(odd)
    assert same.columns == odd.columns and {(r["doc_id"], r["text"]) for r in same.collect()} == {(r["doc_id"], r["text"]) for r in odd.collect()}


def test_classifier(spark, odd):
    good = [(i, f"{'the quiet river runs past old stone houses ' * (1 + i % 7)}{i}") for i in range(0, 240, 2)]
    bad = [(i, f"{'BUY!! NOW!! $$$ CHEAP!! ' * (1 + i % 5)}{i}") for i in range(1, 240, 2)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_cnn.fit(docs, labels)
    rows = quality_cnn.score(docs, model).withColumn("out", quality_cnn.held_out(F.col("id"))).where("out").collect()
    assert len(rows) > 20 and all((r["score"] >= 0.5) == (r["id"] % 2 == 0) for r in rows)
    # long texts go through in pieces, with the same result as at once
    tables = model.tables()
    long = (good[0][1] * 20_000).encode()[: 3 * quality_cnn._SLAB + 77]
    whole = quality_cnn._logits([long], model, tables)[0]
    slab, quality_cnn._SLAB = quality_cnn._SLAB, 1 << 22
    assert np.isclose(whole, quality_cnn._logits([long], model, tables)[0])
    quality_cnn._SLAB = slab
    scored = quality_cnn.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality_cnn.score(odd.limit(0), model).count() == 0
    one = quality_cnn.fit(docs, labels.where("quality = 1"))
    assert 0.5 < quality_cnn.score(docs, one).first()["score"] < 1
    assert quality_cnn.fit(docs, labels.limit(0)).offset == 0


def _naive_logit(raw, m):
    """One text, window by window."""
    if not raw:
        return m.offset
    padded = raw + bytes(2 * quality_cnn.WIDTH)
    value = lambda at: sum(m.embedding[padded[at + k]] @ m.filters[k] for k in range(quality_cnn.WIDTH))
    windows = {at: value(at) for at in range(0, len(raw), 2)}
    tops = []
    for at in range(0, max(1, len(raw) - quality_cnn.BLOCK), quality_cnn.BLOCK):
        own = [windows[x] for x in range(at, min(at + 2 * quality_cnn.BLOCK, len(raw)), 2)]
        tops.append(np.maximum(np.max(own, axis=0) + m.bias, 0) @ m.out)
    return m.offset + np.mean(tops)


def _some_model(rng):
    return quality_cnn.Model(**{k: v for k, v in quality_cnn.start(0.7, rng).items() if k != "offset"}, offset=0.3)


def test_scores_against_a_naive_forward_pass(monkeypatch):
    rng = np.random.default_rng(12)
    model = _some_model(rng)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 7, 8, 9, 255, 256, 257, 511, 512, 513, 514, 1024, 1500)]
    want = [_naive_logit(t, model) for t in texts]
    for slab in (1 << 18, 512):
        monkeypatch.setattr(quality_cnn, "_SLAB", slab)
        assert np.allclose(quality_cnn._logits(texts, model, model.tables()), want, atol=1e-4)
    # what is learned from is what is scored: chunk by chunk the same value
    for raw, logit in zip(texts, want, strict=True):
        chunks, lengths = quality_cnn.chunks_of(raw)
        _, top = quality_cnn._tops(np.frombuffer(b"".join(chunks), np.uint8).reshape(len(chunks), -1), np.array(lengths), model.tables(np.float64))
        h = np.maximum(np.where(np.isfinite(top), top + model.bias, 0), 0)
        assert np.isclose(model.offset + (h @ model.out).mean(), logit)


def test_scoring_many_texts_takes_the_memory_of_a_few():
    model = _some_model(np.random.default_rng(13))
    tables, texts = model.tables(), pd.Series(["the quiet river runs past old stone houses " * 60] * 6000)  # 15 MB
    tracemalloc.start()
    try:
        own = tracemalloc.get_traced_memory()[0]
        out = pd.concat(quality_cnn.scorer(model).func(iter([texts])))
        peak = tracemalloc.get_traced_memory()[1] - own - tables.nbytes
    finally:
        tracemalloc.stop()
    assert len(out) == 6000 and out.nunique() == 1 and peak < 12 << 20, peak


def test_scoring_gives_up_what_encoders_hold():
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = encoder(path)
    assert encoder(path) is kept
    list(quality_cnn.scorer(_some_model(np.random.default_rng(14))).func(iter([pd.Series(["a b"])])))
    assert encoder(path) is not kept and encoder(path).encode("a b").tolist() == kept.encode("a b").tolist()


def test_gradient_against_differences():
    rng = np.random.default_rng(13)
    p = quality_cnn.start(0.6, rng)
    p["bias"] += 0.5
    parts = [quality_cnn.chunks_of(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (0, 40, 700, 1300)]
    raw = np.frombuffer(b"".join(c for x, _ in parts for c in x), np.uint8).reshape(-1, 2 * quality_cnn.BLOCK + quality_cnn.WIDTH)
    lengths, owner = np.array([n for _, x in parts for n in x]), np.repeat(np.arange(4), [len(x) for x, _ in parts])
    args = raw, lengths, owner, np.array([0.0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5])
    _, grad = quality_cnn.loss_and_gradient(p, *args, kind=np.float64)
    for name in p:
        size = p[name].size
        for at in rng.choice(size, min(size, 12), replace=False):
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: np.array(v, np.float64) for k, v in p.items()}
                moved[name].reshape(-1)[at] += step
                ends.append(quality_cnn.loss_and_gradient(moved, *args, kind=np.float64)[0])
            assert np.isclose((ends[0] - ends[1]) / 2e-6, np.array(grad[name]).reshape(-1)[at], atol=1e-6), name


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    out = {r["doc_id"] for r in docs.where(quality_cnn.held_out(F.col("doc_id"))).collect()}
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - q if i in out else q) for i, q in labels]
    a, b = (quality_cnn.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(a.out, b.out) and a.offset == b.offset


def test_licenses(spark, odd, some):
    automaton = licenses.Automaton(licenses.PHRASES, licenses.TEMPLATES)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice("mit license apache general public licence the of MIT License, gnu é x".split(), 40)) for _ in range(200)]
    docs = some.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string"))
    rows = docs.select("text", "doc_id").collect()
    want = Counter()
    for r in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(r["text"] or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want[r["doc_id"], len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))] += 1
    got = licenses.summary(licenses.scan(docs)).collect()
    assert Counter((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    notice = spark.createDataFrame([(1, "x " + licenses.TEMPLATES["bsd"][0].replace("modification", "changes") + " y"), (2, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    found = {r["id"]: (r["labels"], r["score"]) for r in licenses.summary(licenses.scan(notice)).collect()}
    assert found[1][0] == "bsd" and 0.9 < found[1][1] < 1 and found[2] == ("cc-by-nc", 1.0)
    assert licenses.scan(odd.limit(0)).count() == 0
    # matching statistics against all substrings
    every = {tuple(w[i:j]) for w, _ in automaton.templates + automaton.phrases for i in range(len(w)) for j in range(i + 1, min(len(w), i + 45) + 1)}
    for _ in range(150):
        parts = [automaton.templates[k][0] for k in rng.integers(0, len(automaton.templates), 2)]
        text = [w for p in parts for i in [rng.integers(0, len(p))] for w in [*p[i : i + rng.integers(1, 20)], *[b"zzz"] * rng.integers(0, 2)]]
        best = [max([n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in every], default=0) for e in range(len(text))]
        expected = [(e + 1 - n, n) for e, n in enumerate(best) if n > 1 and (e + 1 == len(text) or best[e + 1] != n + 1)]
        assert [(a, n) for a, n, _ in automaton.scan(text)[1]] == expected


def _scan(spark, texts, **given):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: r for r in licenses.scan(docs, **given).collect()}


def test_one_word_phrases(spark):
    got = _scan(spark, ["x copyleft y", "copyleft", "a b copyleft c d copyleft"], phrases={"copyleft": "c", "a b": "ab"}, templates={"t": ["one"]})
    assert [[(p["label"], p["first"]) for p in got[i]["places"]] for i in range(3)] == [[("c", 1)], [("c", 0)], [("ab", 0), ("c", 2), ("c", 5)]]
    alone = _scan(spark, ["x one y"], phrases={}, templates={"t": ["one"]})
    assert [(s["label"], s["first"], s["end"], s["share"]) for s in alone[0]["spans"]] == [("t", 1, 2, 1.0)]


def test_notices_are_told_apart(spark):
    """Each notice by itself has its own label and no other; a chain goes on past words that a template repeats."""
    texts = [(label, t) for label, notices in licenses.TEMPLATES.items() for t in notices]
    docs = spark.createDataFrame([(i, f"head {t} tail") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.summary(licenses.scan(docs)).collect():
        label, text = texts[r["id"]]
        assert set(r["labels"].split(",")) - set(r["base_labels"].split(",")) <= {label} and label in r["labels"].split(",") and r["score"] == 1.0, text
    repeated = _scan(spark, ["a b c d e f x a b c d e f y"], phrases={}, templates={"t": ["a b c d e f g a b c d e f h"]})
    assert [(s["first"], s["end"]) for s in repeated[0]["spans"]] == [(0, 13)] and repeated[0]["spans"][0]["share"] == 12 / 14


def _license_row(text):
    """What the query returns, from plain searches."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _lower(text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def _fingerprint(text):
    words = WORD.findall(_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, budget=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, odd, some):
    docs = some.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows = simhash.near_duplicates(docs).collect()
    ids, fps = [r["id"] for r in rows], [r["fp"] % (1 << 64) for r in rows]
    assert Counter((r["doc_id"], _fingerprint(r["text"])) for r in docs.collect()) == Counter(zip(ids, fps, strict=True))
    least = {}
    roots = _components(fps)
    for i, c in zip(ids, roots, strict=True):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    assert [r["component_id"] for r in rows] == [least[c] for c in roots]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def _wide(text):
    """The wide fingerprint as one number of 256 bits."""
    words = WORD.findall(_lower(text or ""))
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    first, full, out = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], (1 << 64) - 1, 0
    for k in range(4):
        lane = []
        for z in first:
            if k:
                z = (z + k * 0x9E3779B97F4A7C15) & full
                z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & full
                z = ((z ^ z >> 27) * 0x94D049BB133111EB) & full
                z ^= z >> 31
            lane.append(z)
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in lane) > len(lane))
    return out


def _near_copies(rng, words, changed):
    """A text of random words and copies of it, each with so many words changed one by one."""
    base = rng.integers(0, 10_000, words)
    out = [base]
    for n in changed:
        copy = base.copy()
        copy[rng.choice(words, n, replace=False)] = rng.integers(10_000, 20_000, n)
        out.append(copy)
    return [" ".join(f"w{x}" for x in t) for t in out]


def _wide_groups(spark, texts, **options):
    marked = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", simhash.wide_fingerprint_udf("text").alias("fp"))
    return {r["id"]: r["component_id"] for r in simhash.group_wide(marked, **options).collect()}


def test_wide_rule(spark, odd, some):
    """One bucket, or one in tiles: all pairs as by brute force. More buckets: nothing else, and nearly all of them."""
    rng = np.random.default_rng(31)
    texts = [r["text"] for r in some.limit(120).collect()] + [r["text"] for r in odd.collect()]
    texts += [t for _ in range(12) for t in _near_copies(rng, 200, (1, 3, 6, 9, 12, 20))]
    fps = [_wide(t) for t in texts]
    roots = _components(fps, simhash.WIDE_BUDGET)
    want = dict(enumerate(roots))
    assert len(set(roots)) < len(texts) - 30
    assert _wide_groups(spark, texts, cell=1 << 20) == want
    assert _wide_groups(spark, texts, cell=1 << 20, hot_block=30) == want
    some_found = _wide_groups(spark, texts, cell=8)
    assert all(want[c] == want[i] for i, c in some_found.items())
    assert sum(some_found[i] == c for i, c in want.items()) >= 0.97 * len(texts)
    assert [simhash.wide_fingerprint(t) for t in texts] == [[f >> 64 * k & ((1 << 64) - 1) for k in (3, 2, 1, 0)] for f in fps]
    assert simhash.keep_one(odd.limit(0), wide=True).count() == 0


def test_connected_ranges_are_spared(spark):
    """4,000 near copies among other texts in one bucket: few pairs are looked at, and all hang together."""
    rng = np.random.default_rng(33)
    base = rng.integers(0, 1 << 63, simhash.LANES, dtype=np.uint64)
    copies = np.repeat(base[None, :], 4000, axis=0)
    for row in copies:
        for b in rng.integers(0, 256, 15):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    lanes = np.unique(np.concatenate((copies, rng.integers(0, 1 << 63, (200, simhash.LANES), dtype=np.uint64))), axis=0)
    forest, looked = simhash.Forest(len(lanes)), 0

    def known(a0, a1, b0, b1):
        nonlocal looked
        out = forest.connects(a0, a1, b0, b1)
        looked += int((~out & (a1 - a0 == 1) & (b1 - b0 == 1)).sum())
        return out

    for i, j in simhash.trie_pieces(lanes, np.zeros(len(lanes), np.int64), 0, simhash.WIDE_BUDGET, known):
        forest.add(i, j)
    near = np.bitwise_count(lanes ^ base).sum(axis=1) <= 15
    assert len(set(forest.root[near].tolist())) == 1 and len(set(forest.root.tolist())) == 201
    assert looked < len(lanes) ** 2 // 6


def test_near_copies_are_found_and_others_stay(spark):
    """Five-word similarities of 0.8 and more against at most a half, in 3,000 texts."""
    rng = np.random.default_rng(32)
    texts = [t for _ in range(1000) for t in _near_copies(rng, 240, (int(rng.integers(1, 6)),))]  # a changed word costs five shingles
    for _ in range(500):  # half of the words in common
        a, b = (rng.integers(0, 10_000, 240) for _ in range(2))
        b[:120] = a[:120]
        texts += [" ".join(f"w{x}" for x in t) for t in (a, b)]
    found = _wide_groups(spark, texts)
    assert np.mean([found[2 * i + 1] == 2 * i for i in range(1000)]) >= 0.95
    assert all(found[i] == i for i in range(2000, 3000))


def test_links_of_hot_blocks(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, n)) for s in seeds for n in rng.integers(0, 7, 40)} | {0, 1, (1 << 64) - 1, 7, 15}
    fps |= {int(x) >> 16 for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}  # one common block
    fps = sorted(fps)
    table = spark.createDataFrame([(_signed(x),) for x in fps], "fp long")
    roots = _components(fps)
    want = {frozenset(fps[i] for i in range(len(fps)) if roots[i] == c) for c in set(roots)}
    for hot in (4096, 20):
        found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(simhash.link_fingerprints(table, hot)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(found.get(x, x), set()).add(x)
        assert {frozenset(g) for g in groups.values()} == want


def test_dense_groups_come_as_stars():
    keys = np.sort(np.array([x for x in range(1 << 12) if x.bit_count() <= 3], np.uint64))
    i, j = simhash.trie_links(keys, np.zeros(len(keys), np.int64), 16)
    assert (np.bitwise_count(keys[i] ^ keys[j]) <= 3).all()
    forest = simhash.Forest(len(keys))
    forest.add(i, j)
    assert (forest.root == 0).all()


def test_keep_one(spark, odd, some):
    docs = odd.unionByName(some, allowMissingColumns=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    fps = [_fingerprint(r["text"]) for r in rows]
    assert len(set(_components(fps))) == len(rows)
    whole = [_fingerprint(r["text"]) for r in docs.collect()]
    assert len(rows) == len(set(_components(whole)))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(60)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(61)}
