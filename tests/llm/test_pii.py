"""Personal data that stands in lists or before other codes."""

from __future__ import annotations

import random

import regex
from pyspark.sql import functions as F

from clickloom.llm import pii


def _found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["id"]: r["spans"] for r in pii.find(docs, **options).collect()}
    return [[texts[i][s["start"] : s["end"]] for s in rows[i]] for i in range(len(texts))]


def test_spaced_iban_before_other_codes(spark):
    be, es, de = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    texts = [f"é {be} EUR 500", f"{es} BBVA", f"{be} EURO50", f"{de} USD", f"{be} {de} {es}", f"{be[:-1]}5 EUR", f"x{be}", f"{be} {be.replace(' ', '')} 12"]
    assert _found(spark, texts) == [[be], [es], [be], [de], [be, de, es], [], [], [be, be.replace(" ", "")]]
    docs = spark.createDataFrame([(f"to {be} EUR 500",)], "text string")
    assert pii.redact(docs).first()["text"] == "to <IBAN> EUR 500"


def test_lists_behind_one_context_word(spark):
    ssn, key = [f"{100 + i}-45-{6000 + i}" for i in range(300)], [f"{i:03d}" + "a1" * 20 for i in range(300)]
    texts = [
        f"é SSN: {ssn[0]}, {ssn[1]}", "ssn\n" + "\n".join(ssn), f"tokens: {key[0]}, {key[1]} and {key[2]}", "token " + " | ".join(key), f"{ssn[0]} is my social security number",
        f"{key[0]} was the password", f"{ssn[0]}, {ssn[1]}", f"ssn {ssn[0]} {'x' * 50} {ssn[1]}", f"token {key[0]} commit {key[1]}", f"x {ssn[0]} y {ssn[1]} z {ssn[2]}", "ssn", f"ssn {ssn[0]} but {ssn[1]}",
    ]
    want = [ssn[:2], ssn, key[:3], key, ssn[:1], key[:1], [], ssn[:1], key[:1], [], [], ssn[:2]]
    assert _found(spark, texts, around=True) == want


def test_query_and_stage_take_the_whole_context(spark, tmp_path):
    from corpus_pipeline import pii_stage

    from clickloom.llm.queries import op4_pii

    docs = spark.createDataFrame([(1, "SSN: 123-45-6789, 987-65-4321")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert op4_pii(spark, str(tmp_path)).first()["spans"] == "ssn:5:16,ssn:18:29"
    assert pii_stage(spark, docs, str(tmp_path)).first()["text"] == "SSN: <SSN>, <SSN>"


def _plain_spans(text):
    """Social security numbers and secrets by definition: matches in order, the text around each, and their lists."""
    out = []
    for kind in (k for k in pii.KINDS if k.name in ("ssn", "secret")):
        pattern = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])" if kind.name == "ssn" else r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}"
        found = list(regex.finditer(pattern, text))
        held = False  # by a context word at this match, or at one before it in the same list
        for n, m in enumerate(found):
            gap = text[found[n - 1].end() : m.start()] if n else "first"
            same = bool(n) and regex.fullmatch(r"[^\p{L}\p{N}]*(?:(?:and|or|und|oder|et|ou|y|o|e)[^\p{L}\p{N}]+)?", gap, regex.IGNORECASE)
            around = [text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 40]]
            held = bool(same and held) or any(regex.search(kind.context, x.lower()) for x in around)
            digits = sum(c.isdigit() for c in m.group())
            if held and (kind.name == "ssn" or 4 <= digits < len(m.group())):
                out.append(f"{kind.name}:{m.start()}:{m.end()}")
    return out


def test_numbers_and_secrets_against_a_plain_version(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ssn = lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    secret = lambda: "".join(rng.choice("abcXYZ0189") for _ in range(rng.choice([31, 32, 40, 64])))
    lone = lambda: rng.choice(["a" * 40, "1" * 40, "abc1" + "x" * 36])
    words = ["SSN", "social security", "is", "my token:", "password", "API key", "and", "or", "és", "lorem ipsum dolor sit amet", "x" * 35, "y", "et", "-", "the number of a very long invoice that goes on"]
    gaps = [" ", ", ", "; ", " and ", " or\n", ": ", "-", "", " / "]
    texts = []
    for _ in range(600):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            parts += [rng.choice([ssn, ssn, secret, lone, lambda: rng.choice(words), lambda: rng.choice(words)])(), rng.choice(gaps)]
        texts.append("".join(parts))
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), around=True)
    rows = {r["id"]: [x for x in r["d"].split(",") if x.startswith(("ssn", "secret"))] for r in found.select("id", pii.digest(F.col("spans")).alias("d")).collect()}
    want = {i: _plain_spans(t) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 200
    for i, t in enumerate(texts):
        assert rows[i] == want[i], t
