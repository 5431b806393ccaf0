"""Which labelled rows the classifier learns from."""

from __future__ import annotations

import numpy as np

from clickloom.llm import quality_cnn


def _learned(spark, monkeypatch, docs, labels):
    seen = {}
    monkeypatch.setattr(quality_cnn, "train", lambda chunks, lengths, owner, label, weight: seen.update(owner=owner, label=label) or quality_cnn.constant(0.5))
    quality_cnn.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    return seen


def test_sample_is_drawn_from_ids_with_a_text(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "SAMPLE", 5)
    seen = _learned(spark, monkeypatch, [(i, f"text {i}") for i in range(40)], [(i, i % 2) for i in range(4000)])
    assert sorted(seen["label"]) == [0] * 5 + [1] * 5


def test_hot_id_is_one_row(spark, monkeypatch):
    docs = [(0, f"text {i}") for i in range(500)] + [(i, f"text {i}") for i in range(1, 10)]
    seen = _learned(spark, monkeypatch, docs, [(i, i % 2) for i in range(10)])
    assert len(seen["owner"]) == len(seen["label"]) > 1


def test_long_texts_are_learned_from_whole(spark, monkeypatch):
    labels = [(i, i % 2) for i in range(20)]
    seen = _learned(spark, monkeypatch, [(i, "word " * 1000) for i in range(20)], labels)
    assert (np.bincount(seen["owner"]) == 19).all()  # 5,000 bytes in chunks that begin at every 256th
    monkeypatch.setattr(quality_cnn, "SAMPLE_BYTES", 12_000)
    seen = _learned(spark, monkeypatch, [(i, "word " * 1000) for i in range(20)], labels)
    assert sorted(seen["label"]) == [0, 0, 1, 1]
    monkeypatch.setattr(quality_cnn, "LONGEST", 10)
    seen = _learned(spark, monkeypatch, [(i, "word " * (1000 if i < 14 else 1)) for i in range(20)], labels)
    assert 1 < len(seen["label"]) <= 6


def test_one_id_of_many_rows_sends_one_text(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "SAMPLE", 3)
    docs = [(1, f"text {i}") for i in range(20_000)] + [(i, "x") for i in range(2, 40)]
    seen = _learned(spark, monkeypatch, docs, [(i, i % 2) for i in range(1, 40)])
    assert len(seen["owner"]) == len(seen["label"]) <= 6
