"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from clickloom.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def _brute(ids, vectors, labels):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = (units @ units.T >= embed_dedup.COSINE) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        best = np.minimum(comp, np.where(near, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == comp).all():
            return near.sum(axis=1), comp
        comp = best


@pytest.mark.parametrize("cell", [4096, 40, 3])
def test_all_pairs(spark, cell):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    vectors = np.concatenate((rng.normal(size=(200, 32)), *[c + rng.normal(size=(n, 32)) * s for c, n, s in zip(centres, rng.integers(1, 12, 60), rng.uniform(0.01, 0.3, 60), strict=True)]))
    vectors = np.concatenate((vectors, vectors[:20], vectors[:20] * 3))
    ids, labels = rng.permutation(len(vectors)), rng.integers(0, 2, len(vectors))
    labels[-40:] = 0
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, vectors, labels, strict=True)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell=cell).toPandas().set_index("id").loc[ids]
    links, comp = _brute(ids, vectors, labels)
    assert got["n_links"].sum() >= 0.995 * links.sum() and (got["n_links"].to_numpy() <= links).all()
    assert (got["component_id"].to_numpy() == comp).mean() > 0.99
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = embed_dedup.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=a.shape)
    side = embed_dedup.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
    found = sum((i == j).sum() for i, j in embed_dedup.near_pairs(a, b))
    assert found >= 0.99 * len(a)


def _planted(rng, n, dim=64):
    """Pairs at just over the threshold, in rows i and i + n."""
    a = embed_dedup.unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=a.shape)
    side = embed_dedup.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    return np.concatenate((a, 0.9301 * a + np.sqrt(1 - 0.9301**2) * side))


@pytest.mark.parametrize("n", [5_000, 20_000, 1_000_000])
def test_recall_of_grids_at_the_threshold(n):
    vectors, half = _planted(np.random.default_rng(3), 2000), 2000
    where = embed_dedup.cells(vectors, *embed_dedup.grids(n))
    assert (where[:half] == where[half:]).any(axis=1).mean() >= 0.995


def test_work_grows_far_slower_than_the_square():
    """One label at four times the rows: pairs inside cells over all grids, and copies of each vector."""
    work, copies = [], []
    for n in (4_000, 16_000, 64_000):
        shape = embed_dedup.grids(n, cell=128)
        where = embed_dedup.cells(embed_dedup.unit(np.random.default_rng(n).normal(size=(n, 64))), *shape)
        work.append(sum(float((np.unique(g, return_counts=True)[1].astype(float) ** 2).sum()) for g in where.T))
        copies.append(n * shape[0])
    assert all(b <= 8 * a for x in (work, copies) for a, b in zip(x, x[1:], strict=False))


def test_pairs_of_a_large_label_count_once(spark):
    """Pairs that several grids hold together; all links of a label that has more vectors than a cell."""
    vectors = _planted(np.random.default_rng(4), 400)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell=16).toPandas().set_index("id").sort_index()
    links, comp = _brute(np.arange(800), vectors, np.ones(800))
    assert (got["n_links"].to_numpy() <= links).all() and got["n_links"].sum() >= 0.97 * links.sum() and (got["component_id"].to_numpy() == comp).mean() >= 0.97


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7), (3, [1.0, 0.01], 1.2), (4, [1.0, 0.0], float("nan")), (5, [1.0, 0.02], float("nan"))]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (1, 4), 5: (1, 4)}
    text = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), ((1 << 60) + 1, [1.0, 0.0], "a"), (None, [0.0, -0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert {r["id"]: r["n_links"] for r in embed_dedup.near_duplicates(text).collect()} == {1: 1, 2: 0, (1 << 60) + 1: 1, None: 0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (9, [1e300, 1e299], 1), (None, [1.0, 0.0], 2), (10, [], 1), (11, [inf, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS id", "'x' AS vec", "3 AS strip")
    got = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11, None)]
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), *alone], key=repr)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_counts():
    assert embed_dedup.least_count(4, 1.0, 0.99) == 4 and embed_dedup.least_count(10, 0.5, 0.5) == 5
