"""Quality classifier: a byte-level convolutional network in numpy.

A window of WIDTH bytes starts at every second byte. Learned filters score each window; half-overlapping chunks of
two blocks of BLOCK bytes cover the whole text; each filter is max-pooled over a chunk, and the chunks' sums are
averaged into one probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clickloom.llm import text_ids
from clickloom.llm.shared import cut


WIDTH, BLOCK, FILTERS, EMBEDDING = 8, 256, 32, 8
#: Of each class at most so many labelled rows are learned from, each with its whole text, of so many bytes together at
#: most; rows of texts over LONGEST bytes are not drawn.
SAMPLE, SAMPLE_BYTES, LONGEST = 1000, 1 << 24, 1 << 20
THRESHOLD = 0.3
LEAST_STEPS = 300
#: Bytes of text that are scored at a time, few enough for a core's cache; chunks that are learned from at a time.
_SLAB, _SLAB_CHUNKS = 1 << 15, 512


@dataclass
class Model:
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (WIDTH, EMBEDDING, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    offset: float

    def tables(self, kind: type = np.float32) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): what each pair of bytes adds to each filter at each place of a window."""
        one = (self.embedding @ self.filters).astype(kind)
        return (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)


def _windows(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Filter values of the windows that start at each byte pair but the last WIDTH / 2 - 1."""
    n = len(codes) - (WIDTH // 2 - 1)
    z = tables[0].take(codes[:n], axis=0)
    for k in range(1, WIDTH // 2):
        z += tables[k].take(codes[k : k + n], axis=0)
    return z


def _logits(texts: Iterable[bytes], model: Model, tables: np.ndarray) -> np.ndarray:
    """One value for each text. Memory is bounded by _SLAB bytes of text and the longest text, however many there are."""
    tail = bytes(WIDTH)
    out: list[float] = []

    def finish(blocks: np.ndarray) -> float:
        if len(blocks) > 1:
            blocks = np.maximum(blocks[:-1], blocks[1:])
        return float(np.maximum(blocks + model.bias, 0).mean(axis=0, dtype=np.float64) @ model.out) if len(blocks) else 0.0

    def slab(group: list[tuple[int, bytes]]) -> None:
        parts, starts, owners, at = [], [], [], 0
        for _, text in group:
            size = len(text) + len(text) % 2
            begin = list(range(at // 2, (at + size) // 2, BLOCK // 2))
            starts += [*begin, (at + size) // 2]  # the last stands for the padding
            owners.append(len(begin))
            parts.append(text.ljust(size, b"\0") + tail)
            at += size + WIDTH
        z = _windows(np.frombuffer(b"".join(parts) + tail, ">u2").astype(np.intp), tables)
        top, k = np.maximum.reduceat(z, starts, axis=0), 0
        for (i, _), n in zip(group, owners, strict=True):
            out[i] += finish(top[k : k + n])
            k += n + 1

    group, held = [], 0
    for i, text in enumerate(texts):
        out.append(model.offset)
        if len(text) > _SLAB:
            tops = []
            for at in range(0, len(text), _SLAB):  # _SLAB is a multiple of BLOCK
                part = text[at : at + _SLAB + WIDTH]
                n = (min(_SLAB, len(text) - at) + 1) // 2
                z = _windows(np.frombuffer(part.ljust(2 * n + WIDTH, b"\0")[: 2 * n + WIDTH - 2], ">u2").astype(np.intp), tables)[:n]
                tops.append(np.maximum.reduceat(z, np.arange(0, n, BLOCK // 2), axis=0))
            out[i] += finish(np.concatenate(tops))
        elif text:
            group.append((i, text))
            held += len(text)
        if held > _SLAB:
            slab(group)
            group, held = [], 0
    if group:
        slab(group)
    return np.array(out, np.float64)


def _tops(raw: np.ndarray, lengths: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and filter the best window's place, in byte pairs, and its value; a slab of chunks at a time."""
    best, top = np.zeros((len(raw), FILTERS), np.int64), np.zeros((len(raw), FILTERS))
    for at in range(0, len(raw), _SLAB_CHUNKS):
        part = slice(at, at + _SLAB_CHUNKS)
        codes = np.ascontiguousarray(raw[part]).view(">u2").astype(np.intp)
        z = tables[0].take(codes[:, :BLOCK], axis=0)
        for k in range(1, WIDTH // 2):
            z += tables[k].take(codes[:, k : k + BLOCK], axis=0)
        z[np.arange(BLOCK)[None, :] >= ((lengths[part] + 1) // 2)[:, None]] = -np.inf
        best[part] = z.argmax(axis=1)
        top[part] = np.take_along_axis(z, best[part][:, None, :], axis=1)[:, 0]
    return best, top


def loss_and_gradient(p: dict[str, np.ndarray], raw: np.ndarray, lengths: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, kind: type = np.float32) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean cross entropy of some documents, and its gradient by parameter.

    raw: (n, 2 * BLOCK + WIDTH) bytes of chunks, zero-padded; lengths: bytes of each; owner: its document's place in
    label and weight; every document has a chunk, one of length 0 where its text is empty.
    """
    best, top = _tops(raw, lengths, Model(p["embedding"], p["filters"], p["bias"], p["out"], float(p["offset"])).tables(kind))
    top = np.where(np.isfinite(top), top + p["bias"], 0)
    h, share = np.maximum(top, 0), 1 / np.bincount(owner, minlength=len(label))[owner]
    logit = np.bincount(owner, (h @ p["out"]) * share, minlength=len(label)) + p["offset"]
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())
    wrong = weight * (1 / (1 + np.exp(-logit)) - label) / weight.sum()
    dchunk = wrong[owner] * share
    dh = dchunk[:, None] * p["out"] * (top > 0)
    dt = np.zeros(WIDTH * 256 * FILTERS)
    for at in range(0, len(raw), _SLAB_CHUNKS):
        part = slice(at, at + _SLAB_CHUNKS)
        places = 2 * best[part][:, None, :] + np.arange(WIDTH)[None, :, None]
        seen = raw[part][np.arange(len(places))[:, None, None], places].astype(np.int64)  # (chunk, place, filter)
        flat = (np.arange(WIDTH)[None, :, None] * 256 + seen) * FILTERS + np.arange(FILTERS)
        dt += np.bincount(flat.ravel(), np.broadcast_to(dh[part][:, None, :], flat.shape).ravel(), minlength=len(dt))
    dt = dt.reshape(WIDTH, 256, FILTERS)
    return loss, {
        "embedding": np.einsum("kbf,kef->be", dt, p["filters"]),
        "filters": np.einsum("be,kbf->kef", p["embedding"], dt),
        "bias": dh.sum(axis=0),
        "out": h.T @ dchunk,
        "offset": np.array(wrong.sum()),
    }


def start(prior: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters before training; prior: the weighted share of label 1."""
    return {
        "embedding": rng.normal(0, 0.3, (256, EMBEDDING)),
        "filters": rng.normal(0, 0.25, (WIDTH, EMBEDDING, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.1, FILTERS),
        "offset": np.array(np.log(prior / (1 - prior))),
    }


def train(chunks: np.ndarray, lengths: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 10, seed: int = 7) -> Model:
    """Fit by Adam; the arguments are those of loss_and_gradient for all documents. Few documents are seen more often
    than epochs times, so that there are LEAST_STEPS steps."""
    batches = max(1, len(label) // 48)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    rng = np.random.default_rng(seed)
    p = start(float((label * weight).sum() / weight.sum()), rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    by_doc = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(label)))[:-1])
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for batch in np.array_split(rng.permutation(len(label)), batches):
            rows = np.concatenate([by_doc[d] for d in batch])
            mine = np.repeat(np.arange(len(batch)), [len(by_doc[d]) for d in batch])
            _, grad = loss_and_gradient(p, chunks[rows], lengths[rows], mine, label[batch], weight[batch])
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k] * (k != "offset")
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(p["embedding"], p["filters"], p["bias"].astype(np.float32), p["out"], float(p["offset"]))


def constant(share: float) -> Model:
    """Scores every text share: for labels of one class, or none."""
    share = min(max(share, 0.01), 0.99)
    return Model(np.zeros((256, EMBEDDING)), np.zeros((WIDTH, EMBEDDING, FILTERS)), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), float(np.log(share / (1 - share))))


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def chunks_of(raw: bytes) -> tuple[list[bytes], list[int]]:
    """All chunks of a text, zero-padded, and their lengths; an empty text has one of length 0."""
    size = 2 * BLOCK + WIDTH
    found = [raw[at * BLOCK :][:size] for at in range(max(1, (len(raw) - 1) // BLOCK))]
    return [x.ljust(size, b"\0") for x in found], [min(len(x), 2 * BLOCK) for x in found]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most SAMPLE labelled rows of each class, none of them held out, with their whole texts.

    The sample is the rows with the least hash of their id among those that docs has, as long as their texts have
    SAMPLE_BYTES bytes together; texts over LONGEST bytes are not drawn. Of rows with one id the text of the least hash
    counts, so that at most 2 * SAMPLE rows and 2 * SAMPLE_BYTES bytes reach the driver. Both classes weigh the same,
    however few rows one has, so that scores are probabilities at equal shares. Only the text is an input. Rows with a null id or label are not learned from; labels of one class alone give a constant score.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    sizes = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"), F.xxhash64(text_col).alias("h"))
    present = cut(known.join(sizes.groupBy("id").agg(F.min_by("size", F.struct("h", "size")).alias("size")), "id"))  # counted, then drawn from
    totals = {r["label"]: r["n"] for r in present.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(totals.values())
    if len(totals) < 2:
        return constant((totals.get(1, 0) + 1) / (total + 2))
    drawn = present.where(F.col("size") <= LONGEST)
    part = [drawn.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]  # the documented bound
    upto = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    sample = F.broadcast(part[0].unionByName(part[1]).withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("id", "label"))  # at most 2 * SAMPLE rows
    chosen = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text")).join(sample, "id")
    rows = chosen.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), "text"))["text"].alias("text")).collect()
    if len({r["label"] for r in rows}) < 2:
        return constant((totals.get(1, 0) + 1) / (total + 2))
    rows.sort(key=lambda r: r["id"])
    parts = [chunks_of((r["text"] or "").encode()) for r in rows]
    label = np.array([r["label"] for r in rows], np.float64)
    weight = np.where(label == 1, 1 / (label == 1).sum(), 1 / (label == 0).sum())
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in parts])
    chunks = np.frombuffer(b"".join(c for x, _ in parts for c in x), np.uint8).reshape(len(owner), -1)
    return train(chunks, np.array([n for _, x in parts for n in x]), owner, label, weight)


def scorer(model: Model):
    """A pandas UDF from a text to its probability of label 1; a null text counts as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text_ids.forget()
        tables = model.tables()
        for texts in batches:
            logit = _logits(((t or "").encode() for t in texts), model, tables)
            yield pd.Series(1 / (1 + np.exp(-logit)), index=texts.index)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, DoubleType())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs; null ids and repeated rows stay, an empty table gives an empty one; invalid UTF-8
    counts as U+FFFD."""
    return docs.select(F.col(id_col).alias("id"), scorer(model)(F.make_valid_utf8(F.col(text_col))).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(scorer(model)(F.make_valid_utf8(docs[text_col])) >= threshold)
