"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and the form that each
one most likely stands for.

Near words are found by an even-partition pigeonhole join. A word of length l is indexed by its two halves; one edit leaves
one of them alone. Words of equal length look for their own halves, words that are one longer for their first part and for
their last part, which the edit has shifted by one. All that meet at one key stand in the same place of a match: so many
code points alike in front, so many behind, and a window between them that holds the edit. Keys at which too many words
meet are cut again by the halves of that window, until few do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import cut, sliced

LEAST_CHARS, LEAST_COUNT, RATIO, TYPO = 7, 2, 10, 31
#: Words at one key beyond which it is cut by halves of its window.
HOT_KEY = 512
#: Words that a task counts before it hands them on, and their code points at most.
_COUNTED, _COUNTED_CHARS = 200_000, 1 << 24
#: Pairs that are compared at a time, times their width; words of more code points are compared one by one.
_COMPARED, _LONG = 1 << 23, 64
_run = re.compile("[A-Za-zÀ-ÿ]+").findall


def _typed(run: str, doc: int, typo: int) -> str:
    """A run as it counts: where its hash with the document's id is a multiple of typo, one code point is missing."""
    h = crc32(run.encode(), doc)
    return run if h % typo else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counts(least_chars: int, typo: int):
    """mapInArrow over (name, text): (word, n), a word again in each portion of a task."""

    def handed(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chars = Counter(), 0
        for batch in sliced(batches):
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = crc32(f"{name}:".encode())
                lowered = text.encode().lower().decode()  # of bytes only A-Z change
                for own, n in Counter(_run(lowered)).items():
                    if len(own) >= least_chars and len(word := _typed(own, doc, typo)) >= least_chars:
                        chars += len(word) if word not in found else 0
                        found[word] += n
                if len(found) > _COUNTED or chars > _COUNTED_CHARS:
                    yield handed(found)
                    found, chars = Counter(), 0
        yield handed(found)

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of the words of all texts with at least least_chars code points and least_count occurrences.

    Null texts have none; a null id counts as an empty one; invalid UTF-8 counts as U+FFFD, which ends a word; repeated
    rows count as often as they come. Other columns are not read.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return own.mapInArrow(_counts(least_chars, typo), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _placed(vocabulary: DataFrame) -> DataFrame:
    """Each word as one of an indexed length l, its own, and as one that is longer by one; the window is all of it."""
    size = F.char_length("word")
    return vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).withColumns({"lo": F.lit(0), "hi": F.col("l")})


def _halved(rows: DataFrame) -> DataFrame:
    """Rows at the two halves of their windows: the edit lies behind the first half, or before the second."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    cut_ = rows.select("word", "n", "l", F.explode(halves).alias("at")).select("word", "n", "l", "at.lo", "at.hi")
    return cut_.withColumn("key", F.xxhash64("l", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, l - hi)")))


def _one_edit(a: str, b: str) -> int:
    """Where a and b, as long or longer by one, part, if one edit makes them equal; else -1."""
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    other = np.flatnonzero(x != y[: len(x)])
    p = int(other[0]) if len(other) else len(x)
    return p if len(a) + len(b) > 2 * p and np.array_equal(x[p + 1 :] if len(a) == len(b) else x[p:], y[p + 1 :]) else -1


def _parted(a: np.ndarray, b: np.ndarray, size: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """_one_edit of many pairs: rows of bytes with zeros behind them, the sizes of the a, and which b are longer."""
    other = a != b
    p = np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])
    at = np.arange(a.shape[1])
    shifted = np.concatenate([b[:, 1:], np.zeros((len(b), 1), b.dtype)], axis=1)
    replaced = ~(other & (at[None, :] > p[:, None])).any(axis=1) & (p < size)
    inserted = ~((a != shifted) & (at[None, :] >= p[:, None]) & (at[None, :] < size[:, None])).any(axis=1)
    return np.where(np.where(longer, inserted, replaced), p, -1)


def _pairs(begin: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other) for the count[row] rows from begin[row] on, about most at a time."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        row = np.repeat(np.arange(at, to), count[at:to])
        yield row, np.arange(len(row)) - np.repeat(ends[at:to] - count[at:to] - done, count[at:to]) + np.repeat(begin[at:to], count[at:to])
        at = to


def _links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, other, n of the other) of the near pairs of whole keys, both ways. rows: by key, shorter words first."""
    key, l, lo, hi = (rows.column(c).to_numpy() for c in ("key", "l", "lo", "hi"))
    word, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    size = np.array([len(w) for w in word], np.int64)
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)[group]
    indexed = np.bincount(group[size == l], minlength=group[-1] + 1)[group]  # words of length l come first at a key
    count = np.where(size == l, np.arange(len(key)) - first, indexed)
    short = np.flatnonzero(size <= _LONG)
    width = int(size[short].max()) if len(short) else 0
    matrix = np.zeros((len(key), width), np.uint8)
    if len(short):
        flat = np.frombuffer("".join([word[i] for i in short]).encode("latin-1"), np.uint8)
        matrix[np.repeat(short, size[short]), np.arange(len(flat)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])] = flat
    for b, a in _pairs(first, count, max(1, _COMPARED // max(1, width))):
        p = np.full(len(a), -1)
        fits = (size[a] <= _LONG) & (size[b] <= _LONG)
        if fits.any():
            p[fits] = _parted(matrix[a[fits]], matrix[b[fits]], size[a[fits]], size[b[fits]] > size[a[fits]])
        for i in np.flatnonzero(~fits).tolist():
            p[i] = _one_edit(word[a[i]], word[b[i]])
        # each pair at one key only: that whose window holds the place where the two part
        near = (p >= lo[b]) & ((p < hi[b]) | (hi[b] == l[b]))
        a, b = a[near], b[near]
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        yield pa.RecordBatch.from_arrays([pa.array([word[i] for i in x.tolist()], pa.string()), pa.array([word[i] for i in y.tolist()], pa.string()), pa.array(n[y])], names=["word", "other", "other_n"])


_PIECE = 65_536


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by key, l, lo, hi and the words' size; a key that may go on waits."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        if sum(x.num_rows for x in wait) < _PIECE:
            continue
        rows = pa.Table.from_batches(wait).combine_chunks()
        keys = rows.column("key").to_numpy()
        end = int(np.flatnonzero(keys == keys[-1])[0])
        if end:
            yield from _links(rows.slice(0, end).combine_chunks())
        wait = rows.slice(end).to_batches()
    if wait:
        yield from _links(pa.Table.from_batches(wait).combine_chunks())


def near_words(vocabulary: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(word, other, other_n) of all words of vocabulary (word, n; each word once) that differ by exactly one edit.

    Both directions, each pair once. Words are of U+00FF and below, and of LEAST_CHARS code points or any other number.
    A key of more than hot_key words whose window has more than one code point is cut by halves of the window; at a
    window of one, all words of one length are near each other, so that no pair is compared in vain.
    """
    rows, found = _halved(_placed(vocabulary)), None
    while True:
        counts = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > hot_key)
        hot = cut(counts.select("key"))
        last = hot.isEmpty()
        cold = rows if last else rows.join(hot, "key", "left_anti")
        # by more than the join's own column: Spark leaves out a repartition that a join before it has made already, and then
        # may part one key's rows, by a skewed join's splits or where a broadcast lets tasks read shuffled rows as they lie
        dealt = cold.select("key", "l", "lo", "hi", "word", "n", F.char_length("word").alias("size")).repartition("key", "l", "lo", "hi").sortWithinPartitions("key", "l", "lo", "hi", "size")
        links = dealt.drop("size").mapInArrow(_join, "word string, other string, other_n long")
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        rows = _halved(rows.join(hot, "key", "left_semi"))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, hot_key: int = HOT_KEY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of vocabulary (word, n).

    form: the near word that comes most often, of equal ones the least, if it comes at least ratio times as often as the
    word; root: where the forms of forms end. Forms come ratio times as often at each step, so that their chains are
    short, and a few rounds of doubling reach their ends.
    """
    vocabulary = cut(vocabulary)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_words(vocabulary, hot_key).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left")
    able = -F.col("best.n") >= ratio * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(able, F.col("best.word")).alias("form"), F.when(able, -F.col("best.n")).alias("form_n")))
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, max(2, ratio))) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        ends = cut(ends.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
