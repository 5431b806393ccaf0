"""Quality rules: base counts of a text, and a length-normalised n-gram likelihood ratio with a fixed threshold.

The ratio compares two multinomials over hashed word unigrams and bigrams: a trusted target and the raw corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import cut, let, words

#: Trusted ids of at most so many bytes, as measured, go to all executors; with more of them texts are shuffled.
BROADCAST_BYTES = 16 << 20
#: What an id takes in a hash table besides its own bytes, at most.
_ID_BYTES = 64
BUCKETS = 16_384
SMOOTHING = 4.0
#: A document is kept where its mean log ratio over its n-grams is at least this.
THRESHOLD = -0.12
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
_BREAKS = " \t\n\x0b\x0c\r"


def _n_repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, from the hash of every word."""
    n = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    windows = F.transform(F.slice(hashes, F.lit(1), n), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))

    def covered(found: Column) -> Column:
        """Sorted by hash, equal windows are neighbours; then each place adds what the place before left uncovered."""
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))
        again = let(
            ranked,
            lambda r: F.sort_array(
                F.transform(
                    F.filter(r, lambda x, i: F.coalesce(F.get(r, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(r, i + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["at"],
                )
            ),
        )
        start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(again, start, lambda s, p: F.struct(p.alias("last"), (s["total"] + F.least(F.lit(WINDOW).cast("long"), p - s["last"])).alias("total")), lambda s: s["total"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def _grams(hashes: Column) -> Column:
    """Buckets of the unigrams and bigrams, repeats included, from the hash of every word."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))),
        F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(one, two)


def _word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(target, text) of every row of docs; target is 1 where trusted names the row's id, else null.

    The trusted ids are kept and measured. Up to BROADCAST_BYTES they are broadcast, and no text is moved. Beyond that
    texts meet them in one shuffle, by a hash join on the narrow side, which does not sort texts. Both give the same rows.
    """
    known = cut(trusted.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("target", F.lit(1)))
    size = known.agg(F.sum(F.octet_length(F.col("id").cast("string")) + _ID_BYTES)).first()[0] or 0
    near = F.broadcast(known) if size <= BROADCAST_BYTES else known.hint("shuffle_hash")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(near, "id", "left").select("target", "text")


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(p_target / p_raw) of each of BUCKETS buckets.

    trusted: a table whose id column names the trusted documents; nulls and repeats in it make no difference. Counts
    cover every document: rows of docs are raw, those that trusted names are also target. Both counts are smoothed
    by SMOOTHING a bucket, so that buckets of neither weigh 0 once both are empty. The result has a fixed size.
    """
    grams = _marked(docs, trusted, id_col, text_col).select("target", F.explode(let(_word_hashes(words(F.col("text"))), _grams)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target")).collect()  # at most BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * BUCKETS
    all_raw, all_target = (math.log(sum(x) + SMOOTHING * BUCKETS) for x in (raw, target))
    return [math.log(t + SMOOTHING) - all_target - math.log(r + SMOOTHING) + all_raw for r, t in zip(raw, target, strict=True)]


def rules(text: Column, weights: list[float]) -> Column:
    """A struct of the base counts, the ratio and the verdict for a text column.

    Null and empty texts have no words: counts are 0, llr is 0, base_failed is true and kept false.
    """
    whole = F.coalesce(text, F.lit(""))
    # a folded literal, so that rows carry no copy of it
    by_bucket = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, _BREAKS, "") != "")

    def of_words(found: Column) -> Column:
        return let(
            _word_hashes(found),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                _n_repeat_words(h).alias("n_repeat_words"),
                let(_grams(h), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(by_bucket, b)) / F.size(g))).alias("llr"),
            ),
        )

    def verdict(w: Column) -> Column:
        failed = (w["n_words"] < MIN_WORDS) | (F.lit(100) * w["n_repeat_words"] > F.lit(MAX_REPEAT_PERCENT) * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"),
            F.char_length(F.translate(whole, _BREAKS, "")).cast("long").alias("word_chars"),
            (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (w["llr"] >= THRESHOLD)).alias("kept"),
            w["llr"].alias("llr"),
        )

    return let(of_words(words(text)), verdict)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the counts, base_failed, kept and llr. Null ids and repeated rows stay."""
    weights = ratio_weights(docs, trusted, id_col, text_col)
    return docs.select(F.col(id_col).alias("id"), rules(F.col(text_col), weights).alias("r")).select("id", "r.*")


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    weights = ratio_weights(docs, trusted, id_col, text_col)
    return docs.where(rules(docs[text_col], weights)["kept"])
