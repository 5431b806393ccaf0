"""Document fingerprints by winnowing: of each window of neighbouring k-gram hashes the least one is kept, with its place.

A gram is GRAM code points. Grams are hashed place by place and packed with their places into one number each, so that
the least number of a window is the least hash, and of equal hashes the rightmost. Any passage of GRAM + WINDOW - 1 code
points that two texts share gives both a fingerprint from the same place of the passage. Short texts take smaller windows,
which keep what a larger one would keep and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.shared import fresh_names, let
from clickloom.operators.ranges import ranges

GRAM, WINDOW = 8, 16
#: Grams of a text below which a window has 4 or 1 of them.
_SMALL, _TINY = 64, 16
#: Bits of a place in a packed number; the hash has 32 above them.
_PLACE = 31
#: From so many code points on, an edited text's fingerprint reuses what its unchanged part has.
_REUSE = 200
#: Windows that are computed at a time.
_STRETCH = 1 << 15


def _grams(raw: Column, first: Column, end: Column, base: Column) -> Column:
    """Packed hashes of the grams from number first to end, exclusive, of a text in UTF-32, whose own place is base."""
    high = F.lit(((1 << 32) - 1) << _PLACE)
    number = lambda i: F.shiftrightunsigned(F.xxhash64(F.substring(raw, i * 4 + 1, F.lit(4 * GRAM))), 1).bitwiseAND(high)
    return let(F.lit((1 << _PLACE) - 1) - base, lambda top: F.transform(F.sequence(first, end - 1), lambda i: number(i).bitwiseOR(top - i)))


def _least(numbers: Column, step: int) -> Column:
    """At each place the least of four numbers, step apart."""
    return F.transform(numbers, lambda v, i: F.least(v, F.get(numbers, i + step), F.get(numbers, i + 2 * step), F.get(numbers, i + 3 * step)))


def _minima(grams: Column, total: Column) -> Column:
    """The least number of each whole window; total: how many grams the whole text has, which decides the window."""

    def full(minima: Column, width: int) -> Column:
        return F.slice(minima, F.lit(1), F.greatest(F.size(grams) - (width - 1), F.lit(0)))

    windows = let(_least(grams, 1), lambda four: F.when(total < _SMALL, full(four, 4)).otherwise(full(_least(four, 4), WINDOW)))
    return F.when(total < _TINY, grams).otherwise(windows)


def _winnowed(text: Column, begin: Column) -> Column:
    """The distinct minima of a text's windows from the begin-th on, by place. A text shorter than a gram is one gram.

    Windows are computed _STRETCH at a time, so that a long text needs memory for its characters and fingerprints, and
    not for a number at every place.
    """
    grams = lambda n: F.greatest(n - (GRAM - 1), F.lit(1)).cast("int")
    total = grams(F.char_length(text))

    def stretches(raw: Column) -> Column:
        size = grams((F.octet_length(raw) / 4).cast("int"))
        of = lambda s: let(_grams(raw, s, F.least(s + (_STRETCH + WINDOW - 1), size), begin), lambda x: F.array_distinct(_minima(x, total)))
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), size - 1, F.lit(_STRETCH)), of)))

    return let(F.encode(F.substring(text, begin + 1, F.char_length(text)), "UTF-32"), stretches)


def _place(packed: Column) -> Column:
    return (F.lit((1 << _PLACE) - 1) - packed.bitwiseAND(F.lit((1 << _PLACE) - 1))).cast("int")


def winnow(text: Column) -> Column:
    """The fingerprints of a text, packed: hash and place in one number, in the order of places."""
    return _winnowed(text, F.lit(0))


def winnow_edited(known: Column, n_chars: Column, kept: Column, text: Column) -> Column:
    """winnow(text) of a text that begins with the first kept code points of one of n_chars whose fingerprints are known.

    Those at places whose windows all lie in the unchanged part are taken over; windows that reach beyond are computed.
    """
    reach = GRAM + WINDOW - 2
    same = F.when((n_chars >= _REUSE) & (4 * kept >= 3 * n_chars), kept - reach).otherwise(F.lit(0)).cast("int")
    tail = lambda end: _winnowed(text, F.greatest(end - (WINDOW - 1), F.lit(0)))
    return let(same, lambda end: F.array_distinct(F.concat(F.filter(known, lambda x: _place(x) < end), tail(end))))


def places(packed: Column) -> Column:
    """Packed fingerprints as struct(hash, place)."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, _PLACE).alias("hash"), _place(x).alias("place")))


def likeness(a: Column, b: Column) -> Column:
    """Of the distinct hashes of two packed fingerprints, the share that both have: 1 for equal texts."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, _PLACE)))
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda x: let(F.size(F.array_intersect(x["a"], x["b"])), lambda n: n / (F.size(x["a"]) + F.size(x["b"]) - n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, prints) for every row of docs: prints is an array of struct(hash, place).

    A null text is an empty one; an empty text has the one fingerprint of an empty gram, so that all empty texts are
    alike. Invalid UTF-8 counts as U+FFFD. Null ids and repeated rows stay rows of their own.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return texts.select("id", F.char_length("text").cast("long").alias("n_chars"), places(winnow(F.col("text"))).alias("prints"))


def digest(packed: Column) -> Column:
    """A short string of packed fingerprints: equal for equal hashes at equal places."""
    return F.sha2(F.array_join(packed.cast("array<string>"), ","), 256)


def compare_packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row of docs, of its edited text, and their likeness to each other and to the next row's.

    Returns (id, n_chars, edited, packed, edited_packed, near_edited, near_next). edited: the last quarter of a text's
    code points, rounded down, gives way to as many first ones of the next document's (or all of them, where it has
    fewer). The next document is that of the next greater id, after the last the first; a single one follows itself.
    Null ids come first. Rows of one id follow each other by the hash of their texts, copies in the order in which docs
    gives them, so that docs should give its rows in the same order each time it is read, as files do.

    Texts are moved once, by range of id; the first row of each range goes to the range before as well. A hot id is cut
    into ranges like any other rows. Null texts are empty; other columns of docs are not read.
    """
    i, t, h, place, part, guest = fresh_names(docs, "doc", "whole", "text_hash", "row_place", "row_range", "is_guest")
    own = docs.select(F.col(id_col).alias(i), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias(t)).withColumns({h: F.xxhash64(t), place: F.monotonically_increasing_id()})
    order = [i, h, place]
    found = ranges(own, order, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = max(0, len(found) - 1)
    placed = own.withColumn(part, found.range_of())
    before = F.when(F.col(part) == 0, F.lit(last)).otherwise(F.col(part) - 1)
    here, there = F.struct(F.col(part).alias(part), F.lit(0).alias(guest)), F.struct(before.cast("int").alias(part), F.lit(1).alias(guest))
    seats = F.explode(F.when(found.is_first(F.col(part)), F.array(here, there)).otherwise(F.array(here))).alias("seat")
    dealt = placed.select(*order, t, seats).select(*order, t, f"seat.{part}", f"seat.{guest}").repartition(part).sortWithinPartitions(part, guest, *order)
    marked = dealt.select(*order, t, part, guest, winnow(F.col(t)).alias("packed"))
    following = F.lead(F.struct(F.col(t).alias("text"), F.col("packed").alias("packed"))).over(Window.partitionBy(part).orderBy(guest, *order))
    pairs = marked.withColumn("next", following).where(F.col(guest) == 0)
    n, cut = F.char_length(t), F.floor(F.char_length(t) / 4).cast("int")
    edited = F.concat(F.substring(t, F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    texts = pairs.select(F.col(i).alias("id"), n.alias("n"), (n - cut).alias("kept"), edited.alias("edited"), "packed", F.col("next.packed").alias("next_packed"))
    both = texts.withColumn("edited_packed", winnow_edited(F.col("packed"), F.col("n"), F.col("kept"), F.col("edited")))
    return both.select(
        "id",
        F.col("n").cast("long").alias("n_chars"),
        "edited",
        "packed",
        "edited_packed",
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """compare_packed with the fingerprints as arrays of struct(hash, place), prints and edited_prints."""
    prints = [places(F.col(x)).alias(y) for x, y in (("packed", "prints"), ("edited_packed", "edited_prints"))]
    return compare_packed(docs, id_col, text_col).select("id", "n_chars", "edited", *prints, "near_edited", "near_next")
