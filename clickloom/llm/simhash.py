"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Two rules. The narrow one takes 64 bits of three-word shingles, of which 3 may differ: it finds all such pairs. The wide
one is for near copies: 256 bits of five-word shingles, of which 44 may differ; where two documents share 0.8 of their
shingles about 39 do, give or take 6. Such pairs agree in no long block for sure, so the wide rule deals fingerprints out
by sampled bits, in as many tables as its recall wants, and joins a trie with itself inside each bucket. The bits are
the same for any input, so that whether two fingerprints link depends on these two alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, VariantType

from clickloom.llm.components import Forest, connected_components
from clickloom.llm.shared import cut, fresh_names

SHINGLE, SEED, BUDGET, BLOCK = 3, 42, 3, 16
#: Distinct fingerprints of one block beyond which the block is dealt out anew by parts of its other bits.
HOT_BLOCK = 4_096
#: Bits that agree at a key which is not dealt out any further.
_DEEPEST = 43
#: The wide rule: words of a shingle, 64-bit lanes of a fingerprint, bits that may differ; its tables and the sampled bits
#: of each, all of which two fingerprints share in some table: 0.99 of pairs of just that many differing bits do.
WIDE_SHINGLE, LANES, WIDE_BUDGET = 5, 4, 44
WIDE_TABLES, WIDE_BITS = 42, 12
#: Where a caller asks for buckets of a size: fingerprints of one on average at most, and the share of such pairs.
WIDE_CELL, WIDE_RECALL = 256, 0.95
_PIECE = 65_536
#: Keys of a trie node that the wide rule compares one by one; pairs of two nodes from which they are compared as a
#: table; pairs of many small ones that are compared at a time.
_LEAF, _TABLE, _COMPARED = 256, 2_048, 1 << 19


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, as rows of 8 bytes, the high one first; of all its words where they are fewer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only U+0009 to U+000D and U+0020 part words
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest, seed = xxhash.xxh64_digest, SEED
    return np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in pairs]), np.uint8).reshape(-1, 8)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        ones += np.unpackbits(hashes[at : at + _PIECE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 where it has no word."""
    return _majority(_hashes(text, SHINGLE))


def wide_fingerprint(text: str | None) -> list[int]:
    """LANES times 64 bits, unsigned; all 0 where there is no word. Lane k mixes each hash with k."""
    rows = _hashes(text, WIDE_SHINGLE)
    first, out = rows.view(">u8").astype(np.uint64).ravel(), [_majority(rows)]
    for k in range(1, LANES):
        z = first + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority((z ^ (z >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8)))
    return out


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), index=texts.index)


fingerprint_udf = F.pandas_udf(_fingerprints, LongType())


def _wide_fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([x.tolist() for x in np.array([wide_fingerprint(t) for t in texts], np.uint64).reshape(len(texts), LANES).view(np.int64)], index=texts.index, dtype=object)


wide_fingerprint_udf = F.pandas_udf(_wide_fingerprints, ArrayType(LongType()))


def _compared(lanes: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of one of each range a and one of its range b that differ in at most budget bits, each
    pair once where both are one range."""
    count = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(count >= _TABLE).tolist():
        x, y = lanes[a0[k] : a1[k]], lanes[b0[k] : b1[k]]
        differ = np.zeros((len(x), len(y)), np.uint16)
        for c in range(lanes.shape[1]):
            differ += np.bitwise_count(x[:, c, None] ^ y[None, :, c])
        i, j = np.nonzero(differ <= budget)
        i, j = i + a0[k], j + b0[k]
        new = (i < j) if a0[k] == b0[k] else slice(None)
        yield i[new], j[new]
    few = count < _TABLE
    a0, b0, wide, count = a0[few], b0[few], (b1 - b0)[few], count[few]
    ends, at = np.cumsum(count), 0
    while at < len(count):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _COMPARED, "right")))
        k = np.repeat(np.arange(at, to), count[at:to])
        i, j = np.divmod(np.arange(len(k)) - (ends - count - done)[k], wide[k])
        i, j, new = i + a0[k], j + b0[k], a0[k] != b0[k]
        new |= i < j
        i, j = i[new], j[new]
        hit = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1) <= budget
        yield i[hit], j[hit]
        at = to


def trie_pieces(keys: np.ndarray, group: np.ndarray, depth: int, budget: int = BUDGET, known: Callable[..., np.ndarray] | None = None, leaf: int = 1, begin: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs of one group whose keys differ in at most budget bits, piece by piece.

    keys: uint64, or rows of several, rising and distinct inside a group; group: one value a row, equal ones together.
    Members of a group agree in the first depth bits of their keys. A trie node is a range of the sorted keys. All
    groups start as pairs (node, itself) at that depth; one step takes each pair to the pairs of its children, adds a
    bit to the differences where the two sides part, and drops pairs over the budget. Nodes of at most leaf keys are
    compared key by key, as a budget that is wide for its bits prunes little further up. known tells which pairs of
    ranges need no look, as all their keys are connected by now. Where even the largest difference that is left fits the
    budget, all keys of both nodes hang on the first one: enough for components. Pairs wait on a stack in pieces of
    bounded size, the deepest first. begin: ranges (a0, a1, b0, b1) to begin with instead of each group with itself.
    """
    lanes = keys.reshape(len(keys), -1)
    total = 64 * lanes.shape[1]
    if begin is None:
        cuts = np.flatnonzero(np.diff(group)) + 1
        lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        begin = lo, hi, lo, hi
    ones: dict[int, np.ndarray] = {}  # by bit: how many keys before a place have it set
    stack = [(depth, *begin, np.zeros(len(begin[0]), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > _PIECE:
            half = len(a0) // 2
            stack += [(depth, *(x[part] for x in (a0, a1, b0, b1, err))) for part in (slice(half), slice(half, None))]
            continue
        if known:
            new = ~known(a0, a1, b0, b1)
            a0, a1, b0, b1, err = (x[new] for x in (a0, a1, b0, b1, err))
        same = a0 == b0
        few = (a1 - a0 <= leaf) & (b1 - b0 <= leaf)
        yield from _compared(lanes, a0[few], a1[few], b0[few], b1[few], budget)
        whole = ~few & (err + total - depth <= budget)
        for x0, x1, y0, y1 in zip(*(x[whole].tolist() for x in (a0, a1, b0, b1)), strict=True):
            yield np.full(x1 - x0, x0), np.arange(x0, x1)
            yield np.full(y1 - y0, x0), np.arange(y0, y1)
        live = ~few & ~whole
        a0, a1, b0, b1, err, same = (x[live] for x in (a0, a1, b0, b1, err, same))
        if not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((lanes[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)))).astype(np.int64)
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])  # where the keys with this bit begin
        parts = ((a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1))
        keep = [(x1 > x0) & (y1 > y0) & (e <= budget) for x0, x1, y0, y1, e in parts]
        keep[3] &= ~same  # the turned pair of (0, 1) of one node
        stack.append((depth + 1, *(np.concatenate([p[k][m] for p, m in zip(parts, keep, strict=True)]) for k in range(5))))


def trie_links(keys: np.ndarray, group: np.ndarray, depth: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of trie_pieces at once."""
    found = list(trie_pieces(keys, group, depth, budget))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _join_blocks(depth: int):
    """mapInPandas over rows (key, turned, fp) sorted by key and turned; whole keys are joined, a batch's last one waits."""

    def links(key, turned, fp):
        forest = Forest(len(fp))
        for i, j in trie_pieces(turned.view(np.uint64), key, depth, BUDGET, forest.connects):
            forest.add(i, j)
        a, b = forest.stars()
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    def run(batches):
        wait: list[pd.DataFrame] = []
        for batch in batches:
            wait.append(batch)
            last = batch["key"].iat[-1]
            if sum(map(len, wait)) < _PIECE or wait[0]["key"].iat[0] == last:
                continue
            rows = pd.concat(wait, ignore_index=True)
            end = int(np.flatnonzero((rows["key"] == last).to_numpy())[0])
            yield links(*(rows[c].to_numpy()[:end] for c in ("key", "turned", "fp")))
            wait = [rows.iloc[end:]]
        if wait:
            rows = pd.concat(wait, ignore_index=True)
            yield links(*(rows[c].to_numpy() for c in ("key", "turned", "fp")))

    return run


def _turn(value: str, by: str, bits: int = 64) -> str:
    """SQL: the low bits of value turned left by a number of bits below bits."""
    if bits == 64:
        return f"CASE WHEN {by} = 0 THEN {value} ELSE shiftleft({value}, {by}) | shiftrightunsigned({value}, 64 - {by}) END"
    low = (1 << bits) - 1
    return f"((shiftleft({value} & {low}, {by}) | shiftrightunsigned({value} & {low}, {bits} - {by})) & {low})"


def _by_blocks(fps: DataFrame) -> DataFrame:
    """Each fingerprint at its four 16-bit blocks: of 4 blocks, 3 differing bits leave one alike."""
    turns = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in range(0, 64, BLOCK)])).alias("by"))
    turned = turns.select("fp", "by", F.expr(_turn("fp", "by")).alias("turned"))
    return turned.select("fp", "turned", F.expr(f"shiftrightunsigned(turned, {64 - BLOCK}) * 64 + by").alias("key"))


def _by_parts(rows: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Rows of hot keys, whose members agree in depth bits, at four parts of their other bits, one of which is alike
    again; and how many bits then agree. That part is turned to stand behind the bits that agree already."""
    rest = 64 - depth
    part = rest // 4
    turns = rows.select("fp", "key", "turned", F.explode(F.array(*[F.lit(x) for x in range(0, 4 * part, part)])).alias("by"))
    turned = turns.select("fp", "key", "by", F.expr(f"(turned & {-(1 << rest)}L) | {_turn('turned', 'by', rest)}").alias("turned"))
    # a key stands for what its members agree in: one hash of all that is no more alike than the bits are
    alike = F.expr(f"shiftrightunsigned(turned, {rest - part})")
    return turned.select("fp", "turned", F.xxhash64("key", "by", alike).alias("key")), depth + part


def _join(rows: DataFrame, depth: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unsigned = F.expr("turned ^ (-9223372036854775807L - 1L)")
    # by another expression than the join before it: Spark would leave the repartition out, and then may part one key's rows
    dealt = rows.repartition(n, F.xxhash64("key")).sortWithinPartitions("key", unsigned)
    return dealt.select("key", "turned", "fp").mapInPandas(_join_blocks(depth), "a long, b long")


def link_fingerprints(fps: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Links (a, b) between distinct 64-bit fingerprints (column fp) at BUDGET or fewer differing bits.

    As many links as join what is connected: those of a block come as stars. Keys of more than hot_block fingerprints
    are dealt out again by a further part of their bits, until no such key is left or _DEEPEST bits agree, so that a
    task gets few unrelated ones.
    """
    rows, depth, found = _by_blocks(fps), BLOCK, None
    while True:
        hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_block).select("key"))
        last = depth >= _DEEPEST or hot.isEmpty()
        links = _join(rows if last else rows.join(hot, "key", "left_anti"), depth)
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        rows, depth = _by_parts(rows.join(hot, "key", "left_semi"), depth)


def tables(n: int, cell: int = WIDE_CELL) -> tuple[int, int]:
    """(tables, sampled bits of each) for n fingerprints in buckets of about cell. One bit more halves the buckets."""
    bits = max(0, math.ceil(math.log2(max(1, n) / cell)))
    alike = (1 - WIDE_BUDGET / (64 * LANES)) ** bits
    return (1, 0) if not bits else (math.ceil(math.log(1 - WIDE_RECALL) / math.log(1 - alike)), bits)


def sampled_bits(count: int, bits: int) -> np.ndarray:
    """The bits that each table looks at, from the highest of the first lane on."""
    rng = np.random.default_rng([SEED, bits])
    return np.stack([rng.permutation(64 * LANES)[:bits] for _ in range(count)])


def _bucket_keys(count: int, bits: int):
    """mapInArrow over (node, fp): a row (tab, key, node, fp) for each table."""
    places = sampled_bits(count, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lanes = part.column("fp").flatten().to_numpy().reshape(-1, LANES)
                ones = np.unpackbits(lanes.astype(">i8").view(np.uint8).reshape(len(lanes), -1), axis=1)
                keys = ones[:, places].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                rows = part.take(pa.array(np.repeat(np.arange(len(lanes)), count)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), len(lanes))), pa.array(keys.ravel()), *rows.columns], names=["tab", "key", "node", "fp"])

    return run


_BUCKET = ["tab", "key", "ta", "tb"]


def _join_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by _BUCKET: stars of what the wide rule links inside a bucket."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in _BUCKET], axis=1)
        group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
        lanes = rows.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
        side = rows.column("side").to_numpy()
        order = np.lexsort((*lanes.T[::-1], side, group))
        lanes, node, forest = lanes[order], rows.column("node").to_numpy()[order], Forest(len(order))
        # a tile meets itself in a bucket of its own, so that two tiles only meet each other
        lo, size = np.unique(group, return_index=True, return_counts=True)[1:]
        hi, mid = lo + size, lo + size - np.bincount(group, side, len(lo)).astype(np.int64)
        two = keys[lo, 2] != keys[lo, 3]
        begin = lo, np.where(two, mid, hi), np.where(two, mid, lo), hi
        met = (begin[1] > begin[0]) & (begin[3] > begin[2])
        for i, j in trie_pieces(lanes, group, 0, WIDE_BUDGET, forest.connects, _LEAF, tuple(x[met] for x in begin)):
            forest.add(i, j)
        a, b = forest.stars()
        return pa.RecordBatch.from_pydict({"a": node[a], "b": node[b]})

    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        if sum(x.num_rows for x in wait) < _PIECE:
            continue
        # the last bucket may go on in the next batch
        rows = pa.Table.from_batches(wait).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in _BUCKET], axis=1)
        end = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])
        if end:
            yield links(rows.slice(0, end).to_batches())
        wait = rows.slice(end).to_batches()
    if wait:
        yield links(wait)


def link_wide(classes: DataFrame, cell: int | None = None, hot_block: int = HOT_BLOCK, exact: bool = False) -> DataFrame:
    """Links (a, b) between nodes (node, fp) of distinct wide fingerprints at WIDE_BUDGET or fewer differing bits that
    share all sampled bits of some table: all such pairs, whatever the input's size.

    As many links as join what is connected: those of a bucket come as stars. Buckets of more than twice hot_block
    fingerprints are cut into tiles by a hash, and each pair of tiles is a bucket of its own. cell: tables for buckets
    of that size instead, so that the rule changes with the number of fingerprints. exact: all fingerprints are
    one bucket, whatever their number, so that no pair is lost; the work is then the square of their number.
    """
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looks = (1, 0) if exact else (WIDE_TABLES, WIDE_BITS) if cell is None else tables(classes.count(), cell)
    placed = classes.select("node", "fp").mapInArrow(_bucket_keys(*looks), "tab int, key long, node long, fp array<long>")
    hot = cut(placed.groupBy("tab", "key").agg(F.count("*").alias("size")).where(F.col("size") > 2 * hot_block))
    if hot.isEmpty():
        dealt = placed.withColumns({"ta": F.lit(0), "tb": F.lit(0), "side": F.lit(0)})
    else:
        parts = F.coalesce(F.ceil(F.col("size") / hot_block), F.lit(1)).cast("int")
        own = placed.join(hot, ["tab", "key"], "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = each.withColumns({"ta": F.least("own", "other"), "tb": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    sorted_ = dealt.select(*_BUCKET, "side", "node", "fp").repartition(n, *_BUCKET).sortWithinPartitions(*_BUCKET)
    return sorted_.mapInArrow(_join_buckets, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_block: int = HOT_BLOCK) -> DataFrame:
    """(id, fp, component_id) for every row of docs: fp the fingerprint as a signed long.

    component_id is the least id that is reachable over links of BUDGET or fewer differing bits, the row's own
    included. Texts that are null, empty or without words have fingerprint 0 and are linked like others; invalid UTF-8
    counts as U+FFFD; repeated
    rows stay repeated; rows with a null id are linked too, and a component of null ids alone has a null
    component_id. Other columns of docs are not read. An empty table gives an empty one.
    """
    marked = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.make_valid_utf8(F.col(text_col))).alias("fp")))
    return group_fingerprints(marked, hot_block)


def group_fingerprints(marked: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """near_duplicates for rows (id, fp)."""
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(link_fingerprints(classes.select("fp"), hot_block))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return _named(marked, rooted)


def _named(marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of marked with the least id of all fingerprints that have one root."""
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # a plain side, so that Spark can split a hot root
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")


def group_wide(marked: DataFrame, cell: int | None = None, hot_block: int = HOT_BLOCK, exact: bool = False) -> DataFrame:
    """As group_fingerprints, by the wide rule."""
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = connected_components(link_wide(classes, cell, hot_block, exact))
    return _named(marked, classes.join(found, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """The rows of docs without their near-duplicates, by the narrow or the wide rule: of each component the row with
    the least id stays.

    Of repeated rows (equal id and text) one stays, where other columns differ the one whose columns have the least
    hash; of rows with one id and different texts that are linked, the one with the least text hash. A null id counts
    as larger than any. All columns of docs come back unchanged.
    """
    i, h, n = fresh_names(docs, "keep_id", "keep_hash", "keep_row")
    whole_id, hash_of = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    marked = cut(docs.select(F.struct(whole_id.alias("i"), hash_of.alias("h")).alias("id"), (wide_fingerprint_udf if wide else fingerprint_udf)(F.make_valid_utf8(F.col(text_col))).alias("fp")))
    rows = (group_wide if wide else group_fingerprints)(marked).groupBy("id").agg(F.max(F.col("component_id") == F.col("id")).alias("leads"), F.count("*").alias("n"))
    # decided on narrow rows: whole documents only meet what goes, and the few repeated ones each other
    rows = cut(rows.where("NOT leads OR n > 1").select(F.col("id.i").alias(i), F.col("id.h").alias(h), "leads"))
    named = docs.withColumns({i: whole_id, h: hash_of})
    hashed = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]  # the others have no hash
    first = Window.partitionBy(i, h).orderBy(F.xxhash64(*hashed))
    repeated = named.join(rows.where("leads").select(i, h), [i, h], "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return named.join(rows.select(i, h), [i, h], "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))
