"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many Gaussian directions, and each projection is sorted. Around every query a window of a
fixed half-width is laid in each sorted projection; the windows that a pair shares are counted, and pairs that pass a
count are verified by their cosine. Width and count are set from the recall that is wanted: for a pair at distance d
the difference of a projection is normal with deviation d.

Where a label has more vectors than a cell should hold, further directions cut it in halves, several at once, into
cells of about that size, and windows are laid inside cells alone. A near pair may stand on two sides of a cut, so
there are several such grids, as many as the recall wants. Each doubling of a label costs one more cut, and so a fixed
factor of grids: the work for a label of n vectors grows as n to the power of about 1.2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from clickloom.llm.components import Forest, connected_components
from clickloom.llm.shared import cut

COSINE, PROJECTIONS, RECALL = 0.93, 32, 0.9995
#: Vectors that a cell holds on average at most; the share of pairs at the cosine that some grid keeps together; rows
#: that are compared at a time.
CELL, GRID_RECALL, _BLOCK = 4096, 0.999, 256
_SEED = 11


def grids(n: int, cosine: float = COSINE, cell: int = CELL) -> tuple[int, int]:
    """(grids, cuts of each) for a label of n vectors. A cut parts a pair with a probability of its angle over pi."""
    cuts = max(0, math.ceil(math.log2(max(1, n) / cell)))
    together = (1 - math.acos(cosine) / math.pi) ** cuts
    return (1, 0) if not cuts else (math.ceil(math.log(1 - GRID_RECALL) / math.log(1 - together)), cuts)


def least_count(m: int, p: float, recall: float) -> int:
    """The largest count that a binomial of m trials at p reaches with this probability."""
    below, term = 0.0, [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
    for k in range(m + 1):
        below += term[k]
        if below > 1 - recall:
            return k
    return m


def _directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim]).normal(size=(dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def window(cosine: float) -> float:
    """Half the width of a window: the deviation of a pair's difference at this cosine."""
    return math.sqrt(2 - 2 * cosine)


def near_pairs(a: np.ndarray, b: np.ndarray, cosine: float = COSINE, m: int = PROJECTIONS, recall: float = RECALL, done: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of two tables of at most 65,535 unit vectors at this cosine or more, in blocks of a.

    At a recall of 1 all pairs are verified. done: a rising number for each row of a and of b; a block of a that has one
    number alone is not compared with the rows of b that have it, as another grid has these pairs.
    """
    if recall >= 1:
        for at in range(0, len(a), _BLOCK):
            i, j = np.nonzero(a[at : at + _BLOCK] @ b.T >= cosine)
            yield i + at, j
        return
    half = window(cosine)
    count = least_count(m, math.erf(1 / math.sqrt(2)), recall)
    ways = _directions(a.shape[1], m)
    pa, pb = a @ ways, b @ ways
    order = np.argsort(pb, axis=0)
    rank = np.empty((m, len(b)), np.uint16)
    np.put_along_axis(rank, order.T, np.arange(len(b), dtype=np.uint16)[None, :], axis=1)
    low, size = np.empty((m, len(a)), np.uint16), np.empty((m, len(a)), np.uint16)
    for k in range(m):
        ranked = pb[order[:, k], k]
        begin = np.searchsorted(ranked, pa[:, k] - half)
        low[k], size[k] = begin, np.searchsorted(ranked, pa[:, k] + half, side="right") - begin
    for at in range(0, len(a), _BLOCK):
        part, columns = slice(at, at + _BLOCK), None
        if done and done[0][part][0] == done[0][part][-1]:
            begin, end = np.searchsorted(done[1], done[0][at], "left"), np.searchsorted(done[1], done[0][at], "right")
            columns = np.concatenate((np.arange(begin), np.arange(end, len(b)))) if end > begin else None
            if columns is not None and not len(columns):
                continue
        shared = np.zeros((len(a[part]), len(b) if columns is None else len(columns)), np.uint8)
        for k in range(m):
            own = rank[k] if columns is None else rank[k][columns]
            shared += (own[None, :] - low[k, part, None]) < size[k, part, None]  # in the window: ranks wrap below it
        i, j = np.nonzero(shared >= count)
        many = len(i) * 8 > shared.size
        j = j if columns is None else columns[j]
        if many:
            sure = (a[part] @ b.T)[i, j] >= cosine
        else:
            sure = np.concatenate([np.zeros(0, bool), *(np.einsum("xy,xy->x", a[i[x : x + 65536] + at], b[j[x : x + 65536]]) >= cosine for x in range(0, len(i), 65536))])
        yield i[sure] + at, j[sure]


def cells(units: np.ndarray, count: int, cuts: int) -> np.ndarray:
    """(vectors, grids): the cell of each unit vector in each grid, as the bits of its sides."""
    if not cuts:
        return np.zeros((len(units), count), np.int64)
    ways = np.random.default_rng([_SEED, 1, units.shape[1]]).normal(size=(count * cuts, units.shape[1]))
    sides = (units @ ways.T >= 0).reshape(len(units), count, cuts)
    return sides @ (np.int64(1) << np.arange(cuts, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _with_cells(cosine: float, cell: int, exact: bool):
    """mapInArrow: adds the cells of each vector, by the number of its label's vectors in column n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None] * batch.num_rows
            shapes = np.stack([batch.column(c).to_numpy() for c in ("dim", "n")], axis=1)
            for shape in np.unique(shapes, axis=0):
                own = np.flatnonzero((shapes == shape).all(axis=1))
                for i, x in zip(own.tolist(), cells(unit(_matrix(batch.column("vec").take(pa.array(own)))), *((1, 0) if exact else grids(int(shape[1]), cosine, cell))).tolist(), strict=True):
                    found[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return run


_KEY = ["name", "dim", "grid", "cell", "ta", "tb"]


def _edges(batch: pa.RecordBatch) -> list[int]:
    """The places where the key changes, first and end included."""
    differ = np.zeros(batch.num_rows - 1, bool)
    for c in _KEY:
        x = batch.column(c)
        differ |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]


def _join_tiles(cosine: float, recall: float):
    """mapInArrow over rows sorted by _KEY: links by node, and stars of what they join."""

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        if rows.num_rows < 2:
            return
        grid = rows.column("grid")[0].as_py()
        order = [rows.column("node").to_numpy()] + ([pc.list_element(rows.column("cells"), 0).to_numpy()] if grid else [])
        rows = rows.take(pa.array(np.lexsort(order)))
        node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
        same = rows.column("ta")[0].as_py() == rows.column("tb")[0].as_py()
        vectors, where = unit(_matrix(rows.column("vec").combine_chunks())), _matrix(rows.column("cells").combine_chunks())
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        if len(left) and len(right):
            done = (where[left, 0], where[right, 0]) if grid else None  # what the first grid has together, it compares
            for i, j in near_pairs(vectors[left], vectors[right], cosine, PROJECTIONS, recall, done):
                if same:
                    i, j = i[i < j], j[i < j]
                i, j = left[i], right[j]
                new = ~(where[i] == where[j]).any(axis=1)  # else an earlier grid has this pair
                i, j = i[new], j[new]
                links += np.bincount(i, copies[j], len(links)).astype(np.int64) + np.bincount(j, copies[i], len(links)).astype(np.int64)
                forest.add(i, j)
        found = np.flatnonzero(links)
        if len(found):
            yield pa.RecordBatch.from_pydict({"node": node[found], "links": links[found], "root": node[forest.root[found]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _edges(batch)
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                now = [batch.column(c)[begin].as_py() for c in _KEY]
                if wait and now != key:
                    yield from joined(wait)
                    wait = []
                key = now
                wait.append(batch.slice(begin, end - begin))
        if wait:
            yield from joined(wait)

    return run


def _dealt(points: DataFrame, cell: int) -> DataFrame:
    """Each point at its cell of every grid; cells of more than twice the size that is meant are cut into tiles by a
    hash, and a point goes to each pair of tiles that its own belongs to."""
    key = _KEY[:4]
    placed = points.select("name", "dim", F.posexplode("cells").alias("grid", "cell"), "node", "vec", "copies", "cells")
    hot = points.select("name", "dim", F.posexplode("cells").alias("grid", "cell")).groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > 2 * cell)
    parts = F.coalesce(F.ceil(F.col("size") / cell), F.lit(1)).cast("int")
    own = placed.join(hot, key, "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = (F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    earlier = F.slice("cells", F.lit(1), F.col("grid")).alias("cells")  # a pair that one of these holds is not counted again
    return each.select(*key, *pair, "node", "vec", "copies", earlier)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, cell: int = CELL, exact: bool = False) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    Rows are linked where labels are equal (in their own type) and not null, vectors have one length, and their cosine
    in double precision is cosine or more; each such pair is found with a probability of RECALL at least in a label of
    up to cell vectors, of RECALL * GRID_RECALL in a larger one; none below is. exact: each pair of a label is verified,
    in tiles, so that none is lost; the work is then the square of a label. Equal vectors of a label are one node
    with a number of copies. n_links: other rows linked directly; component_id: the
    least id that is reachable, the row's own included; kept: whether that is the row's id. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. A row with a null id is linked too; a
    component of null ids alone has a null component_id, and kept is then true. Repeated rows are rows of their own.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("vec")
    sound = F.size(v) > 0
    sound &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull())
    good = rows.where("sound").select("id", "label", "vec", F.xxhash64(F.lit(1), v).alias("h"), F.xxhash64(F.lit(2), v).alias("g"), F.size(v).alias("dim"))
    sizes = good.groupBy("label", "dim").agg(F.count("*").alias("n"))
    nodes = good.groupBy("label", "h", "g", "dim", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).join(sizes, ["label", "dim"])
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), F.col("label").cast("string").alias("name"), "label", "h", "g", "dim", "n", "vec", "least", "copies")
    points = cut(nodes.mapInArrow(_with_cells(cosine, cell, exact), StructType([*nodes.schema.fields, StructField("cells", ArrayType(LongType()))])))
    dealt = _dealt(points, cell).repartition(n, *_KEY).sortWithinPartitions(*_KEY)
    found = cut(dealt.mapInArrow(_join_tiles(cosine, 1.0 if exact else RECALL), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = cut(points.select("node", "label", "h", "g", "least", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = cut(known.groupBy("root").agg(F.min("least").alias("component_id")))  # plain sides, so that Spark can split a hot root
    by_node = known.join(named, "root").select("label", "h", "g", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.select("id", "label", "h", "g").join(by_node, ["label", "h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
