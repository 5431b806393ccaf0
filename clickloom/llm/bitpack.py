"""Token files of fixed-width ids: each id takes the least bits that the vocabulary needs.

A token file is a Parquet part whose rows are blocks. A block holds whole documents in rising order of id: the file's
number, how many ids of the file come before it, the ids and sizes of its documents, the width, and the packed ids.
Id k of a block stands at bit k * width, the low bit first, so that any range is unpacked by itself with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.shared import sliced
from clickloom.llm.text_ids import encoder

#: Ids after which a block closes.
BLOCK_IDS = 1 << 16
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
_SCHEMA = "file int, block int, first long, doc_ids array<long>, sizes array<int>, width int, packed binary"
_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("width", pa.int32()), ("packed", pa.binary())])


def width_of(vocabulary_size: int) -> int:
    """Bits that hold ids below vocabulary_size."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    if width in _WHOLE:
        return ids.astype(_WHOLE[width]).tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack_ids(packed: bytes, width: int, start: int, count: int) -> np.ndarray:
    """count ids from the start-th on, reading only the bytes that hold them."""
    at, skip = divmod(start * width, 8)
    raw = np.frombuffer(packed, np.uint8)[at : (start * width + count * width + 7) // 8]
    if width in _WHOLE:
        return raw.view(_WHOLE[width]).astype(np.uint32)
    bits = np.unpackbits(raw, bitorder="little")[skip : skip + count * width].reshape(count, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def _block_writer(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        block, first, names, sizes, held, n = 0, 0, [], [], [], 0

        def closed() -> dict:
            return {"file": file, "block": block, "first": first, "doc_ids": names, "sizes": sizes, "width": width, "packed": pack_ids(np.concatenate(held), width)}

        for batch in sliced(batches):
            rows = []
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode.encode(text or "")
                names.append(name)
                sizes.append(len(ids) + 1)
                held += [ids, end]
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    rows.append(closed())
                    block, first, names, sizes, held, n = block + 1, first + n, [], [], [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], schema=_ARROW)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, end_id behind, into token files under path, over all files in rising order of id.

    vocabulary: a tokenizers file that every executor can read. Null ids come first, and rows of one id in the order
    of a hash of their text; a null or empty text is end_id alone; an empty table gives files without blocks. Texts
    are dealt out by ranges of (id, hash, place in the input), so that no range holds one hot id whole, nor all copies
    of one row. They are encoded behind that shuffle: packed ids are no smaller than the compressed texts.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("place"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    ordered = own.repartitionByRange(n, "id", "h", "place").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(_block_writer(vocabulary, end_id, width_of(vocabulary_size)), _SCHEMA).write.parquet(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block is unpacked once; each of its documents is a slice of the result."""
    for batch in sliced(batches, "packed"):
        names = batch.column("doc_ids").flatten()
        counts = batch.column("sizes").flatten().to_numpy().astype(np.int64)
        whole, starts = [], []
        for sizes, width, packed, start in zip(*(batch.column(c).to_pylist() for c in ("sizes", "width", "packed", "start")), strict=True):
            own = np.array(sizes, np.int64)
            starts.append(start + np.cumsum(own) - own)
            whole.append(unpack_ids(packed, width, 0, int(own.sum())))
        ends = np.concatenate(([0], np.cumsum(counts) * 4))
        ids = np.concatenate(whole).astype("<u4")
        binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(starts)), pa.array(counts), binary.cast(pa.binary())], names=["id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the token files under path.

    start: ids of all documents before it, over all files; ids: little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    files = blocks.groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each file
    placed = blocks.join(F.broadcast(offsets), "file").select("doc_ids", "sizes", "width", "packed", (F.col("before") + F.col("first")).alias("start"))
    return placed.mapInArrow(_unpacked, "id long, start long, n_tokens long, ids binary")
