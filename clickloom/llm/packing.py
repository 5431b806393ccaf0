"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import sliced
from clickloom.llm.text_ids import encoder

SEQUENCE, OPEN_BINS, END_ID = 2048, 512, 0


class BestFit:
    """Bounded-space online best-fit.

    At most OPEN_BINS bins are open. A bit of an integer says whether some open bin has just that much free space;
    the lowest set bit at or above a piece's length is the best fit. If none fits, a new bin opens, and where there
    are too many, the fullest closes first. Bins with no space left close at once.
    """

    def __init__(self, size: int, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.free, self.bins, self.open, self.next = 0, [[] for _ in range(size + 1)], 0, 0

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        number = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it for a piece of 1 to size."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.next
            self.next += 1
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space


def pieces_of(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, behind a first piece that takes what is left over."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _packer(path: str, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins = encoder(path), BestFit(size, most)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], np.uint32)
        for batch in sliced(batches):
            owner, piece, start, length, ids, offset, sequence = ([] for _ in range(7))
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = np.concatenate((encode.encode(text or ""), end)).astype("<u4")
                for k, (at, n) in enumerate(pieces_of(len(own), size)):
                    number, place = bins.place(n)
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    ids.append(own[at : at + n].tobytes())
                    offset.append(place)
                    sequence.append(base + number)
            columns = [batch.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(offset, pa.int64()), pa.array(sequence, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids", "offset", "sequence_id"])

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Documents as pieces placed in sequences of at most size tokens.

    vocabulary: the path of a tokenizers file, readable on every executor. A document is its ids and then
    END_ID, so that a null or empty text is one token. Returns, for each piece, id, piece (from 0), start (ids of
    the document before it), length, ids (little-endian unsigned 32-bit integers), sequence_id and offset (gapless
    from 0 in each sequence). Only documents longer than size are cut. Each partition packs its own rows in the order
    in which they come, piece by piece, so that nothing is shuffled, the size of Arrow batches makes no difference,
    and a lost task gives the same rows again; memory is bounded by a slice of texts and the open bins. Null ids and
    repeated rows are packed like others; an empty table gives an empty one.
    """
    schema = "id long, piece int, start long, length long, ids binary, offset long, sequence_id long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text")).mapInArrow(_packer(vocabulary, size, open_bins), schema)
