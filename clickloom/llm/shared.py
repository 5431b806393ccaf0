"""Helpers that the document operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.shared import shared_folder

#: White space of the word rules: U+0020 and U+0009 to U+000D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python task turns into objects at a time.
SLICE = 1 << 22


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about most bytes of a column, a row at least, whatever the session's batch size is.

    Spark itself bounds a batch (spark.sql.execution.arrow.maxBytesPerBatch), which bounds what a task is given; a
    slice bounds what it makes of it.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores in front until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words between WORD_BREAK; a null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
