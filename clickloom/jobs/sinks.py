"""Writing indexes, caches, submissions, metrics and the run ledger."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clickloom.functions.columns import sanitize_field
from clickloom.operators.recommend import recent_items
from clickloom.schema import INDEX, LEDGER, RECENT
from clickloom.sources.shared import concatenate


def write_index(index: DataFrame, path: str) -> None:
    """The candidate index as Parquet, a folder for each variant where it has that column."""
    writer = index.write.mode("overwrite")
    (writer.partitionBy("variant") if "variant" in index.columns else writer).parquet(path)


def write_buckets(rows: DataFrame, table: str, path: str, buckets: int) -> None:
    """rows as a table in buckets by aid_key, a folder for each variant where there is such a column.

    Two tables in as many buckets join on aid_key without moving a row.
    """
    # rows of a bucket meet in one task, so that each bucket is one file of a variant
    dealt = rows.repartition(buckets, "aid_key")
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "aid_key").sortBy("aid_key").option("path", path)
    (writer.partitionBy("variant") if "variant" in rows.columns else writer).saveAsTable(table)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that write_index wrote with its variants; one without rows is empty."""
    return spark.read.schema(StructType([*INDEX.fields, StructField("variant", StringType())])).parquet(path)


def write_metadata(spark: SparkSession, path: str, metadata: Mapping[str, object]) -> None:
    """A run's parameters as one row of JSON."""
    line = json.dumps(dict(metadata), sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached_recent_items(events: DataFrame, path: str, topk: int, source: str, refresh: bool = False) -> DataFrame:
    """recent_items, kept under path by topk and by source, which tells inputs apart (fingerprint of their files).

    An older copy is used if it was written to its end, which its success mark tells, and unless refresh is set.
    """
    spark, at = events.sparkSession, f"{path}/top{topk}-{source}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if refresh or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        recent_items(events, topk).write.mode("overwrite").parquet(at)
    return spark.read.schema(RECENT).parquet(at)


def write_submission(rows: DataFrame, path: str) -> None:
    """session_type and labels as CSV with a header, a folder for each variant where there is such a column."""
    writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "")
    (writer.partitionBy("variant") if "variant" in rows.columns else writer).csv(path)


def write_ordered_submission(rows: DataFrame, path: str) -> list[str]:
    """One CSV file for each variant, submission_<variant>.csv, with a header, in the order of sessions and event types;
    the paths of the files.

    rows: (variant, session, turn, session_type, labels). Tasks write ranges of the order as parts without a header,
    and the file system joins the parts of a variant behind one; no row passes through the driver. Where the store
    cannot join files, the path is a folder that holds the header and the parts, named in order. A file that was there
    gives way once the new one is whole.
    """
    spark, order = rows.sparkSession, ["variant", "session", "turn"]
    jvm, parts = spark._jvm, f"{path}/_parts-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("variant", "session_type", "labels").write.partitionBy("variant").option("emptyValue", "").csv(parts)
    at = jvm.org.apache.hadoop.fs.Path(parts)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for folder in sorted(str(x.getPath()) for x in fs.listStatus(at) if x.isDirectory()):
        name = folder.rpartition("=")[2]
        files = sorted(str(x.getPath()) for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if x.getLen() and x.getPath().getName()[0] not in "._")
        head = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/header"), True)
        head.write(bytearray(b"session_type,labels\n"))
        head.close()
        whole = f"{folder}/whole" if concatenate(spark, [f"{folder}/header", *files], f"{folder}/whole") else folder
        if whole == folder:
            fs.rename(jvm.org.apache.hadoop.fs.Path(f"{folder}/header"), jvm.org.apache.hadoop.fs.Path(f"{folder}/part-0-header"))
        target = f"{path}/submission_{name}.csv"
        fs.delete(jvm.org.apache.hadoop.fs.Path(target), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(whole), jvm.org.apache.hadoop.fs.Path(target))
        out.append(target)
    fs.delete(at, True)
    return out


def write_candidates(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def ledger_rows(runs: DataFrame) -> DataFrame:
    """Rows of the ledger's columns, each fit for one CSV field; a column that runs lacks is empty, and so is the
    score of every pipeline but validation."""
    fields = [(sanitize_field(F.coalesce(F.col(f.name).cast("string"), F.lit(""))) if f.name in runs.columns else F.lit("")).alias(f.name) for f in LEDGER.fields]
    return runs.select(*fields).withColumn("score", F.when(F.col("pipeline") == "validation", F.col("score")).otherwise(F.lit("")))


def append_ledger(runs: DataFrame, path: str) -> None:
    """Adds files to the ledger's folder: runs that end at the same time do not overwrite each other."""
    ledger_rows(runs).write.mode("append").option("header", True).option("emptyValue", "").csv(path)
