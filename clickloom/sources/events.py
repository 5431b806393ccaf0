"""Reading event logs, predictions and labels."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructType

from clickloom.functions.columns import known_type
from clickloom.schema import EVENTS

#: Footers that are read at a time.
_FOOTERS = 16
_CUT_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; by Spark's file systems, so that any store works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def event_paths(spark: SparkSession, path: str, max_shards: int | None = None) -> list[str]:
    """The shards of an input: a single file is itself; else train_parquet then test_parquet; only where both are
    empty, the Parquet files of the folder. None at all is an error. max_shards keeps the first ones, one at least."""
    if path.endswith(".parquet"):
        found = _glob(spark, path)
    else:
        found = _glob(spark, f"{path}/train_parquet/*.parquet") + _glob(spark, f"{path}/test_parquet/*.parquet")
        found = found or _glob(spark, f"{path}/*.parquet")
    if not found:
        raise FileNotFoundError(f"no Parquet files under {path}")
    return found if max_shards is None else found[: max(1, max_shards)]


def _files(spark: SparkSession, shard: str) -> list:
    """The status of each data file of a shard, which is a file or a folder of parts, in the order of their paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shard)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        found.append(files.next())
    return sorted((x for x in found if x.getPath().getName()[0] not in "._"), key=lambda x: x.getPath().toString())


def _digest(files: list) -> str:
    """Of the paths, sizes and times of files."""
    told = "".join(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}\n" for x in files)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def shard_fingerprints(spark: SparkSession, path: str, max_shards: int | None = None) -> dict[str, str]:
    """The path of each shard by a digest of its files: their paths, sizes and times."""
    return {_digest(_files(spark, shard)): shard for shard in event_paths(spark, path, max_shards)}


def fingerprint(spark: SparkSession, path: str, max_shards: int | None = None) -> str:
    """A digest of the files of an input. A changed, added or lost file changes it."""
    return hashlib.sha256("".join(shard_fingerprints(spark, path, max_shards)).encode()).hexdigest()[:32]


def _kind(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The Parquet types of a file's event columns, from its footer; a column that it lacks is an error."""
    parquet = spark._jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration()))
    try:
        schema = reader.getFileMetaData().getSchema()
        if missing := [c for c in EVENTS.names if not schema.containsField(c)]:
            raise ValueError(f"no column {', '.join(missing)} in {file}")
        return tuple(schema.getType(c).toString().partition(" ")[2] for c in EVENTS.names)
    finally:
        reader.close()


def _by_kind(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files of shards, those of equal column types together, in the order in which such types come first."""
    files = [x.getPath().toString() for shard in paths for x in _files(spark, shard)]
    kinds: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(_FOOTERS) as pool:
        for file, kind in zip(files, pool.map(lambda f: _kind(spark, f), files), strict=True):
            kinds.setdefault(kind, []).append(file)
    return list(kinds.values())


def _scan(spark: SparkSession, files: list[str]) -> DataFrame:
    """The event columns of files of one kind, as they are stored; other columns are not read."""
    own = spark.read.parquet(files[0]).schema
    return spark.read.schema(StructType([own[c] for c in EVENTS.names])).parquet(*files)


def read_events(spark: SparkSession, path: str, max_shards: int | None = None, type_codes: bool | None = None, shard_col: str | None = None, place_col: str | None = None) -> DataFrame:
    """Events of all shards: session, aid, ts as long, type as its name; only these columns are read.

    Each file may have integers of any width, and types as names or as codes 0, 1, 2, which become names; any other
    code stays as text, and is an unknown type to whoever validates types. Files are grouped by the column types in
    their footers, and each group is one scan. With type_codes, a shard of the other kind is an error.

    shard_col adds the path of each row's file, for operators that must not pair across files. place_col adds a row's
    place in the input, train before test, then by file and row, to order events of one time as the files have them.
    """
    parts = []
    for files in _by_kind(spark, event_paths(spark, path, max_shards)):
        rows = _scan(spark, files)
        kind = rows.schema["type"].dataType
        if type_codes is not None and type_codes != isinstance(kind, IntegralType):
            raise ValueError(f"types are {kind.simpleString()} in {files[0]}")
        name = F.col("type") if isinstance(kind, StringType) else F.coalesce(known_type(F.col("type"), kind), F.col("type").cast("string"))
        within = F.regexp_extract("_metadata.file_path", "/(train_parquet|test_parquet)/(.*)$", 2)
        later = F.when(F.col("_metadata.file_path").contains("/test_parquet/"), 1).otherwise(0)
        place = F.struct(later.alias("folder"), F.when(within == "", F.col("_metadata.file_path")).otherwise(within).alias("file"), F.col("_metadata.row_index").alias("row"))
        more = ([F.col("_metadata.file_path").alias(shard_col)] if shard_col else []) + ([place.alias(place_col)] if place_col else [])
        parts.append(rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("session", "aid", "ts")], name.alias("type"), *more))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EVENTS)


def latest_time(spark: SparkSession, path: str) -> int | None:
    """The latest time of all rows of an input, from the footers of its files where they tell, else from a scan.

    Footers are asked through Spark's second file source, which answers MAX from column statistics; a session of its
    own has the settings for that, so that the caller's stay as they are.
    """
    paths = event_paths(spark, path)
    try:
        found = [r["latest"] for part in _latest(spark, paths) for r in part.collect()]
    except Exception:  # files without statistics, or a column type that is not pushed down
        found = [r["latest"] for files in _by_kind(spark, paths) for r in _scan(spark, files).agg(F.max("ts").alias("latest")).collect()]
    return max((int(x) for x in found if x is not None), default=None)


def _latest(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """(latest), one row for each kind of file, planned to read footers alone."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return [_scan(own, files).agg(F.max("ts").alias("latest")) for files in _by_kind(spark, paths)]


def read_table(spark: SparkSession, path: str, place_col: str | None = None) -> DataFrame:
    """Predictions or labels, Parquet or CSV by suffix; every CSV column is a string. Another suffix is an error.

    place_col adds a row's place in the table: its file, where its split begins there, and how many rows come before.
    """
    if path.endswith(".parquet"):
        rows, within = spark.read.parquet(path), F.col("_metadata.row_index")
    elif path.endswith(".csv"):
        # no inference: all columns are strings. A task's rows are numbered as it reads them, split by split
        rows, within = spark.read.option("header", True).csv(path), F.monotonically_increasing_id()
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    if not place_col:
        return rows
    begin = F.lit(0).cast("bigint") if path.endswith(".parquet") else F.col("_metadata.file_block_start")
    return rows.withColumn(place_col, F.struct(F.col("_metadata.file_path").alias("file"), begin.alias("split"), within.alias("row")))


def events_as_sessions(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The user event stream as sessions: a user is a session, props.k the item; view and click are clicks, signup is
    a cart, purchase an order; other event types are dropped. Columns in keep stay."""
    kind = F.when(F.col("event_type").isin("view", "click"), "clicks").when(F.col("event_type") == "signup", "carts").when(F.col("event_type") == "purchase", "orders")
    return events.select(
        F.col("user_id").cast("bigint").alias("session"),
        F.get_json_object("props", "$.k").cast("bigint").alias("aid"),
        F.expr(f"timestampdiff(MILLISECOND, {_CUT_EPOCH}, ts)").alias("ts"),
        kind.alias("type"),
        *keep,
    ).where("type IS NOT NULL")


def orders_as_sessions(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Order lines as sessions: a customer is a session, a part an item, the ship date the time; return flags N, R, A
    are clicks, carts, orders."""
    kind = F.when(F.col("l_returnflag") == "N", "clicks").when(F.col("l_returnflag") == "R", "carts").when(F.col("l_returnflag") == "A", "orders")
    lines = lineitem.select("l_orderkey", "l_partkey", "l_shipdate", kind.alias("type"))
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return joined.select(F.col("o_custkey").cast("bigint").alias("session"), F.col("l_partkey").cast("bigint").alias("aid"), (day.cast("bigint") * 86_400_000).alias("ts"), "type")
