"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder in the cluster's shared one, which spark.checkpoint.dir names; it may be removed once
    the session has ended.

    Where the session names none, one is made on a single machine, as in tests; on a cluster that is an error, as
    executors would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """The path of a new folder in it."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, at):
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Whether path was free and now holds text, for good: of several who claim one path, one gets True.

    The text is written under another name and moved into place as a folder, which a file system with atomic renames
    does for one of them alone: a folder that is moved to one that exists by then comes to lie inside it, or fails, and
    changes nothing of what it holds. Nothing is ever deleted that another may have claimed. claimed() reads it back.
    """
    jvm = spark._jvm
    mark = uuid.uuid4().hex
    own = f"{path.rpartition('/')[0]}/_{mark}"  # Spark's readers pass over such names
    source, target = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
    fs = _file_system(spark, target)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{own}/claim"), False)
    out.write(bytearray(f"{mark}\n{text}".encode()))
    out.close()
    if not fs.exists(target):
        try:
            fs.rename(source, target)
        except Py4JJavaError:
            pass  # the other one was faster; what stands there tells
    won = _read(spark, path).partition("\n")[0] == mark
    if not won:
        remove(spark, own)
    return won


def _read(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claim")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def claimed(spark: SparkSession, path: str) -> str | None:
    """The text that was claimed for a path, or nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claim")
    return _read(spark, path).partition("\n")[2] if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def concatenate(spark: SparkSession, parts: list[str], target: str) -> bool:
    """Make one file of parts, in their order and in their folder, by the file system itself; False where it has no way.

    Bytes are not read by the driver's Python, nor parsed: a store that can joins the files' blocks.
    """
    jvm = spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(x) for x in [target, *parts]]
    fs = _file_system(spark, paths[0])
    if fs.getScheme() == "file":  # its checksums are for whole files; below them there is a way, which makes the target
        fs, first = fs.getRawFileSystem(), 1
    else:
        fs.rename(paths[1], paths[0])
        first = 2
    if len(paths) == first:
        return True
    rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths) - first)
    for k, x in enumerate(paths[first:]):
        rest[k] = x
    try:
        fs.concat(paths[0], rest)
    except Py4JJavaError as e:
        if "UnsupportedOperationException" not in str(e.java_exception):
            raise
        if first == 2:
            fs.rename(paths[0], paths[1])
        return False
    return True
