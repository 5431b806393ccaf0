"""Token counts as delta-maintained rollups.

Changes come in batches: inserts add a document's counts, deletes take them back, revisions take back the old counts
and add the new ones. All are signed rows of additive totals by source, language and tokenizer version. A batch is
committed once: committing it again, whole or after a failure half-way, changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.shared import sliced
from clickloom.llm.text_ids import encoder
from clickloom.sources.shared import claim

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, vocabulary: str, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens, n_chars) for every row of docs.

    vocabulary: a tokenizers file that every executor can read. A null or empty text has no token; a missing source
    or lang column counts as null, and null is a group of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in sliced(batches):
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64()), batch.column("n_chars")], names=["doc_id", "source", "lang", "n_tokens", "n_chars"])

    group = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")]
    text = F.make_valid_utf8(F.col(text_col))
    n_chars = F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *group, n_chars, text.alias("text"))
    counted = own.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_chars long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_chars")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as changes: sign 1 inserts documents, -1 deletes them."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), *[(F.col(c) * sign).alias(c) for c in TOTALS[1:]])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts of documents, also where source, language or version differ."""
    return signed(old, -1).unionByName(signed(new, 1))


def add_up(changes: DataFrame) -> DataFrame:
    """Totals by key, summed before the shuffle; groups that come to nothing go."""
    return changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).where(" OR ".join(f"{c} <> 0" for c in TOTALS))


def digest(changes: DataFrame) -> str:
    """The same for equal rows in any order."""
    n, total = changes.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, *TOTALS).cast("decimal(38,0)"))).first()
    return f"{n}.{total or 0}"


class Rollup:
    """Totals under a folder that driver and executors share.

    data/ holds each batch, summed by key; commits/ a claim for each committed batch, which tells where its data
    lie and their digest; bases/ totals with the names and digests of the batches in them. Totals are the newest base
    and the few batches behind it, so that reading them costs the same however many batches there have been.

    A batch counts from the moment its claim is there, which is written elsewhere and moved into place whole (claim), so
    that of two committers of one batch one wins, and the other finds it done. No claim is deleted before a base that
    has the batch is followed by another. Whatever a crash leaves behind (data without a claim, a claim that was not
    moved into place, a base without its success mark) does not count.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 8):
        self.spark, self.folder, self.compact_every = spark, folder, compact_every

    def _at(self, path: str):
        """A path as Hadoop has it, and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def _base(self) -> str | None:
        """The newest complete base."""
        at, fs = self._at("bases")
        found = sorted((x.getPath().getName() for x in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for name in found:
            mark, fs = self._at(f"bases/{name}/_SUCCESS")
            if fs.exists(mark):
                return name
        return None

    def _read_base(self, base: str | None) -> DataFrame:
        """Totals (batch null), and a row for each batch in them."""
        schema = f"{SCHEMA}, batch string, digest string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/bases/{base}") if base else self.spark.createDataFrame([], schema)

    def _commits(self) -> dict[str, tuple[str, str]]:
        """(data, digest) of batches with a commit file: those since the base before last."""
        at, fs = self._at("commits")
        names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []
        if not (paths := [f"{self.folder}/commits/{x}/claim" for x in names if x[0] != "_"]):
            return {}
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        rows = self.spark.read.text(paths, wholetext=True).select(name.alias("batch"), F.split(F.substring_index("value", "\n", -1), " ").alias("x"))
        return {r["batch"]: tuple(r["x"]) for r in rows.collect()}

    def _in_base(self, batch: str) -> str | None:
        row = self._read_base(self._base()).where(F.col("batch") == batch).select("digest").first()
        return row and row["digest"]

    def _known(self, batch: str) -> str | None:
        """The digest with which a batch was committed."""
        if found := self._in_base(batch):  # before a claim, which a late one may have made since
            return found
        return self._commits().get(batch, (None, None))[1]

    def _claim(self, batch: str, data: str, own: str) -> bool:
        """Whether this is the one that commits a batch. A base may have it by now, and its claim be gone."""
        at, fs = self._at(f"commits/{batch}")
        if fs.exists(at) and fs.getFileStatus(at).isFile():
            fs.delete(at, False)  # no claim, which is a folder; of a folder that holds something this call deletes nothing
        return claim(self.spark, f"{self.folder}/commits/{batch}", f"{data} {own}") and self._in_base(batch) is None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new. One that is committed already changes nothing; with other rows it is an error."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"no batch name: {batch!r}")
        summed = add_up(changes)
        known = self._known(batch)
        if known is None:
            data = uuid.uuid4().hex
            summed.write.parquet(f"{self.folder}/data/{data}")
            own = digest(self._read([data]))
            if self._claim(batch, data, own):
                if len(self.pending()) >= self.compact_every:
                    self.compact()
                return True
            known = self._known(batch)
            self._delete(f"data/{data}")
        else:
            own = digest(summed)
        if known != own:
            raise ValueError(f"batch {batch!r} was committed with other rows")
        return False

    def _read(self, data: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/data/{x}" for x in data]) if data else self.spark.createDataFrame([], SCHEMA)

    def _state(self) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
        """The newest base, and the batches that it lacks."""
        base = self._read_base(self._base())
        commits = self._commits()
        inside = {r["batch"] for r in base.where(F.col("batch").isin(*commits)).select("batch").collect()} if commits else set()
        return base, {k: v for k, v in commits.items() if k not in inside}

    def pending(self) -> list[str]:
        """Committed batches that are in no base yet, by name."""
        return sorted(self._state()[1])

    def names(self) -> DataFrame:
        """(batch) of all committed batches."""
        base, more = self._state()
        return base.where("batch IS NOT NULL").select("batch").unionByName(self.spark.createDataFrame([(x,) for x in more], "batch string"))

    def totals(self) -> DataFrame:
        """Totals of all committed batches by source, language and tokenizer version."""
        base, more = self._state()
        return add_up(base.where("batch IS NULL").select(*KEYS, *TOTALS).unionByName(self._read([data for data, _ in more.values()])))

    def compact(self) -> None:
        """Write a base with all committed batches. Commit files and data that the base before had stay until now, so
        that a reader which began with it can end."""
        last = self._base()
        base, more = self._state()
        old = {r["batch"] for r in base.where("batch IS NOT NULL").join(self.spark.createDataFrame([(x,) for x in self._commits()], "batch string"), "batch", "left_semi").select("batch").collect()}
        rows = self.spark.createDataFrame([(k, v[1]) for k, v in more.items()], "batch string, digest string")
        every = base.where("batch IS NOT NULL").select("batch", "digest").unionByName(rows)
        number = int(last.partition("-")[0]) + 1 if last else 1
        name = f"{number:09d}-{uuid.uuid4().hex}"
        self.totals().unionByName(every, allowMissingColumns=True).write.parquet(f"{self.folder}/bases/{name}")
        for batch, (data, _) in self._commits().items():
            if batch in old:
                self._delete(f"commits/{batch}")
                self._delete(f"data/{data}")
