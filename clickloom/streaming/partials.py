"""Co-visitation scores kept up to date from a stream of event files.

Each micro-batch is scored by itself and stored as a partial table; partials add up to the scores of the whole log as
long as a session's events come in one batch, as when closed sessions are delivered as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.covisit import merge_scores
from clickloom.operators.sweep import direct_scores
from clickloom.schema import EVENTS, SCORES, Variant


def store_partial(events: DataFrame, batch_id: int, variant: Variant, out: str) -> None:
    """The scores of one batch under its own name, so that a batch that is run again replaces itself."""
    direct_scores(events, variant).write.mode("overwrite").parquet(f"{out}/partials/batch={batch_id}")


def stream_partials(spark: SparkSession, events_path: str, variant: Variant, out: str, checkpoint: str, max_files: int = 64) -> StreamingQuery:
    """Score the event files that are in a folder by now, max_files in a batch, and stop; the next call goes on.

    Variants of recent events alone need the whole log's latest time, which a batch does not know: an error.
    """
    if variant.recent:
        raise ValueError(f"{variant.name} wants recent events alone, which batches cannot tell")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(events_path)
    return (
        events.writeStream.foreachBatch(lambda df, n: store_partial(df, n, variant, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged(spark: SparkSession, out: str) -> DataFrame:
    """Scores over all batches so far."""
    return merge_scores(spark.read.schema(SCORES).parquet(f"{out}/partials"))
