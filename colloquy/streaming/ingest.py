"""Ingest and expiry as streams.

A file stream takes a path once, so it fits folders in which finished transcripts are dropped; for files that grow, the
batch sync and its cursors are the way.  Batches go through the same cursor insert, so a replayed batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import fold_a, fold_b
from ..operators.store import Store
from ..sources import transcripts

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def sync_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, now: str) -> StreamingQuery:
    """Reads dropped transcripts that are new since the last run, then ends."""
    # A batch looks at its files again by a job, which by default has a task for each file; a copy of the session says otherwise.
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(LISTING, str(2 * spark.sparkContext.defaultParallelism))
    files = own.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").schema("value string").load(folder)
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, _: int) -> None:
        first, second = transcripts.lines_by_format(df)
        store.insert(fold_a(first, now).unionByName(fold_b(second, now)))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(events: DataFrame, key: str, at: str, days: int, late: str = "1 day") -> DataFrame:
    """Each key's last activity by windows of ``days``, of a stream; windows close behind the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, f"{days} days"), key).agg(F.max(at).alias("last"), F.count("*").alias("n"))
