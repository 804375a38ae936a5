"""How long conversations are kept, and which are quiet enough for a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY_MS, QUIET_MS, SUMMARIES, SUMMARY_SHOWN
from .filters import epoch_ms, harness_of


def cutoff_ms(now_ms: int, days: float) -> int | None:
    """The earliest last activity that is kept; None keeps all."""
    return int(now_ms - days * DAY_MS) if days > 0 else None


def conversations(exchanges: DataFrame) -> DataFrame:
    """archive_path, ids, harness and project of the first row, newest_ms."""
    return exchanges.groupBy("archive_path").agg(
        F.array_sort(F.collect_list("id")).alias("ids"),
        F.min_by(harness_of(), "id").alias("harness"),
        F.min_by("project", "id").alias("project"),
        F.max(epoch_ms(F.col("timestamp"))).alias("newest_ms"),
    )


def expired(talks: DataFrame, files: DataFrame, cutoff: int | None) -> DataFrame:
    """Conversations whose last activity is before the cutoff.

    ``files``: archive_path, copy_mtime_ms, source_mtime_ms (null where there is no such file).  The copy's time counts,
    else the source's, else the newest timestamp.
    """
    known = talks.join(files, "archive_path", "left")
    last = F.coalesce("copy_mtime_ms", "source_mtime_ms", "newest_ms")
    return known.withColumn("last_ms", last).filter(F.lit(False) if cutoff is None else F.col("last_ms") < cutoff)


def expired_ids(gone: DataFrame) -> DataFrame:
    return gone.select(F.explode("ids").alias("id"))


def recent_files(files: DataFrame, cutoff: int | None) -> DataFrame:
    """Files worth reading: those not older than the cutoff."""
    return files if cutoff is None else files.filter(F.col("mtime_ms") >= cutoff)


def summary_candidates(talks: DataFrame, states: DataFrame, now_ms: int, limit: int = SUMMARIES, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Quiet conversations without a summary, or with a failed one; the newest first.

    ``talks``: archive_path, source_mtime_ms and more; ``states``: archive_path, kind.
    """
    kind = F.coalesce("kind", F.lit("missing"))
    quiet = F.col("source_mtime_ms") <= now_ms - quiet_ms
    return talks.join(states, "archive_path", "left").filter(quiet & kind.isin("missing", "error")).orderBy(F.desc("source_mtime_ms"), "archive_path").limit(max(0, limit))


def shown_summary(kind: Column, text: Column) -> Column:
    return F.when((kind == "valid") & (F.length(text) < SUMMARY_SHOWN), text)
