"""Incremental change of a file table and of what depends on it, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_files(current: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Files after a change: ``changed`` replaces rows of the same path, ``removed`` (``path``) go.

    Of several changes of one path the latest by ``scanned_at`` counts.
    """
    latest = changed.groupBy("path").agg(F.max_by(F.struct(*changed.columns), F.col("scanned_at")).alias("r")).select("r.*")
    kept = current.join(latest.select("path"), "path", "left_anti")
    out = kept.unionByName(latest)
    return out if removed is None else out.join(removed.select("path").distinct(), "path", "left_anti")


def really_changed(current: DataFrame, changed: DataFrame) -> DataFrame:
    """Changes whose content differs from what is there; the others are no work."""
    same = current.select("path", F.xxhash64("content").alias("h"))
    return changed.join(same, "path", "left").where("h IS NULL OR h <> xxhash64(content)").drop("h")


def follow(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``apply`` on each micro-batch of changed files, exactly once per batch by its number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, key: str, time: str = "ingested_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes per key and window of event time, late ones up to the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
