"""One row per event fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns outside the fingerprint may differ between copies; ordering by all of
# them makes the survivor the same at any partitioning.
TIE_BREAK = ["src_port", "dst_port", "pass_len", "command", "file_hash", "raw_json"]


def dedup_events(events: DataFrame) -> DataFrame:
    """The earliest row per ``event_hash``.

    ``row_number() = 1`` is applied per input partition before the shuffle
    (window group limit), so each task ships one row of a much-copied event.
    """
    ties = [F.col(c).asc_nulls_last() for c in TIE_BREAK]
    order = Window.partitionBy("event_hash").orderBy(F.col("ts_utc").asc_nulls_last(), *ties)
    return events.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Both sensors' events as one table; the order of the inputs does not matter."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def only_new(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Events whose fingerprint is not stored yet, for re-runs over the same logs."""
    return events.join(existing.select("event_hash"), "event_hash", "left_anti").select(*events.columns)
