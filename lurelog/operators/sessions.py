"""Per-session summary of the interactive sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.operators import skew


def session_events(events: DataFrame) -> DataFrame:
    return events.filter((F.col("source") == "cowrie") & F.col("session_id").isNotNull())


def session_items(events: DataFrame) -> DataFrame:
    """Commands and download URLs of all sessions in order, one row each, nothing left out.

    ``position`` counts from 0 in each session.
    """
    return skew.with_position(item_rows(events), ["session_id"], ["ts_utc", "event_hash"], "position")


def is_item() -> Column:
    """Whether an event is a command or a download with its text."""
    command = (F.col("event_type") == "command") & F.col("command").isNotNull()
    return command | ((F.col("event_type") == "download") & F.col("url").isNotNull())


def item_rows(events: DataFrame) -> DataFrame:
    """The items of all sessions, not numbered yet."""
    command = F.when(F.col("event_type") == "command", F.col("command"))
    url = F.when(F.col("event_type") == "download", F.col("url"))
    return session_events(events).filter(is_item()).select("session_id", "ts_utc", "event_hash", command.alias("command"), url.alias("url"))


def session_chunks(items: DataFrame, size: int) -> DataFrame:
    """``commands_seq`` and ``download_urls`` in chunks of ``size`` items of a session.

    A list is NULL where its chunk has no entry of the kind.
    """
    numbered = items.withColumn("chunk", F.floor(F.col("position") / size))
    return numbered.groupBy("session_id", "chunk").agg(
        _ordered_list("command").alias("commands_seq"), _ordered_list("url").alias("download_urls")
    )


def build_sessions(events: DataFrame) -> DataFrame:
    """One row per session: span, address, success flag and counts.

    Everything here combines on the map side; the commands and downloads
    themselves are rows of ``session_items``.
    """
    kind = F.col("event_type")
    at = F.struct("ts_utc", "event_hash")
    address = F.when(F.col("src_ip_hash").isNotNull(), F.struct("src_ip_hash", "src_ip_masked"))
    scalars = (
        session_events(events)
        .groupBy("session_id")
        .agg(
            F.min("ts_utc").alias("start_ts_utc"),
            F.max("ts_utc").alias("end_ts_utc"),
            F.min_by(address, F.when(address.isNotNull(), at)).alias("address"),
            F.bool_or(F.coalesce(kind == "login_success", F.lit(False))).alias("has_success"),
            F.count_if(kind == "command").alias("num_commands"),
            F.count_if(kind == "download").alias("num_downloads"),
        )
    )
    return finished(scalars)


def finished(scalars: DataFrame) -> DataFrame:
    """Sessions in their canonical columns, from times, ``address`` and counts."""
    span = F.unix_timestamp("end_ts_utc") - F.unix_timestamp("start_ts_utc")
    return scalars.withColumns(
        {
            "duration_s": span,
            "src_ip_hash": F.col("address.src_ip_hash"),
            "src_ip_masked": F.col("address.src_ip_masked"),
        }
    ).select(*schema.SESSIONS.names)


def _ordered_list(column: str) -> Column:
    """Non-NULL values in order; NULL, not an empty list, when there are none."""
    entry = F.when(F.col(column).isNotNull(), F.struct("position", column))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e[column])
    return F.when(F.size(ordered) > 0, ordered)
