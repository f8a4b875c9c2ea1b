"""Curated tables that grow by batches: only the days a batch touches are read and written again.

Under one root, each partitioned by ``event_date``:

``events``         deduplicated events (by ``source`` as well); a fingerprint holds the time, so
                   copies of an event are in one day
``session_days``   partial sums of every session and day, which merge into sessions
``item_days``      commands and downloads with their position in session and day
``login_days``     first and last login of every address, service and day
``ip_windows``     login windows, whose first gap of a day comes from the last login before it

Days are replaced by dynamic partition overwrite, never from rows of the table
that is replaced (only these are staged first), and ``login_days`` last.  So a run that dies anywhere is repaired by running the
batch again, and a batch that comes twice changes nothing.  A batch may hold
events of any day: where the last login of a day changes, the next day with a
login of that address is computed again too.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.functions.times import window_start
from lurelog.operators import ip_windows as windows_of, sessions as sessions_of, skew
from lurelog.operators.dedup import dedup_events, union_sources
from lurelog.sinks.tables import replace_days
from lurelog.sources.tables import _exists
from lurelog.staging import staged

LOGIN_KEY = windows_of.GAP_KEY


def _stored(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    table = spark.read.parquet(path)
    return table if days is None else table.where(F.col("event_date").isin(days))


def _days(df: DataFrame) -> list[date]:
    """The days of a batch, one value each."""
    return sorted(r.event_date for r in df.select("event_date").distinct().collect())


def _session_days(events: DataFrame) -> DataFrame:
    """Partial sums of a session and day; every column merges by minimum, maximum, sum or or."""
    kind = F.col("event_type")
    address = F.when(F.col("src_ip_hash").isNotNull(), F.struct("ts_utc", "event_hash", "src_ip_hash", "src_ip_masked"))
    return sessions_of.session_events(events).groupBy("session_id", "event_date").agg(
        F.min("ts_utc").alias("start_ts_utc"), F.max("ts_utc").alias("end_ts_utc"), F.min(address).alias("address"),
        F.bool_or(F.coalesce(kind == "login_success", F.lit(False))).alias("has_success"),
        F.count_if(kind == "command").alias("num_commands"), F.count_if(kind == "download").alias("num_downloads"),
        F.count_if(sessions_of.is_item()).alias("num_items"),
    )


def _login_days(logins: DataFrame) -> DataFrame:
    return logins.groupBy(*LOGIN_KEY, "event_date").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))


def _logins(events: DataFrame) -> DataFrame:
    return windows_of.login_events(events).withColumn("event_date", F.to_date("ts_utc"))


def _days_to_count(known: DataFrame, fresh: DataFrame, old: DataFrame | None) -> list[date]:
    """The touched days, and of every key whose last login of a day changed the next day it logs in."""
    if old is None:
        return _days(fresh)
    was = old.select(*LOGIN_KEY, "event_date", F.col("last_ts").alias("was"))
    changed = fresh.join(was, [*LOGIN_KEY, "event_date"], "left").where(~F.col("last_ts").eqNullSafe(F.col("was"))).select(*LOGIN_KEY, "event_date")
    later = known.select(*LOGIN_KEY, F.col("event_date").alias("later"))
    following = changed.join(later, LOGIN_KEY).where("later > event_date").groupBy(*LOGIN_KEY, "event_date").agg(F.min("later").alias("later"))
    return _days(fresh.select("event_date").union(following.select("later")).distinct())


def _windows(logins: DataFrame, known: DataFrame, days: list[date], minutes: int) -> DataFrame:
    """Windows of ``days``; ``known`` has the login days of all history."""
    linked = skew.with_previous(logins, [*LOGIN_KEY, "event_date"], ["ts_utc", "source"], "ts_utc", "previous_ts")
    before = Window.partitionBy(*LOGIN_KEY).orderBy("event_date")
    # One row an address and day; days come in order, so the row before holds the last login before the day.
    carried = known.select(*LOGIN_KEY, "event_date", F.lag("last_ts").over(before).alias("carried_ts")).where(F.col("event_date").isin(days))
    joined = linked.join(staged(carried.where("carried_ts IS NOT NULL"), "carried-logins"), [*LOGIN_KEY, "event_date"], "left")
    gap = F.unix_micros("ts_utc") - F.unix_micros(F.coalesce("previous_ts", "carried_ts"))
    counted = joined.withColumns({"gap_us": gap, "window_start": F.expr(window_start("ts_utc", minutes))})
    return windows_of.count_windows(counted).withColumn("event_date", F.to_date("window_start"))


def curate_batch(spark: SparkSession, new_events: DataFrame, root: str, *, minutes: int = 5) -> list[date]:
    """Bring the tables under ``root`` up to date with ``new_events``; returns the days whose windows were written.

    ``minutes`` divides a day, so that no window crosses midnight, and stays the
    same for all batches.
    """
    if 1440 % minutes:
        raise ValueError(f"windows of {minutes} minutes cross midnight")
    batch = staged(new_events.select(*schema.EVENTS.names).withColumn("event_date", F.to_date("ts_utc")), "batch-events")
    days = _days(batch)
    if not days:
        return []
    stored = _stored(spark, f"{root}/events", days)
    merged = batch if stored is None else union_sources(batch, stored.select(*batch.columns))
    touched = staged(dedup_events(merged), "batch-merged")
    replace_days(touched, f"{root}/events", ["source", "event_date"])
    replace_days(_session_days(touched), f"{root}/session_days")
    items = sessions_of.item_rows(touched).withColumn("event_date", F.to_date("ts_utc"))
    placed = skew.with_position(items, ["session_id", "event_date"], ["ts_utc", "event_hash"], "day_position")
    replace_days(placed, f"{root}/item_days")
    fresh = staged(_login_days(_logins(touched)), "login-days")
    history = _stored(spark, f"{root}/login_days")
    known = fresh
    if history is not None:
        known = staged(history.where(~F.col("event_date").isin(days)).select(*fresh.columns).unionByName(fresh), "login-history")
    counted = _days_to_count(known, fresh, None if history is None else history.where(F.col("event_date").isin(days)))
    if counted:
        logins = _logins(spark.read.parquet(f"{root}/events").where(F.col("event_date").isin(counted)))
        replace_days(_windows(logins, known, counted, minutes), f"{root}/ip_windows")
        replace_days(fresh, f"{root}/login_days")
    return counted


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """One row a session, merged from its days."""
    merged = spark.read.parquet(f"{root}/session_days").groupBy("session_id").agg(
        F.min("start_ts_utc").alias("start_ts_utc"), F.max("end_ts_utc").alias("end_ts_utc"), F.min("address").alias("address"),
        F.bool_or("has_success").alias("has_success"), F.sum("num_commands").alias("num_commands"), F.sum("num_downloads").alias("num_downloads"),
    )
    return sessions_of.finished(merged)


def read_session_items(spark: SparkSession, root: str) -> DataFrame:
    """Commands and downloads with their position in the whole session."""
    earlier = Window.partitionBy("session_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    begins = spark.read.parquet(f"{root}/session_days").select("session_id", "event_date", F.coalesce(F.sum("num_items").over(earlier), F.lit(0)).alias("begin"))
    items = spark.read.parquet(f"{root}/item_days").join(begins, ["session_id", "event_date"])
    return items.withColumn("position", F.col("begin") + F.col("day_position")).drop("begin", "day_position", "event_date")


def read_ip_windows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/ip_windows").select(*schema.WINDOWS.names)
