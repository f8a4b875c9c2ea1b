"""Login activity per time window, service and address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.functions.times import window_start
from lurelog.operators import skew

GAP_KEY = ["src_ip_hash", "service"]


def login_events(events: DataFrame) -> DataFrame:
    return events.filter(
        F.col("event_type").isin(schema.LOGIN_TYPES) & F.col("src_ip_hash").isNotNull()
    ).select(
        "ts_utc", "source", "service", "event_type", "src_ip_hash", "src_ip_masked",
        "username_hash", "password_hash", "pass_entropy", "event_hash",
    )


def with_gaps(logins: DataFrame) -> DataFrame:
    """Add ``gap_us``: microseconds since the previous login of the same address and service.

    The gap runs across sensors and window borders.
    """
    linked = skew.with_previous(logins, GAP_KEY, ["ts_utc", "source"], "ts_utc", "previous_ts")
    gap = F.unix_micros("ts_utc") - F.unix_micros("previous_ts")
    return linked.withColumn("gap_us", gap).drop("previous_ts")


def build_ip_windows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Attempts, successes, distinct credentials, entropy and gaps per window and address.

    Distinct counts use Spark's two-stage plan rather than collected sets, so a
    window with very many passwords never sits in one task.
    """
    logins = login_events(events).withColumn("window_start", F.expr(window_start("ts_utc", minutes)))
    return count_windows(with_gaps(logins))


def count_windows(gaps: DataFrame) -> DataFrame:
    """The windows of logins with ``window_start`` and ``gap_us``."""
    return (
        gaps.groupBy(*schema.WINDOW_KEY)
        .agg(
            F.min("src_ip_masked").alias("src_ip_masked"),
            F.count("*").alias("attempts"),
            F.count_if(F.col("event_type") == "login_success").alias("success_count"),
            F.count_distinct("username_hash").alias("unique_users"),
            F.count_distinct("password_hash").alias("unique_passwords"),
            F.avg("pass_entropy").alias("pass_entropy_mean"),
            (F.sum("gap_us") / F.count("gap_us") / 1e6).alias("mean_interarrival_s"),
            (F.min("gap_us") / 1e6).alias("min_interarrival_s"),
        )
        .select(*schema.WINDOWS.names)
    )
