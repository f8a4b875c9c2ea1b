"""Canonical table schemas and enumerations.  All names and types here are fixed values."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

EVENTS = StructType([
    StructField("ts_utc", TimestampType()),
    StructField("source", StringType()),
    StructField("service", StringType()),
    StructField("event_type", StringType()),
    StructField("eventid", StringType()),
    StructField("src_ip", StringType()),
    StructField("src_ip_hash", StringType()),
    StructField("src_ip_masked", StringType()),
    StructField("src_port", IntegerType()),
    StructField("dst_port", IntegerType()),
    StructField("session_id", StringType()),
    StructField("username", StringType()),
    StructField("username_hash", StringType()),
    StructField("password", StringType()),
    StructField("password_hash", StringType()),
    StructField("pass_len", IntegerType()),
    StructField("pass_entropy", DoubleType()),
    StructField("command", StringType()),
    StructField("command_truncated", BooleanType()),
    StructField("url", StringType()),
    StructField("filename", StringType()),
    StructField("file_hash", StringType()),
    StructField("raw_json", StringType()),
    StructField("event_hash", StringType()),
])

# Without the two lists, which `SESSION_CHUNKS` holds.
SESSIONS = StructType([
    StructField("session_id", StringType()),
    StructField("start_ts_utc", TimestampType()),
    StructField("end_ts_utc", TimestampType()),
    StructField("duration_s", LongType()),
    StructField("src_ip_hash", StringType()),
    StructField("src_ip_masked", StringType()),
    StructField("has_success", BooleanType()),
    StructField("num_commands", LongType()),
    StructField("num_downloads", LongType()),
])

WINDOWS = StructType([
    StructField("window_start", TimestampType()),
    StructField("source", StringType()),
    StructField("service", StringType()),
    StructField("src_ip_hash", StringType()),
    StructField("src_ip_masked", StringType()),
    StructField("attempts", LongType()),
    StructField("success_count", LongType()),
    StructField("unique_users", LongType()),
    StructField("unique_passwords", LongType()),
    StructField("pass_entropy_mean", DoubleType()),
    StructField("mean_interarrival_s", DoubleType()),
    StructField("min_interarrival_s", DoubleType()),
])

WINDOW_KEY = ["window_start", "source", "service", "src_ip_hash"]
LOGIN_TYPES = ["login_fail", "login_success", "login_attempt"]
LOGIN_FAIL_LIKE = ["login_fail", "login_attempt"]
