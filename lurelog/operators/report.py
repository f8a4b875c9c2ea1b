"""Quality-control numbers of a curated build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_event_types(events: DataFrame, n: int = 30) -> DataFrame:
    counts = events.groupBy("source", "service", "event_type").agg(F.count("*").alias("c"))
    keys = [F.col(k).asc_nulls_last() for k in ("source", "service", "event_type")]
    return counts.orderBy(F.desc("c"), *keys).limit(n)


def event_facts(events: DataFrame) -> DataFrame:
    """Count, time range and missing values in one pass; missing counts are NULL when empty."""

    def missing(column: str):
        return F.sum(F.when(F.col(column).isNull(), 1).otherwise(0))

    return events.agg(
        F.count("*").alias("events_dedup"),
        F.min("ts_utc").alias("min_ts_utc"),
        F.max("ts_utc").alias("max_ts_utc"),
        missing("src_ip_hash").alias("src_ip_hash_null"),
        missing("ts_utc").alias("ts_null"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """``table_name, n``: one counting aggregate per table."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def reject_counts(lost: DataFrame) -> DataFrame:
    """``source, bad_json, bad_ts, other`` for every sensor, from ``source, reason, n``.

    Lines that are no JSON object count as ``other``; a sensor without rejects has zeros.
    """
    sensors = lost.sparkSession.createDataFrame([("cowrie",), ("opencanary",)], "source string")
    every = sensors.join(lost, "source", "left")

    def total(wanted: Column) -> Column:
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).cast("bigint")

    return every.groupBy("source").agg(
        F.lit(0).cast("bigint").alias("bad_json"),
        total(F.col("reason") == "bad_ts").alias("bad_ts"),
        total(F.col("reason") != "bad_ts").alias("other"),
    )


def quality_report(
    events_raw: DataFrame, events: DataFrame, sessions: DataFrame, windows: DataFrame,
    lost: DataFrame,
) -> DataFrame:
    """The whole report as one row ``report`` of JSON text; every input is aggregated on Spark."""
    counts = table_counts(
        events_raw=events_raw, cowrie_sessions=sessions, ip_windows_5m=windows
    ).collect()
    facts = event_facts(events).first()
    kinds = top_event_types(events).collect()
    lost = reject_counts(lost).orderBy("source").collect()
    numbers = {r["table_name"]: r["n"] for r in counts}

    def text(value):
        return F.lit(None if value is None else str(value)).cast("string")

    report = F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("generated_at_utc"),
        F.struct(
            F.lit(numbers["events_raw"]).alias("events_raw"),
            F.lit(facts["events_dedup"]).alias("events_dedup"),
            F.lit(numbers["cowrie_sessions"]).alias("cowrie_sessions"),
            F.lit(numbers["ip_windows_5m"]).alias("ip_windows_5m"),
        ).alias("counts"),
        F.struct(
            text(facts["min_ts_utc"]).alias("min_ts_utc"), text(facts["max_ts_utc"]).alias("max_ts_utc")
        ).alias("time_range"),
        F.array(
            *[
                F.struct(*[F.lit(r[c]).alias(c) for c in ("source", "service", "event_type", "c")])
                for r in kinds
            ]
        ).alias("top_event_types"),
        F.struct(
            F.lit(facts["src_ip_hash_null"]).cast("bigint").alias("src_ip_hash_null"),
            F.lit(facts["ts_null"]).cast("bigint").alias("ts_null"),
        ).alias("null_rates"),
        F.array(
            *[
                F.struct(*[F.lit(r[c]).alias(c) for c in ("source", "bad_json", "bad_ts", "other")])
                for r in lost
            ]
        ).alias("rejects"),
    )
    one_row = events.sparkSession.range(1)
    return one_row.select(F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
