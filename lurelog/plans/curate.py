"""``events_raw`` to the curated tables and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelog.operators import report
from lurelog.operators.dedup import dedup_events
from lurelog.operators.ip_windows import build_ip_windows
from lurelog.operators.sessions import build_sessions, session_items
from lurelog.sinks import files, tables


def curate(
    spark: SparkSession, events_path: str, curated: str, lost: DataFrame, *, minutes: int = 5
) -> dict[str, DataFrame]:
    """Write ``events``, ``sessions``, ``session_items``, ``ip_windows`` and the report under ``curated``.

    Sessions and windows are built from the written, deduplicated table, so the
    wide shuffle by fingerprint happens once.  ``lost`` counts rejected lines as
    ``source, reason, n``, which ``ingest_logs`` returns.
    """
    raw = tables.read_events(spark, events_path)
    paths = {
        "events": f"{curated}/events/events_clean.parquet",
        "sessions": f"{curated}/sessions/cowrie_sessions.parquet",
        "session_items": f"{curated}/sessions/session_items.parquet",
        "ip_windows": f"{curated}/ip_windows/ip_windows_5m.parquet",
    }
    tables.write_events(dedup_events(raw), paths["events"])
    events = tables.read_events(spark, paths["events"])
    tables.write_table(build_sessions(events), paths["sessions"])
    tables.write_table(session_items(events), paths["session_items"])
    tables.write_table(build_ip_windows(events, minutes), paths["ip_windows"])
    built = {name: spark.read.parquet(path) for name, path in paths.items()} | {"events": events}
    document = report.quality_report(
        raw, events, built["sessions"], built["ip_windows"], lost
    )
    files.write_json_document(document, f"{curated}/reports/cleaning_report")
    return built
