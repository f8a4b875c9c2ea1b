"""Logs to ``events_raw`` and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.operators import normalize
from lurelog.operators.dedup import union_sources
from lurelog.sinks import files, tables
from lurelog.sources import logs
from lurelog.staging import staged

SENSORS = {"cowrie": normalize.normalize_cowrie, "opencanary": normalize.normalize_opencanary}
CHOICES = ("both", "cowrie", "opencanary", "none")


def chosen_sensors(ingest: str) -> list[str]:
    if ingest not in CHOICES:
        raise ValueError(f"ingest must be one of {CHOICES}, got {ingest!r}")
    return list(SENSORS) if ingest == "both" else [s for s in SENSORS if s == ingest]


def normalize_sensors(lines: dict[str, DataFrame], ingest: str = "both", **options) -> DataFrame:
    """Normalised rows of the chosen sensors as one frame (rejected lines included)."""
    frames = [SENSORS[s](lines[s], **options) for s in chosen_sensors(ingest)]
    return union_sources(*frames)


def ingest_logs(
    spark: SparkSession, events_path: str, rejects_path: str, *, salt: str,
    cowrie_dir: str | None = None, cowrie_pattern: str = logs.INTERACTIVE_PATTERN, opencanary_path: str | None = None, ingest: str = "both",
    numbered: bool = False, skip_stored: bool = False, keep_secrets: bool = False, redact_free_text: bool, batch: str | None = None,
) -> DataFrame:
    """Read the chosen sensors' logs, write the valid events and the rejects as one batch.

    Lines are parsed and written once; the few rejects are exported from there,
    and the batch's manifest comes last.  A batch is named after its files, their
    sizes and times, unless ``batch`` names it: a run that died, or comes twice,
    replaces itself.  Returns ``source, reason, n`` of the rejected lines.
    ``ingest="none"`` reads no log; ``run`` then curates the stored events again.
    ``skip_stored`` has to know the days of the new events first, so it stages them.
    """
    lines, inputs = {}, []
    for sensor in chosen_sensors(ingest):
        if sensor == "cowrie":
            paths = logs.discover_files(spark, cowrie_dir, cowrie_pattern)
        else:
            paths = [opencanary_path]
        lines[sensor] = logs.read_log_lines(spark, paths, numbered)
        inputs += logs.described(spark, paths)
    if not lines:
        empty = "source STRING, reason STRING, n BIGINT"
        return spark.createDataFrame([], empty)
    options = {"salt": salt, "keep_secrets": keep_secrets, "redact_free_text": redact_free_text}
    parsed = normalize_sensors(lines, ingest, **options)
    batch = batch or tables.batch_name(inputs)
    if skip_stored:
        parsed = staged(parsed, "normalized")
        fresh = tables.without_stored(parsed.filter(F.col("reject_reason").isNull()), events_path, batch)
        parsed = fresh.unionByName(parsed.filter(F.col("reject_reason").isNotNull()))
    written = tables.write_batch(parsed, events_path, batch)
    bad = written.filter(F.col("outcome") == tables.REJECT)
    for sensor in lines:
        files.write_rejects(normalize.rejects(bad.filter(F.col("source") == sensor)), f"{rejects_path}/{sensor}_rejects/batch={batch}")
    counts = tables.commit_batch(written, events_path, batch)
    return counts.where(F.col("outcome") == tables.REJECT).select("source", "reason", "n")


def run(spark: SparkSession, events_path: str, rejects_path: str, curated: str, *, minutes: int = 5, **options) -> dict[str, DataFrame]:
    """Ingest and curate in one call; ``ingest="none"`` rebuilds the curated tables from the stored events."""
    from lurelog.plans.curate import curate

    lost = ingest_logs(spark, events_path, rejects_path, **options)
    return curate(spark, events_path, curated, lost, minutes=minutes)
