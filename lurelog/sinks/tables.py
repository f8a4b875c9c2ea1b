"""Parquet tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurelog import schema, staging
from lurelog.operators.dedup import only_new
from lurelog.sources.tables import _exists


EVENT, REJECT = "event", "reject"


MANIFESTS = "_manifests"
FOLDERS = ["outcome", "source", "event_date"]


def batch_name(parts: list[str]) -> str:
    """A batch's name from what it was made of, so that a repeated run has the same."""
    return "b" + hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def write_batch(parsed: DataFrame, path: str, batch: str) -> DataFrame:
    """Write normalised rows, rejected ones too, as one batch of the table at ``path``.

    A batch has a folder of its own, so a repeated one replaces itself whole.
    Inside, folders are outcome, sensor and day.  It counts once
    ``commit_batch`` has written its manifest; until then readers pass it by,
    and a batch that is written again loses its manifest first.  Returns the
    written rows.
    """
    spark = parsed.sparkSession
    staging.remove(spark, _manifest(path, batch))
    outcome = F.when(F.col("reject_reason").isNull(), EVENT).otherwise(REJECT)
    marked = parsed.withColumn("outcome", outcome)
    _write_dated(marked, f"{path}/batch={batch}", "overwrite", FOLDERS)
    return spark.read.schema(marked.schema).parquet(f"{path}/batch={batch}")


def commit_batch(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Write the manifest, ``source, outcome, reason, n`` of the batch's written ``rows``, and return it."""
    spark = rows.sparkSession
    counts = rows.groupBy("source", "outcome", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").json(_manifest(path, batch))
    return manifests(spark, path).where(F.col("batch") == batch)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """``source, outcome, reason, n, batch`` of every committed batch."""
    return spark.read.schema("source STRING, outcome STRING, reason STRING, n BIGINT, batch STRING").json(f"{path}/{MANIFESTS}")


def _manifest(path: str, batch: str) -> str:
    return f"{path}/{MANIFESTS}/batch={batch}"


def _committed(spark: SparkSession, path: str, but: str = "") -> DataFrame:
    """The events of committed batches, except one; folders of others are not read."""
    stored = T.StructType(list(schema.EVENTS.fields)).add("outcome", "string").add("event_date", "date").add("batch", "string")
    # Spark prunes folders by a join only where the other side is filtered.
    names = manifests(spark, path).select("batch").where((F.col("batch") > "") & (F.col("batch") != but)).distinct()
    events = spark.read.schema(stored).parquet(path).where((F.col("outcome") == EVENT) & (F.col("batch") != but))
    return events.join(names, "batch", "left_semi")


def append_events(events: DataFrame, path: str, skip_stored: bool = False, batch: str | None = None) -> None:
    """Append events as a batch, partitioned by sensor and day.

    ``skip_stored`` leaves out events already there, so that a repeated run
    adds nothing.  An event's time is part of its fingerprint, so only the days
    of the new events are read; give it a written table.
    """
    batch = batch or batch_name([uuid.uuid4().hex])
    if skip_stored:
        events = without_stored(events, path, batch)
    commit_batch(write_batch(events.withColumn("reject_reason", F.lit(None).cast("string")), path, batch), path, batch)


def without_stored(events: DataFrame, path: str, batch: str) -> DataFrame:
    """The written ``events`` that no other committed batch at ``path`` has; there may be none yet."""
    spark = events.sparkSession
    if not _exists(spark, f"{path}/{MANIFESTS}"):
        return events
    stored = _committed(spark, path, batch)
    first, last = events.agg(F.min(F.to_date("ts_utc")), F.max(F.to_date("ts_utc"))).first()
    return only_new(events, stored.where(F.col("event_date").between(F.lit(first), F.lit(last))))


def write_events(events: DataFrame, path: str) -> None:
    """The curated ``events``, replaced as a whole, partitioned by sensor and day."""
    _write_dated(events, path, "overwrite", ["source", "event_date"])


def _write_dated(rows: DataFrame, path: str, mode: str, folders: list[str]) -> None:
    """A rebalance gathers a day's rows in few files and splits large days."""
    dated = rows.withColumn("event_date", F.to_date("ts_utc"))
    dated.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(path)


def read_events(spark: SparkSession, path: str, dated: bool = False) -> DataFrame:
    """Events of committed batches, or of a curated table, in canonical column order; filters on source and day prune folders.

    ``dated`` keeps ``event_date``, the folder's day.
    """
    if _exists(spark, f"{path}/{MANIFESTS}"):
        stored = _committed(spark, path)
    else:
        stored = spark.read.parquet(path)
    return stored.select(*schema.EVENTS.names, *(["event_date"] if dated else []))


def replace_days(rows: DataFrame, path: str, folders: list[str] | None = None) -> None:
    """Replace the days that ``rows`` have, and only those; ``rows`` must not read ``path``."""
    folders = folders or ["event_date"]
    rows.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A curated table, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)
