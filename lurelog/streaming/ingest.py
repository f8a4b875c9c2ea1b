"""Log folders as streams: the normaliser, batches and increments of the batch plans, a micro-batch at a time.

A micro-batch is written as one batch of ``events_raw``, named after its stream
and number, and then brings the curated increments up to date.  Both replace
what an earlier attempt of the same micro-batch left, so a stream that dies and
starts again from its checkpoint ends with the tables of one batch run.  Late
events need no watermark there: the days they touch are computed again.

``login_counts`` is the running form for a live view: counts of a window are
dropped from the state once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lurelog import schema
from lurelog.operators import ip_windows, normalize
from lurelog.plans import increment
from lurelog.plans.ingest import chosen_sensors, normalize_sensors
from lurelog.sinks import files, tables
from lurelog.sources import logs


def normalized_stream(spark: SparkSession, folders: dict[str, str], *, files_at_a_time: int | None = None, **options) -> DataFrame:
    """Normalised rows, rejected ones too, of the sensors' log ``folders``."""
    lines = {sensor: logs.stream_log_lines(spark, folder, files_at_a_time) for sensor, folder in folders.items()}
    return normalize_sensors(lines, "both" if len(lines) == 2 else next(iter(lines)), **options)


def stream_to_curated(
    spark: SparkSession, folders: dict[str, str], events_path: str, rejects_path: str, curated: str, checkpoint: str, *,
    minutes: int = 5, available_now: bool = True, every: str = "1 minute", files_at_a_time: int | None = None, **options,
) -> StreamingQuery:
    """Start the stream from log ``folders`` (sensor: folder) to raw events, rejects and curated increments.

    ``available_now`` ends when all present files are read; else a micro-batch
    starts ``every`` so often.  Its name, and so what it replaces, comes from
    ``checkpoint``.
    """
    sensors = [s for s in chosen_sensors("both") if s in folders]
    stream = normalized_stream(spark, folders, files_at_a_time=files_at_a_time, **options)

    def write(parsed: DataFrame, number: int) -> None:
        batch = tables.batch_name([checkpoint, str(number)])
        written = tables.write_batch(parsed, events_path, batch)
        bad = written.filter(F.col("outcome") == tables.REJECT)
        for sensor in sensors:
            files.write_rejects(normalize.rejects(bad.filter(F.col("source") == sensor)), f"{rejects_path}/{sensor}_rejects/batch={batch}")
        increment.curate_batch(written.sparkSession, written.filter(F.col("outcome") == tables.EVENT), curated, minutes=minutes)
        tables.commit_batch(written, events_path, batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": every})).start()


def login_counts(events: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Attempts and successes of every window, source, service and address of a stream of events.

    A login that comes more than ``delay`` after the latest may be left out.
    """
    logins = ip_windows.login_events(events.withWatermark("ts_utc", delay))
    key = [F.window("ts_utc", f"{minutes} minutes").alias("w"), *schema.WINDOW_KEY[1:]]
    counted = logins.groupBy(*key).agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "login_success").alias("success_count"))
    return counted.select(F.col("w.start").alias("window_start"), *schema.WINDOW_KEY[1:], "attempts", "success_count")
