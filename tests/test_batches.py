"""Batches that come twice or die, increments, day pruning and streams."""

import pytest
from pyspark.sql import functions as F

from lurelog import staging
from lurelog.operators import labels, normalize
from lurelog.plans import increment, ingest
from lurelog.sinks import files, tables
from lurelog.staging import new_path, staged
from lurelog.streaming import ingest as streaming
from lurelog.workload import adapter, catalog

SF = "/root/testdata/sf0.001"
OPTIONS = dict(salt=adapter.SALT, redact_free_text=True)


@pytest.fixture(scope="module")
def log_dirs(spark):
    catalog.configure(spark)
    root = new_path(spark, "logs")
    for sensor, frame in catalog.lines(spark, SF).items():
        frame.select("value").coalesce(2).write.text(f"{root}/{sensor}")
    return root


@pytest.fixture(scope="module")
def raw(spark):
    return staged(normalize.valid_events(catalog.normalized(catalog.configure(spark), SF)), "raw")


def rows(df):
    return sorted(map(repr, df.collect()))


def ingested(spark, log_dirs, root, **options):
    return ingest.ingest_logs(
        spark, f"{root}/events_raw", f"{root}/rejects", cowrie_dir=f"{log_dirs}/cowrie", cowrie_pattern="part-*",
        opencanary_path=f"{log_dirs}/opencanary", **OPTIONS, **options)


def test_a_run_that_dies_and_repeats_leaves_no_copy(spark, log_dirs, raw, monkeypatch):
    root = new_path(spark, "lake")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(files, "write_rejects", dies)
        with pytest.raises(RuntimeError, match="killed"):
            ingested(spark, log_dirs, root)
    for _ in range(2):
        lost = ingested(spark, log_dirs, root).agg(F.sum("n")).first()[0]
        assert tables.read_events(spark, f"{root}/events_raw").count() == raw.count()
        bad = spark.read.option("recursiveFileLookup", "true").json(f"{root}/rejects")
        assert bad.count() == lost
    counted = tables.manifests(spark, f"{root}/events_raw")
    assert counted.where("outcome = 'event'").agg(F.sum("n")).first()[0] == raw.count()
    # A batch without its manifest is passed by.
    batch = counted.first().batch
    staging.remove(spark, f"{root}/events_raw/{tables.MANIFESTS}/batch={batch}")
    tables.append_events(raw.limit(3), f"{root}/events_raw", batch="b2")
    assert tables.read_events(spark, f"{root}/events_raw").count() == 3
    # Repeated with others' events left out, its own do not count as stored.
    ingested(spark, log_dirs, root, skip_stored=True)
    ingested(spark, log_dirs, root, skip_stored=True)
    kept = tables.read_events(spark, f"{root}/events_raw")
    assert kept.select("event_hash").distinct().count() == raw.select("event_hash").distinct().count()


def test_skip_stored_works_where_nothing_is_stored(spark, raw):
    path = new_path(spark, "first")
    tables.append_events(raw, path, skip_stored=True)
    tables.append_events(raw, path, skip_stored=True)
    assert tables.read_events(spark, path).count() == raw.count()


def file_names(spark, path):
    return {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


def test_increments_write_only_the_days_they_touch(spark, raw):
    root = new_path(spark, "inc")
    days = [r.d for r in raw.select(F.to_date("ts_utc").alias("d")).distinct().orderBy("d").collect()]
    first = raw.where(F.to_date("ts_utc") != days[-1])
    increment.curate_batch(spark, first, root)
    names = ("events", "session_days", "item_days", "ip_windows", "login_days")
    before = {t: file_names(spark, f"{root}/{t}") for t in names}
    assert increment.curate_batch(spark, raw.where(F.to_date("ts_utc") == days[-1]), root) == [days[-1]]
    last = f"event_date={days[-1]}"
    for table, old in before.items():
        now = file_names(spark, f"{root}/{table}")
        assert old <= now and now - old and all(last in name for name in now - old)
    tables_then = [rows(spark.read.parquet(f"{root}/{t}")) for t in names]
    # The same batch again, and one that was killed before its windows, change nothing.
    increment.curate_batch(spark, first.where(F.to_date("ts_utc") >= days[-3]), root)
    assert [rows(spark.read.parquet(f"{root}/{t}")) for t in names] == tables_then
    assert increment.curate_batch(spark, raw.limit(0), root) == []
    with pytest.raises(ValueError):
        increment.curate_batch(spark, raw, root, minutes=7)


def test_a_late_login_moves_the_next_days_gap(spark, raw):
    def login(day, hour):
        return raw.where("event_type = 'login_fail'").limit(1).select(*[
            (F.to_timestamp(F.lit(f"2025-05-{day:02d} {hour:02d}:00:00")) if c == "ts_utc" else F.lit("x" * 8) if c == "src_ip_hash"
             else F.lit(f"h{day}-{hour}") if c == "event_hash" else F.col(c)).alias(c) for c in raw.columns])

    root = new_path(spark, "late")
    increment.curate_batch(spark, login(1, 6).unionByName(login(4, 6)).unionByName(login(9, 6)), root)
    counted = increment.curate_batch(spark, login(2, 6), root)
    assert [d.day for d in counted] == [2, 4]
    gaps = {r.window_start.day: r.min_interarrival_s for r in increment.read_ip_windows(spark, root).collect()}
    assert gaps == {1: None, 2: 86400.0, 4: 2 * 86400.0, 9: 5 * 86400.0}


def test_context_reads_only_the_samples_days(spark, raw):
    path = new_path(spark, "year")
    spread = raw.withColumn("ts_utc", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("event_hash"), F.lit(365)) * 86400 + 60))
    tables.write_events(spread, path)
    stored = tables.read_events(spark, path, dated=True)
    sample = stored.where("src_ip_hash IS NOT NULL").orderBy("event_hash").limit(4).select(F.col("ts_utc").alias("window_start"), "source", "service", "src_ip_hash").distinct()
    sample = staged(sample, "few")
    matched = labels.events_in_windows(sample, stored, 5)
    counts = rows(labels.context_counts(matched))
    plain = labels.events_in_windows(sample, tables.read_events(spark, path), 5)
    assert counts == rows(labels.context_counts(plain))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    wanted = {r.d for r in sample.select(F.to_date("window_start").alias("d")).distinct().collect()}
    read = matched.select(F.to_date("ts_utc").alias("d")).distinct().collect()
    assert {r.d for r in read} <= wanted and len(wanted) <= 4


def test_streamed_login_counts(spark, raw):
    path = new_path(spark, "stream-in")
    raw.write.parquet(path)
    stream = streaming.login_counts(spark.readStream.schema(raw.schema).parquet(path), 1440, "400 days")
    running = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    running.awaitTermination()
    plain = raw.where(F.col("event_type").isin("login_fail", "login_success", "login_attempt") & F.col("src_ip_hash").isNotNull())
    wanted = plain.groupBy(F.date_trunc("day", "ts_utc").alias("window_start"), "source", "service", "src_ip_hash").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "login_success").alias("success_count"))
    assert rows(spark.table("counts")) == rows(wanted)


def test_a_batch_stages_only_what_it_reads_again(spark, raw, monkeypatch):
    labels_of = []

    def noted(df, label, *rest):
        labels_of.append(label)
        return staged(df, label, *rest)

    monkeypatch.setattr(increment, "staged", noted)
    root = new_path(spark, "increments")
    for _ in range(2):
        increment.curate_batch(spark, raw, root)
    assert set(labels_of) <= {"batch-events", "batch-merged", "login-days", "login-history", "carried-logins"}
