"""Label samples and the event context a labeller needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.functions.json_values import strip
from lurelog.sources.tables import require_columns
from lurelog.staging import staged

# The columns of a label sample.
SAMPLE_COLUMNS = [
    "window_start", "source", "service", "src_ip_hash", "src_ip_masked",
    "attempts", "unique_users", "unique_passwords", "success_count",
    "mean_interarrival_s", "min_interarrival_s", "pass_entropy_mean",
    "baseline_alert", "if_pred", "if_score",
]


def draw_key(purpose: str, seed: int) -> Column:
    """A keyed hash of the window key: the same draw at any partitioning."""
    parts = [F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), *map(F.col, schema.WINDOW_KEY[1:])]
    return F.md5(F.concat_ws("|", *parts, F.lit(f"{purpose}{seed}")))


def stratified_sample(scored: DataFrame, n: int = 80, seed: int = 42) -> DataFrame:
    """Up to n/2 suspicious windows (alert or anomaly), the rest normal, shuffled.

    Each stratum is cut to its quota by a bounded top-n, never sorted whole.
    When suspicious windows are short, normal ones fill up; not the reverse.
    """
    suspicious = (F.col("baseline_alert") == 1) | (F.col("if_pred") == 1)
    key = draw_key("draw", seed)

    def drawn(stratum: DataFrame, quota: int) -> DataFrame:
        return stratum.withColumn("draw", key).orderBy("draw").limit(quota)

    hot = drawn(scored.filter(suspicious), n // 2).withColumn("normal", F.lit(0))
    calm = drawn(scored.filter(~suspicious), n).withColumn("normal", F.lit(1))
    # At most 1.5 n rows from here on.
    everything = Window.partitionBy()
    by_draw = Window.partitionBy("normal").orderBy("draw")
    picked = (
        hot.unionByName(calm)
        .withColumn("hot_rows", F.count_if(F.col("normal") == 0).over(everything))
        .withColumn("rank", F.row_number().over(by_draw))
        .filter((F.col("normal") == 0) | (F.col("rank") <= n - F.col("hot_rows")))
    )
    columns = [c for c in SAMPLE_COLUMNS if c in scored.columns]
    return picked.orderBy(draw_key("shuffle", seed)).select(F.lit("").alias("label"), *columns)


def parse_window_start(sample: DataFrame) -> DataFrame:
    """``window_start`` as UTC time; a single unreadable value is an error."""
    require_columns(sample, schema.WINDOW_KEY)
    parsed = sample.withColumn("window_start", F.col("window_start").try_cast("timestamp"))
    bad = parsed.agg(F.count_if(F.col("window_start").isNull()).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"window_start is unreadable in {bad} rows")
    return parsed


def events_in_windows(sample: DataFrame, events: DataFrame, minutes: int = 5) -> DataFrame:
    """Events of each sampled window: same source, service, address and half-open time range.

    A window of any start touches at most two epoch-aligned buckets, so the
    range condition becomes an equality on the bucket.  Spark broadcasts the
    sample when its size is small and otherwise shuffles both sides.
    """
    length = minutes * 60
    begin = F.unix_seconds("window_start")
    end_us = F.unix_micros("window_start") + length * 1_000_000
    buckets = F.array_distinct(
        F.array(F.floor(begin / length), F.floor((end_us - 1) / (length * 1_000_000)))
    )
    wanted = sample.select(*schema.WINDOW_KEY).distinct().withColumn("bucket", F.explode(buckets))
    # The sample's time range goes down to the scan, which skips files outside it.
    first, last = sample.agg(F.min("window_start"), F.max("window_start") + F.make_dt_interval(mins=F.lit(minutes))).first()
    events = events.filter((F.col("ts_utc") >= F.lit(first)) & (F.col("ts_utc") < F.lit(last)))
    if "event_date" in events.columns:
        events = _on_days(events, sample, minutes)
    bucketed = events.withColumn("bucket", F.floor(F.unix_seconds("ts_utc") / length))
    inside = (F.unix_micros("ts_utc") >= F.unix_micros("window_start")) & (
        F.unix_micros("ts_utc") < end_us
    )
    return bucketed.join(wanted, ["source", "service", "src_ip_hash", "bucket"]).filter(inside)


def _on_days(events: DataFrame, sample: DataFrame, minutes: int) -> DataFrame:
    """Events of the days that windows touch; other days' folders are not read.

    The days, one row each, are a written table; Spark prunes folders by a join
    where the other side is small by its size and filtered.
    """
    last = F.col("window_start") + F.make_dt_interval(mins=F.lit(minutes)) - F.expr("INTERVAL 1 MICROSECOND")
    days = sample.select(F.explode(F.sequence(F.to_date("window_start"), F.to_date(last))).alias("event_date")).distinct()
    wanted = staged(days, "label-days").where(F.col("event_date") > F.lit("0001-01-01").cast("date"))
    return events.join(wanted, "event_date", "left_semi").select(*events.columns)


def context_counts(matched: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return matched.groupBy(*schema.WINDOW_KEY).agg(
        F.count("*").alias("events_in_window"),
        F.count_if(kind.isin(schema.LOGIN_FAIL_LIKE)).alias("login_fail_like"),
        F.count_if(kind == "login_success").alias("login_success"),
    )


def top_values(matched: DataFrame, column: str, alias: str, k: int = 5) -> DataFrame:
    """The k most frequent values per window as ``"value:count, …"``."""
    counts = (
        matched.filter(F.col(column).isNotNull())
        .groupBy(*schema.WINDOW_KEY, column)
        .agg(F.count("*").alias("cnt"))
    )
    order = Window.partitionBy(*schema.WINDOW_KEY).orderBy(F.desc("cnt"), column)
    ranked = counts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    return _joined_text(ranked, F.concat_ws(":", column, "cnt"), ", ", alias)


def example_events(matched: DataFrame, n: int = 3) -> DataFrame:
    """The first n events per window, one readable line each."""
    order = Window.partitionBy(*schema.WINDOW_KEY).orderBy("ts_utc", "event_hash")
    first = matched.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    return _joined_text(first, event_line(), "\n", "example_events")


def event_line() -> Column:
    """``time | type | id | cmd=…`` or, without a command, ``raw=`` and the record."""
    command = F.expr(strip("coalesce(command, '')"))
    raw = F.coalesce("raw_json", F.lit(""))
    detail = F.when(command != "", F.concat(F.lit("cmd="), command)).otherwise(
        F.concat(F.lit("raw="), raw)
    )
    head = [_time_text(), _none_text("event_type"), _none_text("eventid")]
    return F.concat_ws(" | ", *head, detail)


def _time_text() -> Column:
    micros = F.date_format("ts_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(micros, r"\.000000$", "")


def _none_text(column: str) -> Column:
    return F.coalesce(column, F.lit("None"))


def _joined_text(ranked: DataFrame, text: Column, separator: str, alias: str) -> DataFrame:
    """Join the few ranked texts of each window in rank order."""
    entries = F.array_sort(F.collect_list(F.struct("rn", text.alias("text"))))
    joined = F.array_join(F.transform(entries, lambda e: e["text"]), separator)
    return ranked.groupBy(*schema.WINDOW_KEY).agg(joined.alias(alias))


def attach_context(
    sample: DataFrame, events: DataFrame, minutes: int = 5, top_k: int = 5, examples: int = 3
) -> DataFrame:
    """The sample with counts, top credentials and example events per window.

    Rows without any event keep zeros and empty texts.
    """
    matched = staged(events_in_windows(sample, events, minutes), "label-events")
    parts = [
        context_counts(matched),
        top_values(matched, "username_hash", "top_usernames", top_k),
        top_values(matched, "password_hash", "top_passwords", top_k),
        example_events(matched, examples),
    ]
    for part in parts:
        sample = sample.join(part, schema.WINDOW_KEY, "left")
    zeros = {c: 0 for c in ("events_in_window", "login_fail_like", "login_success")}
    texts = {c: "" for c in ("top_usernames", "top_passwords", "example_events")}
    return sample.fillna({**zeros, **texts})
