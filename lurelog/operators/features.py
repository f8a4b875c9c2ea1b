"""Detection features and the threshold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelog.operators.quantiles import exact_quantiles
from lurelog.staging import staged

COUNTS = ["attempts", "unique_users", "unique_passwords", "success_count"]
# Names of measures, derived columns and the columns a forest reads.
IMPUTED = ["mean_interarrival_s", "min_interarrival_s", "pass_entropy_mean"]
DERIVED = [
    "users_per_attempt", "passwords_per_attempt", "success_rate",
    "log_attempts", "log_unique_users", "log_unique_passwords",
]
FOREST_FEATURES = [
    "log_attempts", "log_unique_users", "log_unique_passwords", "users_per_attempt",
    "passwords_per_attempt", "pass_entropy_mean", "mean_interarrival_s", "min_interarrival_s",
    "success_rate",
]


def filter_service(windows: DataFrame, service: str | None) -> DataFrame:
    return windows.filter(F.col("service") == service) if service else windows


def coerce_windows(windows: DataFrame) -> DataFrame:
    """Numbers from any input text: bad or missing counts become 0, bad measures NULL."""
    counts = {c: F.coalesce(_number(windows, c).try_cast("bigint"), F.lit(0)) for c in COUNTS}
    measures = {c: _finite(_number(windows, c)) for c in IMPUTED}
    changes = {**counts, **measures}
    if "window_start" in windows.columns:
        changes["window_start"] = F.col("window_start").try_cast("timestamp")
    return windows.withColumns(changes)


def _number(df: DataFrame, column: str) -> Column:
    return F.col(column).try_cast("double") if column in df.columns else F.lit(None).cast("double")


def _finite(x: Column) -> Column:
    """NULL for NaN, which would otherwise compare greater than every threshold."""
    return F.when(~F.isnan(x), x)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def derive(windows: DataFrame) -> DataFrame:
    attempts = F.col("attempts")
    return windows.withColumns(
        {
            "users_per_attempt": ratio(F.col("unique_users"), attempts),
            "passwords_per_attempt": ratio(F.col("unique_passwords"), attempts),
            "success_rate": ratio(F.col("success_count"), attempts),
            "log_attempts": _log_count("attempts"),
            "log_unique_users": _log_count("unique_users"),
            "log_unique_passwords": _log_count("unique_passwords"),
        }
    )


def _log_count(column: str) -> Column:
    return F.log1p(F.greatest(F.col(column), F.lit(0)).cast("double"))


def impute(windows: DataFrame) -> DataFrame:
    """Fill missing measures with the exact median of the row's service.

    The median table has one row per service and is written, so its measured
    size lets Spark broadcast it; an unusually long one is shuffled instead.
    """
    by = "service" if "service" in windows.columns else None
    long = exact_quantiles(windows, IMPUTED, [0.5], by)
    picks = [
        F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"{c}_median") for c in IMPUTED
    ]
    medians = long.groupBy(*([by] if by else [])).agg(*picks)
    if by:
        joined = windows.join(staged(medians, "medians"), by, "left")
    else:
        row = medians.first()
        joined = windows.withColumns({c: F.lit(row[c]).cast("double") for c in medians.columns})
    filled = {c: F.coalesce(c, f"{c}_median") for c in IMPUTED}
    return joined.withColumns(filled).select(*windows.columns)


def zero_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite, NaN and missing numbers become 0.0 (a service without any median too)."""
    infinite = [float("inf"), float("-inf")]
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.isnan(c) | F.col(c).isin(infinite), F.lit(0.0)).otherwise(
                F.col(c)
            )
            for c in columns
        }
    )


def engineer_features(windows: DataFrame) -> DataFrame:
    """Ratios, logarithms and imputed gaps for every window.

    Reads its input several times; give it a written table.
    """
    derived = derive(coerce_windows(windows))
    return zero_non_finite(impute(derived), IMPUTED + DERIVED)


# Thresholds of the rule where the caller names none.
RULE_DEFAULTS = {"attempts_ge": 20, "unique_users_ge": 10, "unique_passwords_ge": 10, "max_mean_interarrival_s": 2.0}


def rule(
    attempts_ge: int = RULE_DEFAULTS["attempts_ge"],
    unique_users_ge: int = RULE_DEFAULTS["unique_users_ge"],
    unique_passwords_ge: int = RULE_DEFAULTS["unique_passwords_ge"],
    max_mean_interarrival_s: float | None = RULE_DEFAULTS["max_mean_interarrival_s"],
) -> Column:
    """Many attempts and either many users, many passwords or a short mean gap.

    ``None`` (or a negative number) switches the gap term off.
    """
    signal = (F.col("unique_users") >= unique_users_ge) | (
        F.col("unique_passwords") >= unique_passwords_ge
    )
    if max_mean_interarrival_s is not None and max_mean_interarrival_s >= 0:
        signal = signal | (F.col("mean_interarrival_s") <= max_mean_interarrival_s)
    return ((F.col("attempts") >= attempts_ge) & signal).cast("int")


def baseline_alerts(features: DataFrame, **thresholds) -> DataFrame:
    return features.withColumn("baseline_alert", rule(**thresholds))


def top_alerts(alerts: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` alerts with most attempts, then users, then passwords."""
    order = [F.desc("attempts"), F.desc("unique_users"), F.desc("unique_passwords")]
    key = ["window_start", "source", "service", "src_ip_hash"]
    return alerts.filter("baseline_alert = 1").orderBy(*order, *key).limit(n)


def top_anomalies(scored: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` windows with the lowest score, unscored ones last."""
    score = F.when(~F.isnan("if_score"), F.col("if_score"))
    key = ["window_start", "source", "service", "src_ip_hash"]
    return scored.orderBy(score.asc_nulls_last(), *key).limit(n)


def alert_summary(alerts: DataFrame) -> DataFrame:
    anomalies = F.sum("if_pred") if "if_pred" in alerts.columns else F.lit(None)
    return alerts.agg(
        F.count("*").alias("rows_total"),
        F.sum("baseline_alert").alias("alerts_count"),
        anomalies.cast("bigint").alias("anomalies_count"),
    )
