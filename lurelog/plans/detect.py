"""Login-automation detection, label preparation, evaluation and threshold tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.operators import features as fe
from lurelog.operators import forest, labels, metrics, sweeps
from lurelog.sinks import files, tables
from lurelog.sources.tables import choose_events_table, read_csv_table, require_columns
from lurelog.staging import staged


def detect(
    windows: DataFrame, *, service: str | None = None, contamination: float = 0.01, seed: int = 42,
    use_forest: bool = True, **thresholds,
) -> DataFrame:
    """Windows with features, ``baseline_alert``, ``if_pred`` and ``if_score``."""
    chosen = staged(fe.filter_service(windows, service), "windows")
    if chosen.isEmpty():
        raise ValueError("no windows left after the filters")
    alerts = fe.baseline_alerts(fe.engineer_features(chosen), **thresholds)
    if not use_forest:
        return forest.without_forest(alerts)
    return forest.isolation_forest(staged(alerts, "features"), contamination, seed)


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def summary_document(scored: DataFrame, contamination: float, thresholds: dict, outputs: dict[str, str]) -> DataFrame:
    """One row: when, how many windows, the rule's thresholds and alerts, the forest's share and anomalies, the outputs."""
    used = {**fe.RULE_DEFAULTS, **thresholds}
    named = [F.lit(value).alias(name) for name, value in used.items()]
    return fe.alert_summary(scored).select(
        utc_now().alias("generated_at_utc"),
        "rows_total",
        F.struct(*named, "alerts_count").alias("baseline"),
        F.struct(F.lit(contamination).alias("contamination"), "anomalies_count").alias("isolation_forest"),
        F.struct(*[F.lit(path).alias(name) for name, path in outputs.items()]).alias("outputs"),
    )


def detect_and_write(
    windows: DataFrame, out: str, *, sample_n: int = 80, seed: int = 42, service: str | None = None,
    contamination: float = 0.01, use_forest: bool = True, **thresholds,
) -> DataFrame:
    """Write all scored windows, both top-200 lists, the summary and a label sample."""
    scored = detect(windows, seed=seed, service=service, contamination=contamination, use_forest=use_forest, **thresholds)
    outputs = {
        "parquet": f"{out}/anomaly_windows.parquet", "top_if_csv": f"{out}/top_if_anomalies",
        "top_baseline_csv": f"{out}/top_baseline_alerts",
    }
    tables.write_table(scored, outputs["parquet"])
    scored = windows.sparkSession.read.parquet(outputs["parquet"])
    files.write_csv(fe.top_anomalies(scored), outputs["top_if_csv"])
    files.write_csv(fe.top_alerts(scored), outputs["top_baseline_csv"])
    document = summary_document(scored, contamination, thresholds, outputs)
    files.write_json_document(files.as_json(document), f"{out}/anomaly_summary")
    if sample_n > 0:
        files.write_csv(labels.stratified_sample(scored, sample_n, seed), f"{out}/label_sample")
    return scored


def prepare_labels(
    spark: SparkSession, sample_csv: str, out_csv: str, *, events_table: str | None = None,
    events: DataFrame | None = None, minutes: int = 5, top_k: int = 5, examples: int = 3,
) -> DataFrame:
    """Attach event context to every sampled window and write the enriched CSV."""
    sample = labels.parse_window_start(read_csv_table(spark, sample_csv))
    if events is None:
        events = spark.table(choose_events_table(spark, events_table))
    enriched = labels.attach_context(sample, events, minutes, top_k, examples)
    files.write_csv(enriched, out_csv)
    return enriched


def evaluate_csv(spark: SparkSession, labeled_csv: str, pred_col: str, out_json: str | None = None) -> DataFrame:
    """Confusion counts and metrics of one prediction column of a labelled CSV, as the row of the written document."""
    result = metrics.evaluate(read_csv_table(spark, labeled_csv), pred_col).select(
        utc_now().alias("evaluated_at_utc"), "n", F.lit(pred_col).alias("pred_col"),
        F.struct("tp", "tn", "fp", "fn").alias("confusion_matrix"), F.struct("precision", "recall", "f1").alias("metrics"),
    )
    if out_json:
        files.write_json_document(files.as_json(result), out_json)
    return result


def tune(labeled: DataFrame, *, score_source: str = "sample", seed: int = 42, **grids) -> DataFrame:
    """Sweep rule thresholds, contaminations and top-k shares on a labelled sample.

    ``"sample"`` engineers features and fits the forest on the labelled rows
    alone; ``"full"`` keeps the ``if_score`` they already carry.
    """
    require_columns(labeled, ["label"])
    rows = staged(metrics.labelled_rows(labeled), "labelled")
    featured = staged(fe.engineer_features(rows), "labelled-features")
    if score_source == "sample":
        unscored = featured.drop("if_score", "if_pred")
        featured = forest.isolation_forest(unscored, sweeps.CONTAMINATIONS[0], seed)
    else:
        require_columns(labeled, ["if_score"])
    return sweeps.full_sweep(featured, F.col("label"), **grids)


def tune_and_write(labeled: DataFrame, out_csv: str, **options) -> DataFrame:
    """The sweep of ``tune`` as CSV, best ranking first."""
    swept = tune(labeled, **options)
    files.write_csv(swept.coalesce(1), out_csv)  # one row a parameter tuple
    return swept


def repair_and_write(spark: SparkSession, sweep_csv: str, out_csv: str) -> DataFrame:
    """A sweep CSV with flattened metrics computed anew, configuration texts and six decimals."""
    repaired = sweeps.with_config_label(sweeps.repair_metrics(read_csv_table(spark, sweep_csv)))
    files.write_csv(files.fixed_decimals(repaired), out_csv)
    return repaired
