"""Threshold sweeps over windows of any number.

A sweep never multiplies the data by its grid.  Each row is first reduced to
how many of the grid's thresholds it reaches; rows are counted per such cell
(at most a few hundred cells, combined on the map side), and only the cells
meet the grid.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelog.operators import metrics
from lurelog.operators.quantiles import exact_quantiles
from lurelog.sources.tables import require_columns

# The default grids.
ATTEMPTS = [10, 15, 20, 30]
USERS = [5, 10, 15]
PASSWORDS = [5, 10, 15]
MEAN_GAPS = [1.0, 2.0, -1.0]
CONTAMINATIONS = [0.005, 0.01, 0.02, 0.05, 0.1]
TOPK_PERCENTS = [1.0, 2.0, 5.0, 10.0]

PARAMS = ["attempts_ge", "unique_users_ge", "unique_passwords_ge", "max_mean_interarrival_s"]


def _rank(value: str, marks: list, below: bool = False) -> Column:
    """The strictest threshold a value still meets: a grid value, or NULL for none."""
    reached = None
    for mark in sorted(marks, reverse=not below):
        test = F.col(value) <= mark if below else F.col(value) >= mark
        reached = F.when(test, F.lit(mark)) if reached is None else reached.when(test, F.lit(mark))
    return reached if reached is not None else F.lit(None).cast("double")


def rule_cells(features: DataFrame, attempts, users, passwords, gaps, label: Column) -> DataFrame:
    """Window counts per reached thresholds and label."""
    return (
        features.select(
            _rank("attempts", attempts).cast("double").alias("a"),
            _rank("unique_users", users).cast("double").alias("u"),
            _rank("unique_passwords", passwords).cast("double").alias("p"),
            _rank("mean_interarrival_s", [g for g in gaps if g >= 0], below=True).cast("double").alias("g"),
            label.cast("bigint").alias("label"),
        )
        .groupBy("a", "u", "p", "g", "label")
        .agg(F.count("*").alias("m"))
    )


def rule_sweep(
    features: DataFrame,
    label: Column,
    *,
    attempts=ATTEMPTS,
    users=USERS,
    passwords=PASSWORDS,
    gaps=MEAN_GAPS,
    zero_division: str = "zero",
) -> DataFrame:
    """Per threshold combination: alert volume and rate, and metrics on the labelled rows.

    ``label`` is 1, 0 or NULL (unlabelled); unlabelled rows count for the volume only.
    """
    cells = rule_cells(features, attempts, users, passwords, gaps, label)
    grid = list(product(attempts, users, passwords, gaps))
    configs = F.array(
        *[
            F.struct(
                F.lit(i).alias("grid_id"), F.lit(a).alias("attempts_ge"),
                F.lit(u).alias("unique_users_ge"), F.lit(p).alias("unique_passwords_ge"),
                F.lit(float(g)).alias("max_mean_interarrival_s"),
            )
            for i, (a, u, p, g) in enumerate(grid)
        ]
    )
    # A cell meets a threshold when the strictest one it reached is at least as strict.
    gap_hit = (F.col("max_mean_interarrival_s") >= 0) & (F.col("g") <= F.col("max_mean_interarrival_s"))
    signal = (F.col("u") >= F.col("unique_users_ge")) | (F.col("p") >= F.col("unique_passwords_ge"))
    hit = (F.col("a") >= F.col("attempts_ge")) & (signal | gap_hit)
    judged = cells.select("*", F.inline(configs)).withColumn(
        "pred", F.coalesce(hit, F.lit(False)).cast("int")
    )
    totals = judged.groupBy("grid_id", *PARAMS).agg(
        F.sum("m").alias("rows_total"),
        F.sum(F.col("m") * F.col("pred")).alias("alerts_full_count"),
        *[_weighted(name, F.col("label"), F.col("pred")).alias(name) for name in metrics.CELLS],
    )
    marks = metrics.scores(F.col("tp"), F.col("fp"), F.col("fn"), zero_division)
    return totals.withColumns(marks).select(
        "grid_id", *PARAMS,
        *[F.col(c).alias(f"sample_{c}") for c in ("precision", "recall", "f1", "tp", "fp", "fn", "tn")],
        "alerts_full_count",
        (F.col("alerts_full_count") / F.col("rows_total")).alias("alerts_full_rate"),
    )


def _weighted(cell: str, label: Column, pred: Column) -> Column:
    truth, guess = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}[cell]
    return F.coalesce(F.sum(F.when((label == truth) & (pred == guess), F.col("m"))), F.lit(0))


def with_config_label(sweep: DataFrame) -> DataFrame:
    """Readable ``label_text`` per configuration; an existing one is kept."""
    if "label_text" in sweep.columns:
        return sweep.withColumn("label_text", F.col("label_text").cast("string"))
    if set(PARAMS) - set(sweep.columns):
        order = Window.partitionBy().orderBy(*sweep.columns)  # a sweep table has grid size
        return sweep.withColumn(
            "label_text", F.format_string("cfg_%d", F.row_number().over(order) - 1)
        )
    gap = F.col("max_mean_interarrival_s").try_cast("double")
    plain = F.regexp_replace(gap.cast("string"), r"\.0$", "")
    gap_text = F.when(gap.isNull(), "mi=?").when(gap < 0, "mi=off").otherwise(
        F.concat(F.lit("mi<="), plain, F.lit("s"))
    )
    text = F.format_string(
        "a>=%d, u>=%d, p>=%d, %s",
        *[F.col(c).cast("int") for c in PARAMS[:3]], gap_text,
    )
    return sweep.withColumn("label_text", text)


def operating_profiles(sweep: DataFrame, n: int = 10) -> DataFrame:
    """``alerting``: best precision, then fewest alerts; ``triage``: best F1 in grid order."""
    alerting = sweep.orderBy(F.desc("sample_precision"), "alerts_full_count", "grid_id").limit(n)
    triage = sweep.orderBy(F.desc("sample_f1"), "grid_id").limit(n)
    return alerting.withColumn("profile", F.lit("alerting")).unionByName(
        triage.withColumn("profile", F.lit("triage"))
    )


def repair_metrics(table: DataFrame) -> DataFrame:
    """Recompute precision, recall and F1 from the counts when recall is only 0s and 1s."""
    kept = [c for c in ("sample_precision", "sample_recall", "sample_f1") if c in table.columns]
    table = table.withColumns({c: F.col(c).try_cast("double") for c in kept})

    def first_of(cell: str) -> str | None:
        names = [f"sample_{cell}", f"baseline_{cell}", cell]
        return next((c for c in names if c in table.columns), None)

    tp_col, fp_col, fn_col = map(first_of, ("tp", "fp", "fn"))
    if "sample_recall" not in kept or not (tp_col and fn_col):
        return table
    recall = F.round("sample_recall", 6)
    odd = table.agg(
        F.count_if(~recall.isin(0.0, 1.0)).alias("other"),
        F.count_distinct("sample_recall").alias("values"),
    ).first()
    if odd["other"] or odd["values"] > 2:
        return table
    tp, fn = F.col(tp_col).try_cast("double"), F.col(fn_col).try_cast("double")
    table = table.withColumn("sample_recall", F.try_divide(tp, tp + fn))
    if "sample_precision" in kept and fp_col:
        fp = F.col(fp_col).try_cast("double")
        table = table.withColumn("sample_precision", F.try_divide(tp, tp + fp))
    if "sample_f1" in kept and "sample_precision" in kept:
        p, r = F.col("sample_precision"), F.col("sample_recall")
        table = table.withColumn("sample_f1", F.try_divide(2 * p * r, p + r))
    return table


def chart_points(sweep: DataFrame, n: int = 12) -> DataFrame:
    """Sweep rows with ``annotated`` set for the n best by F1."""
    require_columns(sweep, ["sample_f1", "sample_recall", "sample_precision"])
    best = Window.partitionBy().orderBy(F.desc_nulls_last("sample_f1"), *PARAMS)  # grid-sized table
    return with_config_label(sweep).withColumn("annotated", F.row_number().over(best) <= n)


def chart_series(table: DataFrame, x: str) -> DataFrame:
    """Line-chart rows in order of ``x``; rows with an incomplete metric are dropped."""
    columns = [x, "sample_precision", "sample_recall", "sample_f1"]
    require_columns(table, columns)
    extra = [c for c in ("alerts_full_count",) if c in table.columns]
    numbers = table.select(*[F.col(c).try_cast("double").alias(c) for c in columns + extra])
    return numbers.dropna(subset=columns).orderBy(x)


def score_sweep(
    scored: DataFrame, label: Column, probs: list[float], zero_division: str = "zero",
    inclusive: bool = True, score: str = "if_score",
) -> DataFrame:
    """Flag the lowest share of scores, per share: threshold, alert volume and metrics.

    ``inclusive`` flags ``score <= threshold`` (ranking), else ``<`` (the forest's
    own prediction).  Rows are counted per crossed threshold and label, so the
    data is read once however many shares are asked for.
    """
    found = exact_quantiles(scored, [score], probs)
    marks = sorted((r["value"], r["prob"]) for r in found.collect())  # one row per share
    if not marks:
        raise ValueError("no score to sweep")
    position = F.lit(len(marks))
    for i in range(len(marks) - 1, -1, -1):
        mark = F.lit(marks[i][0])
        flagged = F.col(score) <= mark if inclusive else F.col(score) < mark
        position = F.when(flagged, F.lit(i)).otherwise(position)
    cells = scored.select(position.alias("position"), label.cast("bigint").alias("label")).groupBy(
        "position", "label"
    ).agg(F.count("*").alias("m"))
    shares = F.array(
        *[
            F.struct(F.lit(i).alias("mark"), F.lit(p).alias("prob"), F.lit(v).alias("threshold_if_score"))
            for i, (v, p) in enumerate(marks)
        ]
    )
    pred = (F.col("position") <= F.col("mark")).cast("int")
    totals = (
        cells.select("*", F.inline(shares)).withColumn("pred", pred)
        .groupBy("prob", "threshold_if_score")
        .agg(
            F.sum("m").alias("rows_total"),
            F.sum(F.col("m") * F.col("pred")).alias("alerts_full_count"),
            *[_weighted(c, F.col("label"), F.col("pred")).alias(c) for c in metrics.CELLS],
        )
    )
    rates = metrics.scores(F.col("tp"), F.col("fp"), F.col("fn"), zero_division)
    return totals.withColumns(rates).select(
        "prob", "threshold_if_score", "alerts_full_count",
        (F.col("alerts_full_count") / F.col("rows_total")).alias("alerts_full_rate"),
        *[F.col(c).alias(f"sample_{c}") for c in ("precision", "recall", "f1", "tp", "fp", "fn")],
    )


def full_sweep(
    features: DataFrame, label: Column, contaminations=CONTAMINATIONS, topk=TOPK_PERCENTS, **grid
) -> DataFrame:
    """Rule, forest and ranking metrics for every parameter tuple, best ranking first.

    ``features`` carries ``if_score`` from one fit.  A shift of the score by the
    contamination threshold changes neither ranking nor counts, so the forest
    is not fitted again per tuple.
    """
    base = rule_sweep(features, label, **grid)
    forest = score_sweep(features, label, contaminations, inclusive=False)
    ranking = score_sweep(features, label, [k / 100 for k in topk])
    wanted = ("precision", "recall", "f1", "tp", "fp", "fn")

    def named(table: DataFrame, kind: str, *keys: Column) -> DataFrame:
        return table.select(*keys, *[F.col(f"sample_{c}").alias(f"{kind}_{c}") for c in wanted])

    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("contamination"), F.lit(float(k)).alias("topk_percent"))
            for c in contaminations
            for k in topk
        ]
    )
    params = [F.col("grid_id"), *map(F.col, PARAMS)]
    tuples = named(base, "baseline", *params).select("*", F.inline(pairs))
    joined = tuples.join(
        named(forest, "if", F.col("prob").alias("contamination")), "contamination"
    ).join(
        named(ranking, "rank", F.round(F.col("prob") * 100, 6).alias("topk_percent")), "topk_percent"
    )
    order = [F.desc("rank_f1"), F.desc("baseline_f1"), "grid_id", "contamination", "topk_percent"]
    return joined.orderBy(*order)
