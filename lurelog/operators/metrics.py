"""Confusion counts and precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelog.sources.tables import require_columns

CELLS = ["tp", "tn", "fp", "fn"]


def labelled_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a readable label, as whole numbers; text that is no number is dropped."""
    number = F.col(label).try_cast("double")
    return df.withColumn(label, F.when(~F.isnan(number), number).try_cast("bigint")).filter(
        F.col(label).isNotNull()
    )


def whole_number(column: str) -> Column:
    """Prediction as a whole number, 0 where missing."""
    number = F.col(column).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0))


def confusion(label: Column, pred: Column) -> dict[str, Column]:
    """Aggregates for the four cells; values other than 0 and 1 fall in none."""
    return {
        "tp": F.count_if((label == 1) & (pred == 1)),
        "tn": F.count_if((label == 0) & (pred == 0)),
        "fp": F.count_if((label == 0) & (pred == 1)),
        "fn": F.count_if((label == 1) & (pred == 0)),
    }


def scores(tp: Column, fp: Column, fn: Column, zero_division: str = "null") -> dict[str, Column]:
    """Precision, recall and F1; a zero denominator gives NULL or, with ``"zero"``, 0.0."""
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    if zero_division == "zero":
        precision, recall = (F.coalesce(x, F.lit(0.0)) for x in (precision, recall))
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    if zero_division == "zero":
        f1 = F.coalesce(f1, F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def evaluate(df: DataFrame, pred_col: str, label: str = "label") -> DataFrame:
    """One row ``n, tp, tn, fp, fn, precision, recall, f1``; no label at all is an error."""
    require_columns(df, [label, pred_col])
    rows = labelled_rows(df, label)
    cells = confusion(F.col(label), whole_number(pred_col))
    counted = rows.agg(
        F.count("*").alias("n"), *[column.alias(name) for name, column in cells.items()]
    )
    checked = counted.withColumn(
        "n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no label is filled in")))
    )
    return checked.withColumns(scores(F.col("tp"), F.col("fp"), F.col("fn")))
