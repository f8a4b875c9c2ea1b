"""JSON and CSV results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_rejects(rejected: DataFrame, path: str) -> None:
    """Rejected lines of one batch as JSON lines ``file, line, reason, raw``; a repeated batch replaces its own."""
    rejected.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; a field may hold quotes and line breaks."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    shown = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX") for c in text})
    shown.write.mode(mode).csv(path, header=True, quoteAll=True, escape='"')


def fixed_decimals(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every floating-point column as text with a fixed number of decimals."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: _fixed(F.col(c), digits) for c in doubles})


def _fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def as_json(df: DataFrame, alias: str = "document") -> DataFrame:
    """Each row as one JSON text, missing values written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(alias))


def write_json_document(document: DataFrame, path: str) -> None:
    """One-row, one-column JSON text to a text file."""
    document.coalesce(1).write.mode("overwrite").text(path)
