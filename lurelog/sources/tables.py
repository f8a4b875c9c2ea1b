"""Curated tables and labelled CSV files as inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, table: str, path: str, prefer: str = "catalog") -> DataFrame:
    """The catalog table when it exists and is preferred, else its Parquet files, else an error."""
    if prefer == "catalog" and spark.catalog.tableExists(table):
        return spark.table(table)
    if _exists(spark, path):
        return spark.read.parquet(path)
    raise FileNotFoundError(f"neither table {table} nor files at {path}")


def choose_events_table(spark: SparkSession, preferred: str | None = None) -> str:
    """Name of the events table to use: the preferred one, ``events`` or ``events_raw``."""
    for name in (preferred, "events", "events_raw"):
        if name and spark.catalog.tableExists(name):
            return name
    raise LookupError("neither events nor events_raw is in the catalog")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A header CSV whose quoted fields may span lines; columns are matched by name.

    Every column is read as text (``try_cast`` later decides what a bad value
    means); ``schema`` then selects and casts the columns that are present.
    """
    table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if schema is None:
        return table
    present = [f for f in schema.fields if f.name in table.columns]
    return table.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in present])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    if "://" not in path and os.path.exists(path):
        return True
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
