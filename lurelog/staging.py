"""Written intermediate tables.

A frame that several later passes read is written once as Parquet under the
shared folder named by ``spark.checkpoint.dir``.  The lineage is cut, a lost
executor only costs the tasks it ran, and later plans see real file sizes, so
Spark's own broadcast decision is based on a measured size.

Where that setting is absent the session's warehouse folder serves, which is
shared wherever tables are.  Every path is opened through Spark's own file
systems.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The shared staging folder of the session."""
    root = spark.conf.get(SETTING, None)
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/_staging").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the staging folder that no earlier run has used; it goes when the driver ends."""
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete one staged folder now instead of at the end of the driver."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged(df: DataFrame, label: str, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` once and return the frame that reads it back.

    ``schema`` may name another type with the same stored form, such as a
    vector column for its struct.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("errorifexists").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
