"""JSON-lines log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurelog.functions.json_values import strip
from lurelog.staging import staged

INTERACTIVE_PATTERN = "cowrie.json*"


def read_log_lines(spark: SparkSession, paths: str | list[str], numbered: bool = False) -> DataFrame:
    """Physical lines of text logs as ``file, block_start, value`` (``+ line`` when numbered).

    The scan is splittable.  Invalid UTF-8 is replaced, blank lines are left
    out, and a path that matches nothing is an error.
    """
    lines = _lines(spark.read.text(paths))
    if numbered:
        lines = _with_line_numbers(lines)
    return lines.filter(f"{strip('value')} <> ''")


def stream_log_lines(spark: SparkSession, folder: str, files_at_a_time: int | None = None) -> DataFrame:
    """The same from a folder that files are moved into, as a stream."""
    reader = spark.readStream
    if files_at_a_time:
        reader = reader.option("maxFilesPerTrigger", files_at_a_time)
    return _lines(reader.text(folder)).filter(f"{strip('value')} <> ''")


def _lines(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.make_valid_utf8("value").alias("value"),
    )


def _with_line_numbers(lines: DataFrame) -> DataFrame:
    """1-based physical line number per file.

    Lines are counted per file block (one small row per block), the counts are
    added up along each file, and a line's place in its block follows from the
    scan order.  No line changes its task for this.
    """
    ordered = lines.withColumn("scan_id", F.monotonically_increasing_id())
    blocks = ordered.groupBy("file", "block_start").agg(
        F.min("scan_id").alias("first_id"), F.count("*").alias("n")
    )
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = blocks.select(
        "file",
        "block_start",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    # Written first: one row a file block, whose measured size lets Spark broadcast it.
    return ordered.join(staged(offsets, "line-offsets"), ["file", "block_start"], "left").select(
        "file", "block_start", "value", (F.col("scan_id") + F.col("shift")).alias("line")
    )


def discover_files(spark: SparkSession, folder: str, pattern: str = INTERACTIVE_PATTERN) -> list[str]:
    """Sorted regular files of ``folder`` that match ``pattern``; none is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(path) or []
    files = sorted(status.getPath().toString() for status in found if status.isFile())
    if not files:
        raise FileNotFoundError(f"no file matches {folder}/{pattern}")
    return files


def described(spark: SparkSession, paths: list[str]) -> list[str]:
    """Path, size and time of every file that the ``paths`` name, folders one level deep."""
    jvm, found = spark.sparkContext._jvm, []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for match in system.globStatus(target) or []:
            inside = system.listStatus(match.getPath()) if match.isDirectory() else [match]
            found += [f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in inside if s.isFile()]
    return sorted(found)
