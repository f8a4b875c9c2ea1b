"""Session settings the transformations rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings; safe to apply to any session, none of them is static.
REQUIRED = {
    # Event time is UTC everywhere; naive and zoned values never mix.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Settings that change speed only.
SPEED = {
    # The JVM interprets methods of more than 8,000 bytes for ever; a stage that would need one, such as
    # the choice of the members of a line, runs as separate projections, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results and speed depend on and return the session."""
    for key, value in (REQUIRED | SPEED).items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "lurelog", staging: str | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark; ``staging`` is its folder for staged tables."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # Call-site capture costs more than planning itself on wide projections.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if staging:
        builder = builder.config("spark.checkpoint.dir", staging)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
