"""A session set up as the queries expect it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "inkwell", **conf: str) -> SparkSession:
    """UTC, AQE on; anything else, such as ``spark.master``, through ``conf``
    with underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Spark's default of rows in an Arrow batch, and what whole texts need: Spark's
#: writer and reader and Python hold a batch at a time.
ARROW_ROWS, DEFAULT_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 512


def small_batches(spark: SparkSession) -> None:
    """Any other number than the default is the user's own and stays."""
    if spark.conf.get(ARROW_ROWS) == DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
