"""Rolling pass rates over a result log as it grows. The reference has no
streaming; this is new functionality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import passed
from ..sources.files import RESULTS


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.schema(RESULTS).json(folder).filter("image_id IS NOT NULL AND model_name IS NOT NULL")
    return rows.withColumn("at", F.timestamp_seconds("_timestamp"))


def rolling_pass_rates(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records and passes per model and window of ``at``; records later than
    ``late`` are dropped by the watermark."""
    ok = passed(F.col("constraint_satisfied"), F.col("cer_delta"))
    return (
        rows.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "model_name")
        .agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"))
        .select(F.col("w.start").alias("start"), "model_name", "n", "n_pass")
    )
