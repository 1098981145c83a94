"""Roll-ups of experiment results: one row per configuration, sample and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passed(satisfied: Column, delta: Column) -> Column:
    """FIL5: missing values fail."""
    return F.coalesce(satisfied, F.lit(False)) & (F.coalesce(delta, F.lit(0.0)) > 0)


def last_wins(rows: DataFrame, keys: list[str], flag: str, order: Column) -> DataFrame:
    """AGG5: of several records of a cell the last one counts."""
    return rows.groupBy(*keys).agg(F.max_by(flag, order).alias(flag))


def any_and_all(cells: DataFrame, config: list[str], sample: str, model: str, flag: str, n_models: int | None = None) -> DataFrame:
    """AGG6, AGG7: samples, and those that any model and that every model
    passes. All models are those of the whole table unless their number is
    given; an absent record is a failure. The model count joins as one row."""
    per_sample = cells.groupBy(*config, sample).agg(F.count_if(flag).alias("_k"))
    # the flag is counted too, so that both aggregates read the same exchange
    models = cells.agg(F.countDistinct(model).alias("_m"), F.count_if(flag).alias("_p")).select(F.when(F.col("_p") >= 0, F.col("_m")).alias("_m")) if n_models is None else None
    joined = per_sample.crossJoin(F.broadcast(models)) if models is not None else per_sample.withColumn("_m", F.lit(n_models))
    return joined.groupBy(*config).agg(
        F.count("*").alias("n"), F.count_if(F.col("_k") > 0).alias("n_any"), F.count_if(F.col("_k") == F.col("_m")).alias("n_all")
    )


def complementarity(cells: DataFrame, config: list[str], sample: str, model: str, flag: str, a: str, b: str, dirty: str | None = None) -> DataFrame:
    """AGG11, AGG12: how two models' passes overlap. With ``dirty``, samples
    dirty for both are left out, and a model fails what is dirty for it."""
    own = lambda m, c: F.bool_or(F.when(F.col(model) == m, F.col(c)))
    cols = [F.coalesce(own(a, flag), F.lit(False)).alias("_a"), F.coalesce(own(b, flag), F.lit(False)).alias("_b")]
    if dirty:
        cols += [F.coalesce(own(a, dirty), F.lit(False)).alias("_da"), F.coalesce(own(b, dirty), F.lit(False)).alias("_db")]
    rows = cells.filter(F.col(model).isin(a, b)).groupBy(*config, sample).agg(*cols)
    if dirty:
        rows = rows.filter(~(F.col("_da") & F.col("_db"))).withColumns({"_a": F.col("_a") & ~F.col("_da"), "_b": F.col("_b") & ~F.col("_db")})
    x, y = F.col("_a"), F.col("_b")
    return rows.groupBy(*config).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_only_a"),
        F.count_if(~x & y).alias("n_only_b"), F.count_if(~x & ~y).alias("n_neither"), F.count_if(x | y).alias("n_union"),
    )


def sweep(spark, eps: list[float], kappa: list[float]) -> DataFrame:
    """SRC12, JN3: the grid of two parameter lists (driver-side constants)."""
    return spark.createDataFrame([(e, k) for e in eps for k in kappa], "eps double, kappa double")


def series(steps: DataFrame, keys: list[str], x: str, values: list[str]) -> DataFrame:
    """SNK11: what a plot of trajectories needs: ``keys, x, series, y``, a row for
    each step and value; missing values have none."""
    return steps.unpivot([*keys, x], values, "series", "y").filter("y IS NOT NULL")
