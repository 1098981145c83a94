"""Sinks: logs, banks, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from enum import Enum
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines_and_array(rows: DataFrame, folder: str, mode: str = "labels", by: str | None = None) -> None:
    """SNK1, SNK2: JSON lines, and the same rows as JSON arrays, one per file,
    written as they stream by; ``by`` gives each of its values a folder."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_ = object(), False
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, line in zip(keys, batch.column(1).to_pylist(), strict=True):
                if open_ and k != own:
                    out.append((own, "]"))
                    open_ = False
                out.append((k, ("," if open_ else "[") + line))
                own, open_ = k, True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["key", "value"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array(["]"])], ["key", "value"])

    lines = rows.write.mode("overwrite")
    (lines.partitionBy(by) if by else lines).json(f"{folder}/{mode}.jsonl")
    key = F.col(by).cast("string") if by else F.lit("all")
    arrays = rows.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))
    if by:
        arrays = arrays.sortWithinPartitions("key")
    text = arrays.mapInArrow(bracketed, "key string, value string")
    if by:
        text.withColumnRenamed("key", by).write.mode("overwrite").partitionBy(by).text(f"{folder}/{mode}.json")
    else:
        text.select("value").write.mode("overwrite").text(f"{folder}/{mode}.json")


def append_results(rows: DataFrame, path: str) -> None:
    """SNK3: with the time of writing."""
    stamped = rows.withColumn("_timestamp", F.unix_micros(F.current_timestamp()) / 1e6)
    stamped.write.mode("append").json(path)


def append_event(spark, path: str, event: str, **fields) -> None:
    """SNK4: one event row in the same log."""
    row = spark.createDataFrame([(json.dumps(serialisable(fields)),)], "j string")
    kinds = ", ".join(f"{k} string" for k in fields) or "_none string"
    append_results(row.select(F.lit(event).alias("_event"), F.from_json("j", kinds).alias("f")).select("_event", *[f"f.{k}" for k in fields]), path)


def trajectory_name(image: Column, eps: Column, kappa: Column) -> Column:
    """SNK5: the name of a run's document."""
    return F.format_string("%s_eps%.5f_k%.5f.json", image, eps, kappa)


def write_trajectories(steps: DataFrame, path: str, order: str = "step") -> None:
    """SNK5: one nested document per run, steps in order."""
    keys = ["image_id", "epsilon", "kappa"]
    rest = [c for c in steps.columns if c not in keys and c != order]
    docs = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("steps"))
    named = docs.withColumn("name", trajectory_name(F.col("image_id"), F.col("epsilon"), F.col("kappa")))
    named.write.mode("overwrite").json(path)


def serialisable(value):
    """SNK7: paths, enumerations and tuples as JSON has them."""
    if isinstance(value, dict):
        return {str(k): serialisable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [serialisable(v) for v in value]
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, Path):
        return str(value)
    return value


def snapshot(config: dict, path: str) -> None:
    """SNK6: the configuration, before any result (on the driver)."""
    Path(path).write_text(json.dumps(serialisable(config), indent=2))


def save_category(rows: DataFrame, path: str, category: str) -> None:
    """SNK8: one category's items; a crash later loses nothing of it."""
    rows.write.mode("overwrite").json(f"{path}/category={category}")


def write_patched(rows: DataFrame, source: str, target: str, dry_run: bool = False) -> bool:
    """SNK9: to a path other than the source; nothing on a dry run."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a bank can't be overwritten while it is read")
    if not dry_run:
        rows.write.mode("overwrite").json(target)
    return not dry_run


def write_report(rows: DataFrame, path: str, text: str = "line") -> None:
    """SNK10."""
    rows.select(text).write.mode("overwrite").text(path)
