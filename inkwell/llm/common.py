"""Shared pieces of the training-data operators: checkpoint folder, Arrow
batches, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that are worked on at once.
BATCH_CHARS = 1_000_000
#: The setting for rows of an Arrow batch, its default, and what whole texts need:
#: batches are held by Spark's writer and reader and by Python at a time.
ARROW_ROWS, DEFAULT_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 512


def prepare(spark: SparkSession) -> None:
    """Sees to small Arrow batches and a checkpoint folder.

    Where the session has Spark's default of 10,000 rows a batch, that is put to
    512, the only session setting that is changed; any other number is the
    user's own and stays. On a cluster the folder must be a shared one, named in
    ``spark.checkpoint.dir``; without one a temporary folder serves where driver
    and executors are one machine, and anything else raises.
    """
    if spark.conf.get(ARROW_ROWS) == DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows a batch for the actions within."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(column: pa.Array, size: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column in order, in lists of about ``size`` bytes,
    each with the number of its first row, so that a batch of long texts is not
    held twice; null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signature(edges: DataFrame) -> tuple:
    """Count and order-free hash of the rows of ``edges``."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges(u long, v long)``.

    Alternates large-star and small-star steps, each a pre-aggregated minimum
    and an equi-join that AQE may split, until every component is a star
    around its smallest node; the rounds grow with the logarithm of the
    longest path. Returns ``node, component`` for all nodes but the roots
    themselves, whose component is their own id. Rows with a null end and
    self loops are left out; repeated rows count once; an empty table gives an
    empty table.
    """
    edges = checkpointed(
        edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(
            both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(
            large.join(lowest, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
