"""Query name -> Spark function, and DuckDB SQL, of the analytics operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .plans import checks, content, geometry, importance, masks, profile, results, scores, sequences, text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
