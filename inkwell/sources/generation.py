"""SRC10: content items asked of a generator, as a data source.

    spark.dataSource.register(GenerationSource)
    spark.read.format("inkwell_generation").option("categories", "email,chat").option("n", 100).load()
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


@dataclass
class Asked(InputPartition):
    """One request: a task of its own."""

    category: str
    batch: int
    n: int


class GenerationReader(DataSourceReader):
    """Partitions by category and batch. A request that fails is made again, up to
    ``retries`` times, twice as long after each time; then the task fails, so
    that Spark may try it elsewhere, and after that the query. Nothing is left
    out silently: an answer without items is a row with its text."""

    def __init__(self, options: dict[str, str]):
        names = [c.strip() for c in options.get("categories", "").split(",") if c.strip()]
        self.categories = list(dict.fromkeys(names))
        self.n, self.size = int(options.get("n", "0")), int(options.get("batchsize", "10"))
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "1"))
        self.generator = options.get("generator", "echo")
        if not self.categories or self.size < 1:
            raise ValueError("the option categories must name some, and batchSize be at least 1")

    def partitions(self) -> Sequence[Asked]:
        starts = list(enumerate(range(0, self.n, self.size)))
        return [Asked(c, b, min(self.size, self.n - at)) for c in self.categories for b, at in starts]

    def read(self, partition: Asked | None) -> Iterator[tuple]:
        from ..operators.models import GENERATORS

        if not isinstance(partition, Asked):
            return
        with closing(GENERATORS[self.generator]()) as model:
            for attempt in range(self.retries + 1):
                try:
                    answer = model.generate(partition.category, partition.n)
                    break
                except Exception:
                    if attempt == self.retries:
                        raise
                    time.sleep(self.pause * 2**attempt)
        yield partition.category, partition.batch, partition.n, attempt + 1, answer


class PrunedReader(GenerationReader):
    """Only the categories that filters leave are asked for, as each request costs
    money."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("category",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.categories = [c for c in self.categories if c in wanted]
            else:
                yield f


class GenerationSource(DataSource):
    """Options: ``categories`` (comma-separated), ``n`` items of each,
    ``batchSize`` of one request, ``generator`` (a name in
    ``operators.models.GENERATORS``), ``retries``, ``pause`` in seconds, and
    ``pushdown``, true where ``spark.sql.python.filterPushdown.enabled`` is."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_generation"

    def schema(self) -> str:
        return "category string, batch int, n int, attempts int, answer string"

    def reader(self, schema) -> DataSourceReader:
        own = {k.lower(): v for k, v in self.options.items()}
        return (PrunedReader if own.get("pushdown", "").lower() == "true" else GenerationReader)(own)
