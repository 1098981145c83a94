"""Exact top-k inner products by a Voronoi kNN join.

Queries and data alike are grouped by their nearest pivot. A summary of each
group (its rows, the greatest distance to its pivot, the distances of the few
rows next to it) bounds what any query of one group scores with any row of
another, by Cauchy and Schwarz: from below, so that the k-th greatest of these
bounds is what the k best of every query of a group reach at least, and from
above, so that data groups that can't reach it are not sent there. Of the others
a row is sent if its own distance to its pivot allows it. Each group of queries is
solved locally, in blocks of rows. No bound takes a product of a query and a row.
(In distances: with one more component, sqrt(M - |x|^2), the greatest products
are the nearest neighbours, and the bounds are those of the balls around the
pivots.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Pivots at most; there are as many as the root of the number of rows.
PIVOTS = 1024
#: Queries of one team and vectors of one block at most (on average, by hash);
#: blocks of fewer rows are not made for the sake of more tasks.
TEAM_QUERIES, BLOCK_ROWS, LEAST_BLOCK = 2048, 32_768, 1024
#: Vectors that are bounded, and queries that are scored, at once.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 128
#: Relative error allowed for in bounds, which are computed in doubles.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component x, whole numbers held as
    doubles (exact, and without the bounds of a long). Vectors that are null, or
    hold null or non-finite components, are left out, as are empty ones."""
    x = F.col("e")
    good = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    down = lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(F.when(F.abs(c * scale) < 2.0**53, c * scale)).cast("double")).otherwise(c * scale)
    return rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, down).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def scores_of(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, held at the ends of the
    range of a long: in doubles where no sum can leave their exact range, in
    Python's integers for the rows where one could."""
    out = np.empty((len(asked), len(x)), np.int64)
    big_q, big_x = (np.abs(m).max(1, initial=0) for m in (asked, x))
    least = max(1.0, big_x.max(initial=0))
    plain = big_q * least * max(1, x.shape[1]) < 2.0**53
    with np.errstate(over="ignore", invalid="ignore"):
        out[plain] = (asked[plain] @ x.T).astype(np.int64)
    for i in np.flatnonzero(~plain):
        fine = big_q[i] * big_x * x.shape[1] < 2.0**53
        out[i, fine] = (x[fine] @ asked[i]).astype(np.int64)
        own = [int(c) for c in asked[i]]
        for j in np.flatnonzero(~fine):
            total = sum(a * int(b) for a, b in zip(own, x[j], strict=True))
            out[i, j] = max(-LONGEST, min(LONGEST, total))
    return out


class Groups:
    """Bounds between groups of queries (rows) and of data (columns), from the
    pivots, the queries' greatest distances to them (minus infinity where a group
    has none) and the data's summary: greatest distances and, in ``near``, the
    distances of those next to the pivot, infinite where there are no more.

    ``bar`` is what the k best of each query reach at least; one of the k + 1 bounds
    may be the query's own."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, wide: np.ndarray, near: np.ndarray, k: int):
        with np.errstate(all="ignore"):
            size = np.sqrt((pivots * pivots).sum(1))
            slack = 1 + SLACK
            self.middle, self.grow = pivots @ pivots.T, (size + radius) * slack
            self.reach = radius[:, None] * size[None, :] * slack + SLACK * (1 + np.outer(size, size))
            self.bar = np.full(len(pivots), -np.inf)
            for q in np.flatnonzero(radius >= 0):
                low = (self.middle[q] - self.reach[q])[:, None] - self.grow[q] * near
                low = np.sort(np.nan_to_num(low, nan=-np.inf), axis=None)
                self.bar[q] = low[-k - 1] if low.size > k else -np.inf
            # Scores that are held at an end of the long range tie there.
            self.bar = np.where(self.bar > -0.99 * LONGEST, np.minimum(self.bar, 0.99 * LONGEST), -np.inf)
            self.asked = np.flatnonzero(radius >= 0)
            # Groups of data that are needed at all, by queries' group.
            self.open = self.needed(np.arange(len(pivots)), wide) & (wide >= 0)[:, None]

    def needed(self, cell: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether rows of data at distance ``far`` from the pivots ``cell`` can be
        among the best of a query of each group that has any."""
        with np.errstate(all="ignore"):
            q = self.asked
            high = (self.middle[q][:, cell] + self.reach[q][:, cell] + self.grow[q][:, None] * far * (1 + SLACK)).T
            return ~(high < self.bar[q])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` greatest integer inner products of each query with every other
    row of ``vectors(vec_id long, v array<double>)`` of whole numbers; ties go to
    the smaller vec_id. Returns ``query_id, rank, vec_id, score``.

    ``is_query`` says which rows are queries. A query's own rows are those with
    its vec_id; rows with a null id take no part; repeated rows of the data are
    rows each, repeated queries are one. Scores are exact; one beyond the range
    of a long is held at its end, where it ties. Vectors of another length than
    most take no part with the rest: lengths are solved apart. Fewer rows than k
    give all of them; an empty table gives none. Other columns are not read.
    Pivots are a sample of all rows by hash, and only the pace depends on them.
    What is broadcast or gathered has a size set by PIVOTS and k.
    """
    rows = vectors.filter("vec_id IS NOT NULL").withColumn("asks", F.coalesce(is_query, F.lit(False)))
    rows = checkpointed(rows.select("vec_id", "v", "asks", F.size("v").alias("_n")))
    sizes = [r[0] for r in rows.filter("asks").select("_n").distinct().sort("_n").collect()]
    schema = "query_id long, rank int, vec_id long, score long"
    parts = [_top_k(rows.filter(F.col("_n") == n).drop("_n"), k) for n in sizes]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def _grouped(rows: DataFrame, k: int) -> tuple[DataFrame, Groups, np.ndarray, np.ndarray]:
    """``vec_id, v, asks, mixed, cell, far`` of all rows, the bounds of their groups,
    and the rows of data and queries in each."""
    share = rows.sparkSession.sparkContext.broadcast
    mixed = F.xxhash64("vec_id", "v")
    n = rows.count()
    wanted = min(PIVOTS, max(1, int(n**0.5)))
    likely = F.pmod(mixed, F.lit(1 << 30)) <= F.lit(int(min(1, 4 * wanted / n) * (1 << 30)))
    drawn = rows.filter(likely).select("v", "vec_id").orderBy(mixed).limit(wanted).collect() or rows.select("v").limit(1).collect()
    pivots = np.unique(np.array([r[0] for r in drawn], float), axis=0)
    with np.errstate(all="ignore"):
        at = share((pivots, (pivots * pivots).sum(1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, size = at.value
        for batch in _blocks(batches):
            x = _matrix(batch.column(1))
            with np.errstate(all="ignore"):
                cell = (size[None, :] - 2 * (x @ p.T)).argmin(1)
                far = np.nan_to_num(np.sqrt(((x - p[cell]) ** 2).sum(1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "asks", "mixed", "cell", "far"])

    placed = rows.select("vec_id", "v", "asks", mixed.alias("mixed"))
    placed = checkpointed(placed.mapInArrow(assign, "vec_id long, v array<double>, asks boolean, mixed long, cell int, far double"))
    radius, wide, near = np.full(len(pivots), -np.inf), np.full(len(pivots), -np.inf), np.full((len(pivots), k + 1), np.inf)
    asked, held = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    sums = placed.groupBy("cell").agg(F.count("*"), F.max("far"), F.count_if("asks"), F.max(F.when(F.col("asks"), F.col("far"))))
    for cell, n_rows, far, n_asked, far_asked in sums.collect():
        held[cell], wide[cell], asked[cell] = n_rows, far, n_asked
        radius[cell] = -np.inf if far_asked is None else far_asked
    # An id counts once, wherever its rows lie, as they may all be a query's own.
    # The nearest of a group are found in parts first, so no group is sorted as one.
    once = placed.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("m")).select("m.cell", "m.far", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part"))
    for keys in (("cell", "part"), ("cell",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("far"))
        once = once.withColumn("place", place).filter(F.col("place") <= k + 1)
    for cell, far, place in once.select("cell", "far", "place").collect():
        near[cell, place - 1] = far
    return placed, Groups(pivots, radius, wide, near, k), held, asked


def replicas(vectors: DataFrame, is_query: Column, k: int = 20) -> tuple[float, float]:
    """How much the bounds spare: the share of (row, group of queries) pairs that
    is needed, by whole groups and by rows, of ``vectors`` of one length."""
    rows = vectors.filter("vec_id IS NOT NULL").withColumn("asks", F.coalesce(is_query, F.lit(False)))
    placed, groups, held, _ = _grouped(rows.select("vec_id", "v", "asks"), k)
    bounds = rows.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(bounds.value.needed(batch.column(0).to_numpy(), batch.column(1).to_numpy()).sum())])], ["n"])

    pairs = held.sum() * len(groups.asked)
    return float((held[:, None] * groups.open).sum() / pairs), placed.select("cell", "far").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] / pairs


def _top_k(rows: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    placed, groups, held, asked = _grouped(rows, k)
    asking = placed.filter("asks").select("vec_id", "v", F.xxhash64("v").alias("mark"), "cell").distinct()
    bounds = spark.sparkContext.broadcast(groups)
    used = groups.asked
    number = np.full(len(held), -1)
    number[used] = np.arange(len(used))

    # Groups of queries next to each other, seen from the first, make up a team, to
    # which a row goes once; a team with very many queries is divided.
    away = np.argsort(-groups.middle[used[0]][used] * 2 + np.diag(groups.middle)[used], kind="stable")
    team_of, load, splits = np.zeros(len(used), np.int64), 0, []
    for c in away:
        n = int(asked[used[c]])
        if not splits or load + n > TEAM_QUERIES:
            load, splits = 0, [*splits, 1]
        load += n
        splits[-1] = max(splits[-1], -(-n // TEAM_QUERIES))
        team_of[c] = len(splits) - 1
    starts = np.searchsorted(team_of[away], np.arange(len(splits)))
    splits = np.array(splits)
    sent = (held[:, None] * np.logical_or.reduceat(groups.open[:, away], starts, axis=1)).sum(0)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions")) // int(splits.sum())
    blocks = np.maximum(np.maximum(1, -(-sent // BLOCK_ROWS)), np.minimum(spread, sent // LEAST_BLOCK))
    first = np.r_[0, np.cumsum(splits * blocks)]

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            needed = bounds.value.needed(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            row, team = np.nonzero(np.logical_or.reduceat(needed[:, away], starts, axis=1))
            chunk = first[team] + batch.column(2).to_numpy()[row] % blocks[team]
            for g in range(int(splits[team].max(initial=0))):
                at = splits[team] > g
                take = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array((chunk + g * blocks[team])[at]), *(batch.column(i).take(take) for i in (0, 1, 3, 4))], ["chunk", "vec_id", "v", "cell", "far"])

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            team = team_of[number[batch.column(3).to_numpy()]]
            begin, n = first[team] + batch.column(2).to_numpy() % splits[team] * blocks[team], blocks[team]
            chunk = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(chunk), *(batch.column(i).take(take) for i in (0, 1, 2, 3))], ["chunk", "vec_id", "v", "mark", "cell"])

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}).astype("int64")]
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            x, ids = np.stack(right["v"].to_numpy()).astype(np.float64), right["vec_id"].to_numpy()
            group = number[left["cell"].to_numpy()]
            needed = bounds.value.needed(right["cell"].to_numpy(), right["far"].to_numpy())
            # Groups that need most rows take all of them together, others their own.
            most = needed.mean(0) > 0.5
            for own in [np.flatnonzero(most), *([c] for c in np.unique(group) if not most[c])]:
                mine = left[np.isin(group, own)]
                rows = slice(None) if len(own) != 1 else needed[:, own[0]]
                out += solved(mine, x[rows], ids[rows])
        return pd.concat(out)

    def solved(asking: pd.DataFrame, x: np.ndarray, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(asking) if len(ids) else 0, QUERIES_AT_ONCE):
            part = asking.iloc[i : i + QUERIES_AT_ONCE]
            asked, marks = part["vec_id"].to_numpy(), part["mark"].to_numpy()
            scores = scores_of(np.stack(part["v"].to_numpy()).astype(np.float64), x)
            scores[asked[:, None] == ids[None, :]] = -LONGEST - 1  # which no score is
            take = min(k, len(ids))
            # everything at least as good as the k-th, so that ties are seen
            floor = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
            for q, (row, low) in enumerate(zip(scores, floor, strict=True)):
                at = np.flatnonzero((row >= low) & (row > -LONGEST - 1))
                at = at[np.argsort(-row[at], kind="stable")][:k]
                yield pd.DataFrame({"query_id": asked[q], "mark": marks[q], "vec_id": ids[at], "score": row[at]})

    schema = "chunk long, vec_id long, v array<double>"
    keyed = asking.mapInArrow(send_queries, f"{schema}, mark long, cell int").groupBy("chunk")
    data = placed.select("vec_id", "v", "mixed", "cell", "far").mapInArrow(send_data, f"{schema}, cell int, far double")
    found = keyed.cogroup(data.groupBy("chunk")).applyInPandas(solve, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
