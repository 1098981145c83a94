"""MTH16, MTH17: image gradients and strokes. A picture is a table of its rows of
pixels, worked on in tiles that bring their neighbours' edges along, so it may
have any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of tiles that are worked on together.
AT_ONCE = 1 << 18


def sobel(grid: np.ndarray) -> np.ndarray:
    """Edge magnitude within a border of one pixel; what is no pixel (NaN) is 0.
    The last two axes are a grid's."""
    p = np.nan_to_num(grid, nan=0.0)
    n, m = grid.shape[-2] - 2, grid.shape[-1] - 2
    at = lambda i, j: p[..., i : i + n, j : j + m]
    gx = at(0, 2) + 2 * at(1, 2) + at(2, 2) - at(0, 0) - 2 * at(1, 0) - at(2, 0)
    gy = at(2, 0) + 2 * at(2, 1) + at(2, 2) - at(0, 0) - 2 * at(0, 1) - at(0, 2)
    return np.sqrt(gx * gx + gy * gy)


def strokes(grid: np.ndarray, sharpness: float = 20.0, level: float = 0.7) -> np.ndarray:
    """Soft darkness, then the greatest of each 3 x 3 neighbourhood, within a
    border of one pixel; what is no pixel (NaN) counts for nothing. The last two
    axes are a grid's."""
    dark = np.nan_to_num(1 - 1 / (1 + np.exp(-sharpness * (grid - level))), nan=-np.inf)
    n, m = grid.shape[-2] - 2, grid.shape[-1] - 2
    return np.max([dark[..., i : i + n, j : j + m] for i in range(3) for j in range(3)], axis=0)


def tiled(rows: DataFrame, image: str, y: str, layers: tuple[str, ...], height: int, width: int) -> DataFrame:
    """``image, ty, tx, y, x, layers``: the pieces of rows ``image, y, layers`` (of
    one layer all pixels of a row) that tiles of ``height`` by ``width`` need, one
    pixel of their neighbours on each side included; ``x`` is where a piece
    begins. A row goes to the tiles of the rows next to it."""
    n = F.array_max(F.array(*[F.size(c) for c in layers]))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(y) + d) / height)))
    found = rows.withColumn("_n", n).filter("_n > 0").withColumn("ty", F.explode(near))
    found = found.withColumn("tx", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {int(width)} as int)"))))
    found = found.withColumn("x", F.greatest(F.col("tx") * width - 1, F.lit(0)))
    piece = [F.slice(c, F.col("x") + 1, (F.col("tx") + 1) * width + 1 - F.col("x")).alias(c) for c in layers]
    return found.select(image, "ty", "tx", F.col(y).cast("long").alias("y"), "x", *piece)


def differences(rows: DataFrame, image: str, y: str, a: str, b: str, costs: dict[str, Callable[[np.ndarray], np.ndarray]], height: int = 256, width: int = 256) -> DataFrame:
    """``image, n`` and, by the names of ``costs``, the mean of ``abs(f(a) - f(b))``
    over the pixels of each picture, whose rows are ``image, y, a, b``: arrays of
    equal length in each row, ``y`` distinct within a picture. Rows that don't
    exist, null ones and null pixels are no pixels. Tiles come sorted, so a task
    holds a batch of their rows and the grids of about ``AT_ONCE`` pixels, or of
    one tile, whatever the number and size of pictures."""
    kind = dict(rows.dtypes)[image]
    names, place = list(costs), [image, "ty", "tx"]

    def cost(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole tiles."""
        starts = _starts(t, place)
        tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
        y, x, ty, tx = (t.column(c).to_numpy() for c in ("y", "x", "ty", "tx"))
        line, at = y - ty * height + 1, x - tx * width + 1
        some = max(1, AT_ONCE // ((height + 2) * (width + 2)))
        for i in range(0, len(starts), some):
            begin, stop = starts[i], starts[i + some] if i + some < len(starts) else len(t)
            grids = np.full((2, min(some, len(starts) - i), height + 2, width + 2), np.nan)
            for grid, c in zip(grids, ("_a", "_b"), strict=True):
                values = t.column(c).slice(begin, stop - begin).combine_chunks()
                counts = pc.fill_null(pc.list_value_length(values), 0).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(begin, stop), counts)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                grid[tile[row] - i, line[row], at[row] + inside] = values.flatten().to_numpy(zero_copy_only=False).astype(float)
            pixels = ~np.isnan(grids[..., 1:-1, 1:-1]).any(0)
            with np.errstate(invalid="ignore"):
                sums = [np.where(pixels, np.abs(f(grids[0]) - f(grids[1])), 0.0).sum((1, 2)) for f in costs.values()]
            own = t.column(image).take(pa.array(starts[i : i + some])).combine_chunks()
            yield pa.RecordBatch.from_arrays([own, pa.array(pixels.sum((1, 2)).astype(np.int64)), *map(pa.array, sums)], names=[image, "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            left = pa.concat_tables([left, now]).combine_chunks() if left is not None else now
            if len(left) and (last := int(_starts(left, place)[-1])):
                yield from cost(left.slice(0, last))
                left = left.slice(last)
        if left is not None and len(left):
            yield from cost(left)

    pieces = tiled(rows.select(image, y, F.col(a).cast("array<double>").alias("_a"), F.col(b).cast("array<double>").alias("_b")), image, y, ("_a", "_b"), height, width)
    tiles = pieces.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, f"`{image}` {kind}, n long, " + ", ".join(f"{c} double" for c in names))
    return tiles.groupBy(image).agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in names]).filter("n > 0")


def _starts(t: pa.Table, place: list[str]) -> np.ndarray:
    """Where another tile begins in sorted rows."""
    codes = [t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in place]
    codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy(zero_copy_only=False) for c in codes]
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))) if len(t) else np.empty(0, np.int64)
