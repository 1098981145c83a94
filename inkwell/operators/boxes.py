"""Boxes of words: relational geometry. A box is half open, in pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import running_offsets


def letterbox(w: Column, h: Column, tw: int, th: int) -> dict[str, Column]:
    """GEO1: scale, new size (rounded half to even) and centring offsets."""
    scale = F.least(tw / w, th / h)
    nw, nh = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    return {"scale": scale, "nw": nw, "nh": nh, "ox": F.floor((tw - nw) / 2).cast("int"), "oy": F.floor((th - nh) / 2).cast("int")}


def moved(v: Column, scale: Column, offset: Column) -> Column:
    """GEO2: a coordinate scaled and shifted, truncated toward zero."""
    return (v * scale + offset).cast("int")


def words_with_boxes(lines: DataFrame, keys: list[str], char_px: int = 8, height: int = 12, pitch: int = 20) -> DataFrame:
    """WIN5, WIN6, JN4, ARR1: a box for every word of ``lines(keys, line,
    words)``: widths by characters, words one blank apart, lines one pitch apart."""
    lengths = F.transform("words", F.char_length)
    lines = lines.withColumn("_x0", running_offsets(lengths))
    begins = F.transform("_x0", lambda x: x * char_px)
    rows = lines.select(*keys, "line", F.posexplode(F.arrays_zip(F.col("words").alias("word"), begins.alias("x0"))).alias("pos", "b"))
    return rows.select(
        *keys, "line", "pos", F.col("b.word").alias("word"), F.col("b.x0").alias("x0"), (F.col("line") * pitch).cast("int").alias("y0"),
        (F.col("b.x0") + char_px * F.char_length("b.word")).cast("int").alias("x1"), (F.col("line") * pitch + height).cast("int").alias("y1"),
    )


def columns(texts: list[Column], weights: list[float], width: int, left: int, char_px: int = 8) -> Column:
    """GEO7: ``struct(text, x)`` of each column of a table row: widths in
    proportion, truncated; what equals the last column's text, if that is not
    empty, stands at the right."""
    px = [int(width * w / sum(weights)) for w in weights]
    begins = [left + sum(px[:i]) for i in range(len(px))]
    right = lambda t, i: F.lit(begins[i] + px[i] - 4) - char_px * F.char_length(t)
    x = [F.when((t == texts[-1]) & (t != ""), right(t, i)).otherwise(begins[i]).cast("int") for i, t in enumerate(texts)]
    return F.array(*[F.struct(t.alias("text"), at.alias("x")) for t, at in zip(texts, x, strict=True)])


def overlap(a: str, b: str) -> Column:
    """JN6: boxes of aliases a and b share a pixel."""
    return F.expr(f"{a}.x0 < {b}.x1 AND {a}.x1 > {b}.x0 AND {a}.y0 < {b}.y1 AND {a}.y1 > {b}.y0")


def overlapping_boxes(boxes: DataFrame, keys: list[str], size: int = 256, crowd: int = 256, finer: int = 16) -> DataFrame:
    """JN6: pairs of boxes, as aliases a and b, of one image (``keys``) that
    share a pixel, each pair both ways and each box with itself.

    Boxes meet in the square cells that they touch, and a pair counts in the cell
    of the corner where its common pixels begin. A cell that more than ``crowd``
    boxes touch is divided into ``finer`` by ``finer`` parts, so that boxes which
    crowd one cell without overlapping are not paired. Empty boxes and those
    with a null side are nowhere."""

    def cells(df: DataFrame, low: Column, high: Column, name: str, side: Column) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.floor(low / side), F.floor((high - 1) / side))))

    small = F.lit(size // finer)
    rows = boxes.filter("x0 < x1 AND y0 < y1")
    coarse = cells(cells(rows, F.col("x0"), F.col("x1"), "_cx", F.lit(size)), F.col("y0"), F.col("y1"), "_cy", F.lit(size))
    place = [*keys, "_cx", "_cy"]
    crowded = coarse.groupBy(*place).count().filter(F.col("count") > crowd).drop("count").withColumn("_fine", F.lit(True))
    dealt = coarse.join(crowded, place, "left").withColumn("_fine", F.coalesce("_fine", F.lit(False)))
    # Of a crowded cell a box goes to those parts that it touches.
    side = F.when(F.col("_fine"), small).otherwise(F.lit(size))
    for c, v in (("_cx", "x"), ("_cy", "y")):
        low, high = F.greatest(F.col(f"{v}0"), F.col(c) * size), F.least(F.col(f"{v}1"), (F.col(c) + 1) * size)
        dealt = cells(dealt, low, high, f"_{v}", side)
    dealt = dealt.drop("_cx", "_cy")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "_fine", "_x", "_y")]
    step = F.when(F.col("a._fine"), small).otherwise(F.lit(size))
    first = [F.floor(F.greatest(F.col(f"a.{v}0"), F.col(f"b.{v}0")) / step) == F.col(f"a._{v}") for v in "xy"]
    return dealt.alias("a").join(dealt.alias("b"), on).filter(overlap("a", "b") & first[0] & first[1])


def centre_distance(a: str, b: str) -> Column:
    """GEO4."""
    return F.expr(f"sqrt(pow(({a}.x0 + {a}.x1) / 2.0 - ({b}.x0 + {b}.x1) / 2.0, 2) + pow(({a}.y0 + {a}.y1) / 2.0 - ({b}.y0 + {b}.y1) / 2.0, 2))")


def same_row(a: str, b: str) -> Column:
    """GEO4: centres less than one and a half heights apart, by the higher box."""
    return F.expr(f"abs(({a}.y0 + {a}.y1) / 2.0 - ({b}.y0 + {b}.y1) / 2.0) < 1.5 * greatest({a}.y1 - {a}.y0, {b}.y1 - {b}.y0, 1)")


def near_pairs(boxes: DataFrame, key: str, radius: int, of: Column | None = None) -> DataFrame:
    """JN7: pairs of boxes of one image whose centres are within ``radius``, each
    with itself; with ``of`` the first of a pair is one of those boxes. Boxes meet in cells of twice the radius: a box looks into those
    that its circle touches, four at most, so a large image is not paired in
    full."""
    cell = 2 * radius
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    at = lambda v: F.floor(v / cell)
    reach = lambda v: F.sequence(at(v - radius), at(v + radius))
    a = boxes if of is None else boxes.filter(of)
    a = a.withColumn("gx", F.explode(reach(x))).withColumn("gy", F.explode(reach(y))).alias("a")
    b = boxes.withColumn("gx", at(x)).withColumn("gy", at(y)).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "gx", "gy")]
    dx, dy = (F.expr(f"a.{v}0 + a.{v}1 - b.{v}0 - b.{v}1") for v in "xy")  # twice the distance
    return a.join(b, on).filter(dx * dx + dy * dy <= 4 * radius * radius)


def near_index(centres: np.ndarray, radius: float, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the centres within ``radius``, each with itself, by the
    first. Centres are sorted by cells as wide as the radius; the neighbours of
    a cell in one row of cells are one stretch, found by bisection."""
    cell = np.floor(centres / radius).astype(np.int64)
    cell -= cell.min(0, initial=0)
    width = cell[:, 0].max(initial=0) + 3
    key = cell[:, 1] * width + cell[:, 0]
    order = np.argsort(key, kind="stable")
    ranked, out = key[order], [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(0, len(key), at_once):
        rows, cols = [], []
        for up in (-width, 0, width):
            low, high = np.searchsorted(ranked, key[i : i + at_once] + up - 1, "left"), np.searchsorted(ranked, key[i : i + at_once] + up + 1, "right")
            n = high - low
            row = np.repeat(np.arange(len(n)), n)
            col = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            good = ((centres[row + i] - centres[col]) ** 2).sum(1) <= radius * radius
            rows.append(row[good] + i)
            cols.append(col[good])
        row, col = np.concatenate(rows), np.concatenate(cols)
        sort = np.lexsort((col, row))
        out.append((row[sort], col[sort]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def context_lists(boxes: DataFrame, key: str, radius: float, ident: str, keep: tuple[str, ...]) -> DataFrame:
    """GEO5: ``key, keep, near``: of each box the sorted ``ident`` (a long) of all
    boxes of its image whose centres are within ``radius``, its own included.
    One image's boxes are bounded, so each image is one call and boxes are
    shuffled once; ``near_pairs`` is the same as a join."""
    kinds = dict(boxes.dtypes)
    corners = ("x0", "y0", "x1", "y1")

    def near(table: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (table.column(c).to_numpy().astype(float) for c in corners)
        own = table.column(ident).to_numpy()
        row, col = near_index(np.stack([(x0 + x1) / 2, (y0 + y1) / 2], 1), radius)
        found = own[col]
        found = found[np.lexsort((found, row))]
        offsets = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
        return pa.table([*(table.column(c) for c in (key, *keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], names=[key, *keep, "near"])

    rows = boxes.select(*dict.fromkeys((key, *keep, ident, *corners)))
    return rows.groupBy(key).applyInArrow(near, ", ".join(f"{c} {kinds[c]}" for c in (key, *keep)) + ", near array<long>")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], low: str, high: str, cell: int) -> DataFrame:
    """JN6, JN8: pairs of intervals ``low`` to ``high`` (half open) of aliases a
    and b with equal ``keys`` that overlap, each once. Intervals meet in the cells
    they touch; a pair counts in the first cell that both touch."""

    def dealt(df: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell))
        return df.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells)).alias(name)

    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "_cell")]
    meet = (F.col(f"a.{low}") < F.col(f"b.{high}")) & (F.col(f"b.{low}") < F.col(f"a.{high}"))
    first = F.floor(F.greatest(F.col(f"a.{low}"), F.col(f"b.{low}")) / cell) == F.col("a._cell")
    return dealt(a, "a").join(dealt(b, "b"), on).filter(meet & first)


def section_boundaries(words: DataFrame, key: str, is_header: Column, is_other: Column) -> DataFrame:
    """STR18: the rows of ``words`` that are headers with no other kind of word
    on their row (``is_other`` says what breaks a header). Of what breaks
    headers each height counts once, so a row of words is one row here."""
    a, b = words.filter(is_header).alias("a"), words.filter(is_other).select(key, "y0", "y1").distinct().alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & same_row("a", "b"), "left_anti")
