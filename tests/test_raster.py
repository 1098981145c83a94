"""Runs against pixels."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import boxes as box_ops
from inkwell.operators import grids, raster

RNG = random.Random(3)
BOXES = "image long, pos int, x0 int, y0 int, x1 int, y1 int, s double, tx string"


def some(n, reach=900):
    rows = []
    for pos in range(n):
        x, y = RNG.randrange(-20, reach), RNG.randrange(-20, 200)
        w, h = RNG.choice([(0, 5), (30, 8), (1, 1), (700, 3), (5, 150), (60, 60)])
        rows.append((RNG.choice([None, 1, 2]), pos, x, y, x + w, y + h, RNG.choice([None, 0.0, *range(-2, 9)]), "t"))
    return [r[:6] + (None if r[6] is None else float(r[6]),) + r[7:] for r in rows]


def pixels(rows):
    found = defaultdict(lambda: float("-inf"))
    for image, _, x0, y0, x1, y1, s, _ in rows:
        if s is not None:
            for y in range(y0, y1):
                for x in range(x0, x1):
                    found[image, x, y] = max(found[image, x, y], s)
    return found


@pytest.mark.parametrize("records", ["10000", "9"])
def test_painted(spark, records):
    rows = some(120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        boxes = spark.createDataFrame(rows, BOXES)
        runs = raster.painted(boxes, ["image"], "s").collect()
        sums = {tuple(r[:5]): (r.total, r.area) for r in raster.region_sums(boxes, ["image"], "s").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, got = pixels(rows), {}
    for r in runs:
        for y in range(r.y0, r.y1):
            for x in range(r.x0, r.x1):
                assert (r.image, x, y) not in got
                got[r.image, x, y] = r.score
    assert got == want
    for image, _, x0, y0, x1, y1, s, _ in rows:
        if s is not None and x0 < x1 and y0 < y1:
            total, area = sums[image, x0, y0, x1, y1]
            assert area == (x1 - x0) * (y1 - y0)
            assert total == pytest.approx(sum(want[image, x, y] for y in range(y0, y1) for x in range(x0, x1)))


def test_clipped_and_empty(spark):
    rows = [(1, 0, -5, -5, 3, 3, 1.0, ""), (1, 1, 8, 8, 30, 30, 1.0, ""), (1, 2, 12, 0, 15, 5, 1.0, ""), (1, 3, 4, 4, 4, 9, 1.0, "")]
    got = raster.clipped(spark.createDataFrame(rows, BOXES), F.lit(10), F.lit(9), 2).orderBy("pos").collect()
    assert [tuple(r[2:6]) for r in got] == [(0, 0, 5, 5), (6, 6, 10, 9)]
    none = spark.createDataFrame([], BOXES)
    assert raster.painted(none, ["image"], "s").count() == raster.region_sums(none, ["image"], "s").count() == 0


def test_a_million_pixels_and_a_hot_tile(spark):
    """A wide box is a row for each tile; a tile with very many boxes is carried
    along as runs."""
    wide = spark.createDataFrame([(1, 0, 0, 0, 1_000_000, 1000, 2.0, "")], BOXES)
    assert raster.painted(wide, ["image"], "s").agg(F.sum(F.expr("cast(x1 - x0 as long) * (y1 - y0)"))).first()[0] == 10**9
    hot = spark.range(60_000).selectExpr("1L AS image", "cast(id % 40 as int) AS x0", "0 AS y0", "cast(id % 40 + 5 as int) AS x1", "cast(1 + id % 7 as int) AS y1", "id / 1D AS s")
    got = {(x, r.y0): r.score for r in raster.painted(hot, ["image"], "s").collect() for x in range(r.x0, r.x1)}
    assert len(got) == 44 * 7 and got[43, 6] == max(i for i in range(60_000) if i % 40 == 39 and i % 7 == 6)


def test_overlapping_boxes(spark):
    rows = [r for r in some(150) if r[0]] + [(3, 1000 + i, 10, 3 * i, 12, 3 * i + 2, 1.0, "") for i in range(900)] + [(3, 3000, 0, 0, 500, 2700, 1.0, "")]
    pairs = box_ops.overlapping_boxes(spark.createDataFrame(rows, BOXES), ["image"]).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).collect()
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])]
    assert sorted(map(tuple, pairs)) == sorted(want)


def test_crowded_cells_are_divided(spark):
    """60,000 boxes of one column of cells that don't overlap: the join makes
    some pairs for each, not all of a cell."""
    crowd = spark.range(60_000).selectExpr("1L AS image", "id AS pos", "cast(id % 64 * 4 as int) AS x0", "cast(id div 64 * 4 as int) AS y0", "cast(id % 64 * 4 + 3 as int) AS x1", "cast(id div 64 * 4 + 3 as int) AS y1")
    pairs = box_ops.overlapping_boxes(crowd, ["image"])
    assert pairs.count() == 60_000


def plain_costs(a, b):
    def at(p, y, x, none):
        return p[y][x] if 0 <= y < len(p) and 0 <= x < len(p[0]) else none

    def sobel(p, y, x):
        k = [(dy, dx, at(p, y + dy, x + dx, 0.0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return math.hypot(sum(dx * (2 - abs(dy)) * v for dy, dx, v in k), sum(dy * (2 - abs(dx)) * v for dy, dx, v in k))

    def stroke(p, y, x):
        near = [at(p, y + dy, x + dx, None) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return max(1 - 1 / (1 + math.exp(-20 * (v - 0.7))) for v in near if v is not None)

    cells = [(y, x) for y in range(len(a)) for x in range(len(a[0]))]
    return [sum(abs(f(a, *c) - f(b, *c)) for c in cells) / len(cells) for f in (sobel, stroke)]


@pytest.mark.parametrize("tile", [(256, 256), (4, 5), (1, 1), (7, 64)])
def test_stencils(spark, tile):
    """The same costs whatever the tiles."""
    rows, want = [], {}
    for image, (h, w) in enumerate([(1, 1), (9, 13), (20, 6), (2, 64)]):
        a, b = ([[RNG.random() for _ in range(w)] for _ in range(h)] for _ in "ab")
        rows += [(image, y, a[y], b[y], "z") for y in range(h)]
        want[image] = [h * w, *plain_costs(a, b)]
    rows += [(7, 0, None, None, "z"), (8, 0, [], [], "z")]
    df = spark.createDataFrame(rows, "image long, y int, a array<double>, b array<double>, x string")
    got = {r.image: [r.n, r.edge, r.stroke] for r in grids.differences(df, "image", "y", "a", "b", {"edge": grids.sobel, "stroke": grids.strokes}, *tile).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_tiles_go_in_batches(spark):
    """Many small pictures with tiles that batches cut, without a call for each."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    rows = [(k if k else None, y, [float((k * 7 + y * 3 + x) % 5) / 4 for x in range(4)], [float((k + y + x) % 3) / 2 for x in range(4)]) for k in range(40) for y in range(4)]
    df = spark.createDataFrame(rows, "image long, y long, a array<double>, b array<double>")
    want = {}
    for k in range(40):
        a, b = (np.pad(np.array([r[c] for r in rows[4 * k : 4 * k + 4]]), 1, constant_values=np.nan) for c in (2, 3))
        want[k or None] = [16, *(float(np.abs(f(a) - f(b)).mean()) for f in (grids.sobel, grids.strokes))]
    spark.conf.set(batch, "3")
    try:
        found = grids.differences(df, "image", "y", "a", "b", {"edge": grids.sobel, "stroke": grids.strokes}, 4, 4)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.image: [r.n, r.edge, r.stroke] for r in found.collect()}
    finally:
        spark.conf.set(batch, before)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
