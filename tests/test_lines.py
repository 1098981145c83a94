"""Boxes that stand in lines, against plain Python, in pieces of any size."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell import catalog
from inkwell.operators import lines as L

SF = "/root/testdata/sf0.001"


def pictures(seed):
    """Word lengths by line, some lines and pictures empty or null, and their boxes."""
    rng = random.Random(seed)
    n = [None if k == 4 else [[rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 12]))] for _ in range(rng.choice([0, 1, 9]))] for k in range(14)]
    boxes = []
    for row, lines in enumerate(n):
        for line, words in enumerate(lines or []):
            x = 0
            for pos, size in enumerate(words):
                boxes.append((row, line, pos, x, x + 8 * size, line * 20, line * 20 + 12))
                x += 8 * (size + 1)
    return pa.array(n, pa.list_(pa.list_(pa.int32()))), boxes


def near(a, b, radius):
    return a[0] == b[0] and (a[3] + a[4] - b[3] - b[4]) ** 2 + (a[5] + a[6] - b[5] - b[6]) ** 2 <= 4 * radius**2


def gathered(work, words):
    return [(int(r), *v) for rows, found in work(words) for r, *v in zip(rows, *(pa.array(c).to_pylist() for c in found.values()), strict=True)]


@pytest.mark.parametrize("at_once", [3, 1 << 16])
@pytest.mark.parametrize("radius", [15, 50, 60])
def test_near(monkeypatch, at_once, radius):
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    n, boxes = pictures(radius)
    words = L.by_line(n)
    want = [(*a[:3], [(b[1] << 32) + b[2] for b in boxes if near(a, b, radius)]) for a in boxes]
    assert gathered(L.contexts(radius), words) == want
    groups = {}
    for a in boxes:
        used = {groups[b] for b in groups if near(a, b, radius)}
        groups[a] = next(g for g in range(99) if g not in used)
    assert gathered(L.groups(radius), words) == [(*a[:3], g) for a, g in groups.items()]
    assert sum(j - i for i, j in L._pieces(n)) == len(n)


@pytest.mark.parametrize("at_once", [3, 1 << 16])
def test_unions_and_overlaps(monkeypatch, at_once):
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    n, boxes = pictures(7)
    words, rng = L.by_line(n), random.Random(9)
    want = {}
    for a in boxes:
        want.setdefault(a[:2], set()).update((b[1] << 32) + b[2] for b in boxes if a[2] % 4 == 0 and near(a, b, 60))
    assert gathered(L.unions(60, 4), words) == [(*k, sorted(v)) for k, v in want.items()]
    moved = [(a[0], a[1], a[2], a[3] + (r := rng.randint(0, 40)), a[4] + r, a[5] + (d := rng.randint(0, 29)), a[6] + d) for a in boxes]
    x0, x1, y0, y1 = (np.array([b[k] for b in moved]) for k in (3, 4, 5, 6))
    meet = lambda a, b: a[0] == b[0] and a[3] < b[4] and a[4] > b[3]
    assert L.overlaps(words, x0, x1).tolist() == [sum(meet(a, b) and a[1] == b[1] for b in moved) - 1 for a in moved]
    cross = [[b for b in moved if meet(a, b) and a[5] < b[6] and a[6] > b[5]] for a in moved]
    total, other = L.crossings(words, x0, x1, y0, y1, 2)
    assert total.tolist() == list(map(len, cross)) and other.tolist() == [sum(a[1] != b[1] for b in c) for a, c in zip(moved, cross, strict=True)]


@pytest.mark.parametrize("at_once", [5, 1 << 16])
def test_planned(monkeypatch, at_once):
    """Groups, and what passes hide, of words that flow into lines."""
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    rng = random.Random(8)
    n = [[rng.randint(1, 30) for _ in range(k)] for k in (0, 1, 40, 0, 90)] + [None]
    for row, lengths in enumerate(n):
        at, boxes = 0, []
        for pos, size in enumerate(lengths or []):
            boxes.append((row, at // 60, pos, at % 60 * 8, at % 60 * 8 + size * 8, at // 60 * 20, at // 60 * 20 + 12))
            at += size + 1
        groups = []
        for a in boxes:
            used = {groups[b[2]] for b in boxes[: a[2]] if near(a, b, 50)}
            groups.append(next(g for g in range(99) if g not in used))
        hidden = [{b[2] for a in boxes if groups[a[2]] == g for b in boxes if near(a, b, 50)} for g in range(max(groups, default=-1) + 1)]
        found = L._planned(pa.array(n, pa.list_(pa.int32())), L.flowing(60), 50).to_pylist()[row]
        assert found == {"groups": groups, "hides": [len(h) for h in hidden], "places": [sum(h) for h in hidden]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["mask_groups", "mask_passes", "masked_run", "greedy_groups", "boxes_crossing", "context_union", "token_spans", "box_context", "box_overlap"])
def test_nothing_shuffled_by_key(spark, name):
    """Neither rounds nor joins: small files are dealt out, that is all."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan and "ExistingRDD" not in plan
