"""Numeric functions over columns: score algebra, penalties, vectors, boxes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """MTH5: x held between two bounds."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def transfer_ratio(held_out: Column, own: Column) -> Column:
    """MTH2: 0 where the denominator is next to nothing."""
    return F.when(F.abs(own) < 1e-6, 0.0).otherwise(held_out / F.when(own != 0, own))


def gap_gain(h_adv: Column, m_adv: Column, h_clean: Column, m_clean: Column) -> Column:
    """MTH1: growth of the gap between two readers."""
    return (h_adv - m_adv) - (h_clean - m_clean)


def gap_floor(h_adv: Column, m_adv: Column, least: float) -> Column:
    """MTH1: whether the gap is under its floor."""
    return h_adv - m_adv < least


def unscaled(budget: Column, low: float, high: float) -> Column:
    """MTH13: the score that a budget stands for, held to 0..1."""
    return clamp((budget - low) / (high - low) if high - low > 1e-9 else budget, 0.0, 1.0)


def ratio(a: Column, b: Column) -> Column:
    """CHK2: infinite where the denominator is zero."""
    return F.when(b == 0, float("inf")).otherwise(a / F.when(b != 0, b))


def under(value: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """CHK2: the name of the first bound that the value stays under."""
    out = reduce(lambda c, b: c.when(value < b[0], b[1]), bounds[1:], F.when(value < bounds[0][0], bounds[0][1]))
    return out.otherwise(otherwise)


def first_position(words: Column, preferred: Column) -> Column:
    """CHK5: ``struct(position, word)`` of the first of the preferred words, or
    else of the capitalised words in order, that is in ``words``; position 0 with
    the first word if there is none."""
    wanted = F.concat(F.array(preferred), F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    there = F.try_element_at(F.filter(wanted, lambda w: F.array_contains(words, w)), F.lit(1))
    word = F.coalesce(there, F.try_element_at(words, F.lit(1)))
    at = F.when(there.isNull(), 0).otherwise(F.array_position(words, there) - 1).cast("int")
    return F.struct(at.alias("position"), word.alias("word"))


def shape_cost(a: Column, b: Column, width: int, height: int, boxes: list[tuple[int, int, int, int]]) -> Column:
    """MTH18: mean difference within each box of two rasters (arrays by row),
    averaged over all boxes, those that are empty counting as 0; without boxes
    that of the whole raster."""
    pairs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    whole = boxes or [(0, 0, width, height)]

    def mean(gaps: Column, box: tuple[int, int, int, int]) -> Column:
        x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(width, box[2]), min(height, box[3])
        at = [y * width + x + 1 for y in range(y0, y1) for x in range(x0, x1)]
        if not at:
            return F.lit(0.0)
        return F.aggregate(F.array(*map(F.lit, at)), F.lit(0.0), lambda s, i: s + F.element_at(gaps, i)) / len(at)

    return bound(pairs, lambda g: reduce(lambda s, x: s + x, [mean(g, box) for box in whole]) / len(whole))


def penalty(mu: Column, loss: Column, kappa: Column | float) -> Column:
    """MTH3."""
    return mu * F.pow(F.greatest(F.lit(0.0), loss - kappa), 2)


def staged_cost(stage: Column, parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """MTH4: edge and stroke always, shape from the second stage, confidence in
    the third."""
    base = weights["edge"] * parts["edge"] + weights["stroke"] * parts["stroke"]
    shape = F.when(stage.isin("stage2", "stage3"), weights["shape"] * parts["shape"]).otherwise(0.0)
    conf = F.when(stage == "stage3", weights["conf"] * parts["conf"]).otherwise(0.0)
    return base + shape + conf


def budget(score: Column, is_text: Column, low: float, high: float, background: float) -> Column:
    """MTH7: budget between two values by score within text, another outside."""
    return F.when(is_text, low + (high - low) * score).otherwise(background)


def mu_schedule(start: Column, growth: Column, k: Column) -> Column:
    """WIN9: closed form of repeated growth."""
    return start * F.pow(growth, k - 1)


def min_max(x: Column, w: WindowSpec) -> Column:
    """AGG21: scaled to 0..1 within a window; zeros where all are alike."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((x - low) / F.greatest(high - low, F.lit(1e-9)))


def clip_p99(x: Column, p99: Column) -> Column:
    """AGG20."""
    return F.least(x, p99) / (p99 + 1e-8)


def entropy(p: Column, k: int) -> Column:
    """MTH8: entropy of an array of probabilities over log k."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return total / F.ln(F.lit(float(k)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for a row, not once for
    each element that a function within ``body`` runs over."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(v: Column) -> Column:
    """MTH14: of an array of doubles."""

    def shifted(top: Column) -> Column:
        total = F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        return bound(total, lambda z: F.transform(v, lambda x: x - top - z))

    return bound(F.array_max(v), shifted)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    """MTH15."""
    return F.sqrt(dot(v, v))


def linf(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = l2(a) * l2(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(0.0)


def project_l2(v: Column, radius: float) -> Column:
    """MTH6: onto the ball of a radius."""
    share = F.least(F.lit(1.0), F.lit(radius) / F.greatest(l2(v), F.lit(1e-12)))
    return bound(share, lambda k: F.transform(v, lambda x: x * k))


def log(x: Column) -> Column:
    """MTH11: the natural logarithm, minus infinity of 0, where Spark's is null."""
    return F.when(x == 0, float("-inf")).otherwise(F.ln(x))


def visual_kl(before: Column, after: Column) -> Column:
    """MTH9."""
    return F.greatest(F.lit(0.0), before - after)


def confidence_drop(before: Column, after: Column) -> Column:
    """MTH10: of log probabilities, floored before the exponent; 0 if missing."""
    drop = F.exp(F.greatest(before, F.lit(-500.0))) - F.exp(F.greatest(after, F.lit(-500.0)))
    return F.coalesce(F.greatest(F.lit(0.0), drop), F.lit(0.0))


def importance(ent: Column, kl: Column, sal: Column, w: WindowSpec, floor: float = 0.15) -> tuple[Column, Column]:
    """MTH12: inner and outer step; the second takes the column of the first,
    named ``_inner``, through a further window."""
    return min_max(ent * kl, w), min_max(F.greatest(F.col("_inner"), floor * sal), w)


def to_byte(x: Column) -> Column:
    """QNT1: [0, 1] to 0..255, clamped and truncated."""
    return F.floor(clamp(x, 0.0, 1.0) * 255).cast("int")


def tiers(value: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """PRJ6, CHK1-3, MTH21: the name of the first bound that is exceeded."""
    out = reduce(lambda c, b: c.when(value > b[0], b[1]), bounds[1:], F.when(value > bounds[0][0], bounds[0][1]))
    return out.otherwise(otherwise)


def over(*keys: str, by: str | None = None) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(by) if by else w
