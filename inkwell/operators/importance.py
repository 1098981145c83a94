"""CMP1-6: importance of words, from scores that models give. A word's box carries
its value, so pictures stay rows of words; what is not text scores 0 everywhere,
so 0 is part of every picture's range. Each function takes and returns rows keyed
by ``image, pos``. Where a picture is made from one row, its words' scores are
arrays of that row and nothing is shuffled: ``array_*`` take and return such arrays
of doubles, in the words' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .ordered import exact_percentiles

WORD = ["image", "pos"]


def within(x: Column, *keys: str) -> Column:
    """AGG21 of a picture whose background is 0."""
    w = S.over(*keys)
    low, high = F.least(F.min(x).over(w), F.lit(0.0)), F.greatest(F.max(x).over(w), F.lit(0.0))
    return F.when(high - low < 1e-9, 0.0).otherwise((x - low) / F.greatest(high - low, F.lit(1e-9)))


def ensemble(rows: DataFrame, score: str, weights: dict[str, float], exclude: tuple[str, ...] = ()) -> DataFrame:
    """AGG18, AGG19: the weighted sum of a word's scores over models, without the
    excluded ones, the weights of the others put to a sum of one if any is
    excluded."""
    used = {m: a for m, a in weights.items() if m not in exclude}
    total = (sum(used.values()) or 1.0) if exclude else 1.0
    alpha = F.coalesce(*[F.when(F.col("model") == m, F.lit(a / total)) for m, a in used.items()], F.lit(0.0))
    return rows.groupBy(*WORD).agg(F.sum(alpha * F.col(score)).alias(score))


def array_within(x: Column) -> Column:
    """``within`` of the words of one picture."""

    def scaled(v: Column) -> Column:
        ends = F.array(F.least(F.array_min(v), F.lit(0.0)), F.greatest(F.array_max(v), F.lit(0.0)))

        def one(y: Column, e: Column) -> Column:
            low, wide = F.get(e, F.lit(0)), F.get(e, F.lit(1)) - F.get(e, F.lit(0))
            return F.when(wide < 1e-9, 0.0).otherwise((y - low) / F.greatest(wide, F.lit(1e-9)))

        return S.bound(ends, lambda e: F.transform(v, lambda y: one(y, e)))

    return S.bound(x, scaled)


def array_p99(x: Column) -> Column:
    """AGG20: the 99th percentile of the words of one picture, interpolated."""

    def found(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(0.99)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return S.bound(F.array_sort(x), found)


def array_salience(norm: Column, low: float, high: float) -> Column:
    """CMP1 of mixed norms."""

    def raw(v: Column) -> Column:
        budget = lambda x, p: S.budget(S.clip_p99(x, p), F.lit(True), low, high, 0.0)
        return S.bound(array_p99(v), lambda p: F.transform(v, lambda x: S.unscaled(budget(x, p), low, high)))

    return array_within(S.bound(norm, raw))


def array_importance(entropy: Column, kl: Column, sal: Column, floor: float = 0.15) -> Column:
    """CMP6."""
    both = array_within(F.zip_with(array_within(entropy), array_within(kl), lambda e, k: e * k))
    return array_within(F.zip_with(both, sal, lambda r, s: F.greatest(r, floor * s)))


def span_sum(lp: Column, start: Column, stop: Column) -> Column:
    """AGG23: sum over a span of tokens; 0 for a span that begins past the end."""
    return F.aggregate(_span(lp, start, stop), F.lit(0.0), lambda a, x: a + x)


def span_mean(lp: Column, start: Column, stop: Column) -> Column:
    """AGG23: the same by token."""
    part = _span(lp, start, stop)
    return span_sum(lp, start, stop) / F.greatest(F.size(part), F.lit(1))


def _span(values: Column, start: Column, stop: Column) -> Column:
    n = F.greatest(F.least(stop, F.size(values)) - start, F.lit(0))
    return F.when(start < F.size(values), F.slice(values, start + 1, n)).otherwise(F.slice(values, F.lit(1), F.lit(0)))


def salience(rows: DataFrame, weights: dict[str, float], low: float, high: float) -> DataFrame:
    """CMP1: ``salience`` of rows ``image, pos, model, norm``: the ensemble's
    gradient norm, clipped and scaled by the 99th percentile of its picture, put
    to a budget in text and back to 0..1 (MTH13), then to the picture's range."""
    mixed = ensemble(rows, "norm", weights)
    p99 = exact_percentiles(mixed, ["image"], "norm", {"p99": 0.99}).select("image", "p99")
    budget = S.budget(S.clip_p99(F.col("norm"), F.col("p99")), F.lit(True), low, high, 0.0)
    raw = mixed.join(p99, "image").select(*WORD, budget.alias("budget")).withColumn("raw", S.unscaled(F.col("budget"), low, high))
    return raw.select(*WORD, within(F.col("raw"), "image").alias("salience"))


def surprise(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """CMP2: ``surprise`` of rows ``image, pos, model, lp, start, stop``, where
    ``lp`` are the log probabilities of the tokens of the word's section, read
    without the picture, and start and stop the word's tokens there."""
    own = rows.withColumn("surprise", -span_sum(F.col("lp"), F.col("start"), F.col("stop")))
    return ensemble(own, "surprise", weights)


def masked_change(before: DataFrame, masked: DataFrame, change, name: str, weights: dict[str, float]) -> DataFrame:
    """CMP3, CMP4: rows ``image, pos, model, lp`` of the picture as it is against
    those of the pass in which the word and what is near it are masked; ``change``
    is ``visual_kl`` or ``confidence_drop``. A word without a masked pass counts
    as unchanged."""
    pairs = before.join(masked.withColumnRenamed("lp", "_masked"), [*WORD, "model"], "left")
    own = pairs.withColumn(name, F.when(F.col("_masked").isNull(), 0.0).otherwise(change(F.col("lp"), F.col("_masked"))))
    return ensemble(own, name, weights)


def token_entropy(top: Column) -> Column:
    """CMP5: the mean over a word's tokens of the entropy of each one's greatest
    log probabilities; 0 for null."""
    def one(top: Column) -> Column:
        return -F.aggregate(top, F.lit(0.0), lambda a, x: a + x * F.exp(x)) / F.ln(F.greatest(F.size(top), F.lit(2)))

    mean = F.aggregate(F.transform(top, one), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(top), F.lit(1))
    return F.coalesce(F.when(F.size(top) > 0, mean), F.lit(0.0))


def blank_entropy(rows: DataFrame, weights: dict[str, float], exclude: tuple[str, ...] = ()) -> DataFrame:
    """CMP5: ``entropy`` of rows ``image, pos, model, top`` with ``top`` an array,
    for each token of the word, of the greatest log probabilities (null where a
    model gives none, which counts as 0): the mean over tokens, put to the
    picture's range for each model, then mixed."""
    own = rows.filter(~F.col("model").isin(*exclude)) if exclude else rows
    own = own.withColumn("raw", token_entropy(F.col("top")))
    scaled = own.select(*WORD, "model", within(F.col("raw"), "image", "model").alias("entropy"))
    return ensemble(scaled, "entropy", weights, exclude)


def importance(entropy: DataFrame, kl: DataFrame, sal: DataFrame, low: float, high: float, floor: float = 0.15) -> DataFrame:
    """CMP6: entropy times change by masking, with a floor from the salience, put
    to the picture's range: ``entropy, kl, salience, importance, budget``."""
    rows = entropy.join(kl, WORD).join(sal, WORD)
    rows = rows.withColumns({"entropy": within(F.col("entropy"), "image"), "kl": within(F.col("kl"), "image")})
    rows = rows.withColumn("raw", within(F.col("entropy") * F.col("kl"), "image"))
    rows = rows.withColumn("importance", within(F.greatest("raw", floor * F.col("salience")), "image"))
    return rows.select(*WORD, "entropy", "kl", "salience", "importance", S.budget(F.col("importance"), F.lit(True), low, high, 0.0).alias("budget"))
