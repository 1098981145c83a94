"""Ordered state and exact ranks over groups of any size: no group is held or
sorted as one, unless it is streamed."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def running(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, **sums: Column) -> DataFrame:
    """WIN1, WIN3: running sums within ``keys`` by ``order``, in columns named by
    ``sums``. ``bucket`` must never fall along the order: each bucket is summed by
    itself, the sums of buckets are added up in a small table, and rows add what
    lies before their bucket. So a group may hold any share of the table."""
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, [*keys, "_bucket"])
    return rows.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_bucket", *[f"_{n}" for n in sums])


def anchored_groups(rows: DataFrame, key: str, at: str, then: str, gap: timedelta, days: int = 64) -> DataFrame:
    """WIN4: ``key, at, then, gid``: by ``at`` within each key, a new group begins
    where a row lies more than ``gap`` after the first row of its group; groups
    are numbered from 1. Null keys are one key; rows with a null ``at`` have a
    null gid.

    No key is worked on as one. Of each time the next one and the next beyond the
    gap are found in stretches of ``days``. Where these two are the same a group
    begins, whatever lies before. Between such places groups follow from each
    other, so jumps to the next group are doubled: joins by key and time, as
    often as the longest such chain has binary digits."""
    own = rows.select(key, at, then).withColumn("_k", F.struct(key))
    times = checkpointed(own.filter(F.col(at).isNotNull()).select("_k", F.col(at).alias("_at")).distinct())
    stretch = F.expr(f"unix_date(to_date(_at)) div {int(days)}")
    beyond = times.select("_k", (F.col("_at") + F.lit(gap)).alias("_at"), F.col("_at").alias("_of"))
    points = times.withColumn("_of", F.lit(None).cast(dict(times.dtypes)["_at"])).unionByName(beyond).withColumn("_s", stretch)
    time = F.when(F.col("_of").isNull(), F.col("_at"))
    first = points.groupBy("_k", "_s").agg(F.min(time).alias("_low"))
    after = Window.partitionBy("_k").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_later", F.min("_low").over(after)).drop("_low")
    # From the end on, a time beyond the gap of another before the same time itself.
    inside = Window.partitionBy("_k", "_s").orderBy(F.col("_at").desc(), F.col("_of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    found = points.join(first, ["_k", "_s"]).withColumn("_next", F.coalesce(F.last(time, ignorenulls=True).over(inside), "_later"))
    place = F.coalesce("_of", "_at").alias("_at")
    jumps = checkpointed(found.groupBy("_k", place).agg(F.max(F.when(F.col("_of").isNull(), F.col("_next"))).alias("_next"), F.max(F.when(F.col("_of").isNotNull(), F.col("_next"))).alias("_jump")))
    sure = jumps.filter("_jump = _next").select("_k", F.col("_jump").alias("_at"))
    begins = checkpointed(sure.unionByName(times.groupBy("_k").agg(F.min("_at").alias("_at"))))
    steps = jumps.filter("_jump <> _next").select("_k", "_at", "_jump")
    steps = checkpointed(steps.join(begins.withColumnRenamed("_at", "_jump"), ["_k", "_jump"], "left_anti"))
    while not steps.isEmpty():
        begins = checkpointed(begins.unionByName(begins.join(steps, ["_k", "_at"]).select("_k", F.col("_jump").alias("_at"))).distinct())
        steps = checkpointed(steps.join(steps.select("_k", F.col("_at").alias("_jump"), F.col("_jump").alias("_far")), ["_k", "_jump"]).select("_k", "_at", F.col("_far").alias("_jump")))
    marked = times.join(begins.distinct().withColumn("_begin", F.lit(1)), ["_k", "_at"], "left")
    numbered = running(marked, ["_k"], ["_at"], stretch, gid=F.coalesce("_begin", F.lit(0))).select("_k", F.col("_at").alias("_t"), F.col("gid").cast("int").alias("gid"))
    return own.join(numbered, (own._k == numbered._k) & (F.col(at) == F.col("_t")), "left").select(key, at, then, "gid")


def until(rows: DataFrame, keys: list[str], order: list[str], good: Column, wanted: int, retries: int) -> DataFrame:
    """FIL10: of each group the first ``wanted`` rows that are good, in columns
    ``attempt`` and ``place`` which row of the group and which good one each is;
    only the first ``wanted * retries`` rows are tried. The limit on a row number
    is one that Spark takes before it shuffles, so groups are not gathered."""
    tried = rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("attempt") <= wanted * retries)
    placed = tried.filter(good).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("attempt")))
    return placed.filter(F.col("place") <= wanted)


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """AGG15, AGG20: ``keys``, the least and greatest value as ``low`` and
    ``high``, and for each name its share's percentile, interpolated between
    neighbours. A histogram finds the bins that hold the wanted ranks, and only
    the values of those bins are ordered, each distinct one once; so neither a
    group nor its distinct values are gathered. Nulls do not count; a group
    without a value gives nulls."""
    v = F.col(value).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_e.{k}")) for k in keys]
    e = ends.select(F.struct(*ends.columns).alias("_e"))
    every = reduce(lambda a, b: a & b, same, F.lit(True))
    width = F.col("_e.high") - F.col("_e.low")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - F.col("_e.low")) / F.when(width > 0, width) * bins))).otherwise(0)
    placed = rows.filter(v.isNotNull()).join(F.broadcast(e) if not keys else e, every).select(*[F.col(f"_e.{k}").alias(k) for k in keys], v.alias("v"), place.cast("int").alias("bin"), F.col("_e._n").alias("n"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("pos")) for name, q in shares.items()])
    up_to = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy(*keys, "bin", "n").agg(F.count("*").alias("c")).withColumn("end", F.sum("c").over(up_to))
    wanted = counts.withColumn("begin", F.col("end") - F.col("c")).withColumn("r", F.explode(ranks))
    wanted = wanted.select(*keys, "bin", "begin", "end", "r.name", "r.pos", F.explode(F.array(F.floor("r.pos"), F.ceil("r.pos"))).alias("rank"))
    wanted = wanted.filter("rank >= begin AND rank < end").distinct()
    near = wanted.select(*keys, "bin").distinct()
    on = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in (*keys, "bin")])
    few = placed.join(near, on(placed, near), "left_semi").groupBy(*keys, "bin", "v").agg(F.count("*").alias("c"))
    inside = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("upto", F.sum("c").over(inside))
    hit = wanted.join(few, on(wanted, few) & (wanted["rank"] < wanted["begin"] + few["upto"]) & (wanted["rank"] >= wanted["begin"] + few["upto"] - few["c"]))
    weight = F.when(F.floor("pos") == F.ceil("pos"), 1.0).when(F.col("rank") == F.floor("pos"), 1 - (F.col("pos") - F.floor("pos"))).otherwise(F.col("pos") - F.floor("pos"))
    hit = hit.select(*[wanted[k] for k in keys], "name", (F.col("v") * weight).alias("part"))
    found = hit.groupBy(*keys).pivot("name", list(shares)).agg(F.sum("part")).select(F.struct(*keys, *shares).alias("_f"))
    every = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_f.{k}")) for k in keys], F.lit(True))
    return ends.join(found, every, "left").select(*keys, "low", "high", *[F.col(f"_f.{x}").alias(x) for x in shares])
