"""Checks of score tables: tiers, positions, box differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..registry import query


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'slow' WHEN l_discount / l_tax < 1.5 THEN 'fine' WHEN l_discount / l_tax < 3.0 THEN 'fair' ELSE 'slow' END AS pace,
CASE WHEN l_discount - l_tax > 0.05 THEN 'sees' WHEN l_discount - l_tax > 0 THEN 'weak' ELSE 'blind' END AS sight, l_discount - l_tax < -0.02 AS low, round(greatest(0, least(1, (l_discount - 0.02) / (0.08 - 0.02))), 6) AS score FROM lineitem""")
def tier_checks(t):
    """CHK2, CHK3, MTH1, MTH13."""
    d, x = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", S.under(S.ratio(d, x), [(1.5, "fine"), (3.0, "fair")], "slow").alias("pace"), S.tiers(d - x, [(0.05, "sees"), (0, "weak")], "blind").alias("sight"),
        S.gap_floor(d, x, -0.02).alias("low"), F.round(S.unscaled(d, 0.02, 0.08), 6).alias("score"),
    )


@query("""SELECT o_orderkey, round((o_totalprice - 1000) - (o_shippriority2 - 10), 4) AS gain FROM (SELECT o_orderkey, o_totalprice, o_custkey % 97 AS o_shippriority2 FROM orders)""")
def gap_gain(t):
    """MTH1."""
    m = (F.col("o_custkey") % 97).cast("double")
    return t.orders.select("o_orderkey", F.round(S.gap_gain(F.col("o_totalprice"), m, F.lit(1000.0), F.lit(10.0)), 4).alias("gain"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), f AS (SELECT doc_id, w, list_filter(list_concat(['The'], list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))), lambda x: list_contains(w, x))[1] AS hit FROM w)
SELECT doc_id, CASE WHEN hit IS NULL THEN 0 ELSE CAST(list_position(w, hit) - 1 AS INTEGER) END AS position, coalesce(hit, w[1]) AS word FROM f""")
def target_position(t):
    """CHK5."""
    from ..functions.text import words

    rows = t.documents.select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", S.first_position(F.col("w"), F.lit("The")).alias("p")).select("doc_id", "p.position", "p.word")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64), g AS (SELECT vec_id, list_transform(range(0, 64), lambda i: abs(v[i + 1] - v[(7 - i // 8) * 8 + i % 8 + 1])) AS g FROM e)
SELECT vec_id, round((list_avg(list_transform(list_filter(range(0, 64), lambda i: i % 8 < 4 AND i // 8 < 4), lambda i: g[i + 1])) + list_avg(list_transform(list_filter(range(0, 64), lambda i: i % 8 >= 4), lambda i: g[i + 1]))) / 3, 6) AS boxes, round(list_avg(g), 6) AS whole FROM g""")
def shape_cost(t):
    """MTH18: each vector as an 8 x 8 picture against itself turned over; of three
    boxes one is outside."""
    v = F.col("v")
    turned = F.flatten(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda r: F.slice(v, r * 8 + 1, F.lit(8))))
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") == 64)
    cost = lambda boxes: F.round(S.shape_cost(v, turned, 8, 8, boxes), 6)
    return rows.select("vec_id", cost([(0, 0, 4, 4), (4, 0, 12, 8), (8, 8, 9, 9)]).alias("boxes"), cost([]).alias("whole"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_min(v), 6) AS low, round(list_avg(v), 6) AS mean, round(list_max(v), 6) AS high, round(len(list_filter(v, lambda x: x > 0)) / len(v), 6) AS nonzero FROM e""")
def component_stats(t):
    """AGG27."""
    v = F.col("embedding").cast("array<double>")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select(
        "vec_id", F.round(F.array_min(v), 6).alias("low"), F.round(total / F.size(v), 6).alias("mean"), F.round(F.array_max(v), 6).alias("high"), F.round(F.size(F.filter(v, lambda x: x > 0)) / F.size(v), 6).alias("nonzero")
    )


@query("""WITH v AS (SELECT event_type, avg(value) AS m, median(value) AS mid, max(value) AS x, count(*) AS n, count(*) FILTER (WHERE value > 450) AS k FROM events GROUP BY ALL),
g AS (SELECT event_type, CAST(m > 240 AS INTEGER) + CAST(mid > 240 AS INTEGER) + CAST(x > 480 AS INTEGER) + CAST(n > 100 AS INTEGER) + CAST(k / greatest(n, 1) > 0.08 AS INTEGER) AS gates FROM v)
SELECT event_type, gates, CASE WHEN gates = 5 THEN 'STRONG' WHEN gates >= 4 THEN 'PASS' WHEN gates >= 2 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM g""")
def five_gates(t):
    """AGG17: five criteria, a verdict by how many hold; AGG15: the mean of none
    is 0, the median of none not a number."""
    from ..operators.ordered import exact_percentiles

    mid = exact_percentiles(t.events.select("event_type", "value"), ["event_type"], "value", {"mid": 0.5}).select("event_type", "mid")
    g = t.events.groupBy("event_type").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("m"), F.max("value").alias("x"), F.count("*").alias("n"), F.count_if(F.col("value") > 450).alias("k"))
    g = g.join(mid, "event_type").withColumn("mid", F.coalesce("mid", F.lit(float("nan"))))
    tests = [F.col("m") > 240, (F.col("mid") > 240) & ~F.isnan("mid"), F.col("x") > 480, F.col("n") > 100, F.col("k") / F.greatest(F.col("n"), F.lit(1)) > 0.08]
    g = g.withColumn("gates", sum((F.coalesce(c, F.lit(False)).cast("int") for c in tests), F.lit(0)))
    verdict = F.when(F.col("gates") == 5, "STRONG").when(F.col("gates") >= 4, "PASS").when(F.col("gates") >= 2, "PARTIAL").otherwise("FAIL")
    return g.select("event_type", "gates", verdict.alias("verdict"))
