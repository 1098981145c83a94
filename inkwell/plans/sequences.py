"""Windows, running counters, ordered folds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ordered as O
from ..registry import query


@query("""SELECT o_orderkey, CAST(sum(1 + o_orderkey % 3) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page,
o_orderpriority || '_' || printf('%04d', 7 + row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)) AS name FROM orders""")
def running_page_counter(t):
    rows = O.running(
        t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"),
        page=1 + F.col("o_orderkey") % 3, place=F.lit(1),
    )
    return rows.select("o_orderkey", "page", F.format_string("%s_%04d", "o_orderpriority", 7 + F.col("place")).alias("name"))


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)""")
def section_ids(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("flag", ((F.col("role") == "user") | (F.row_number().over(w) == 1)).cast("int"))
    return rows.select("conv_id", "turn", F.sum("flag").over(w).alias("section"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (
SELECT user_id, event_id, ts, i, ts AS anchor, 1 AS gid FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN e.ts - f.anchor > INTERVAL 3 DAY THEN e.ts ELSE f.anchor END, f.gid + CASE WHEN e.ts - f.anchor > INTERVAL 3 DAY THEN 1 ELSE 0 END
FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, gid FROM f""")
def anchored_groups(t):
    """WIN4: a new group where a row lies more than a gap after the first row
    of its group."""
    return O.anchored_groups(t.events, "user_id", "ts", "event_id", timedelta(days=3)).select("user_id", "event_id", "gid")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (
SELECT user_id, event_id, value, i, ts AS anchor, 1 AS gid FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN e.ts - f.anchor > INTERVAL 3 DAY THEN e.ts ELSE f.anchor END, f.gid + CASE WHEN e.ts - f.anchor > INTERVAL 3 DAY THEN 1 ELSE 0 END
FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, gid, event_id, CAST(row_number() OVER (PARTITION BY user_id, gid ORDER BY value, event_id) AS INTEGER) AS place FROM f""")
def reading_order(t):
    """TOP5: lines by their first row (top), and within a line by value (left)."""
    lines = O.anchored_groups(t.events, "user_id", "ts", "event_id", timedelta(days=3)).select("event_id", "gid")
    rows = t.events.select("user_id", "event_id", "value").join(lines, "event_id")
    return rows.select("user_id", "gid", "event_id", F.row_number().over(Window.partitionBy("user_id", "gid").orderBy("value", "event_id")).alias("place"))


@query("SELECT event_type, min_by(event_id, {'t': ts, 'e': event_id}) AS first_id, max_by(value, {'t': ts, 'e': event_id}) AS last_value FROM events GROUP BY ALL")
def first_and_last(t):
    order = F.struct("ts", "event_id")
    return t.events.groupBy("event_type").agg(F.min_by("event_id", order).alias("first_id"), F.max_by("value", order).alias("last_value"))


@query("""SELECT user_id, event_id, prev FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND value <= 50""")
def violations(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("prev", F.lag("event_id").over(w)).filter("prev IS NOT NULL AND value <= 50").select("user_id", "event_id", "prev")


@query("SELECT n_nationkey, round(0.5 * pow(1.5, n_nationkey), 6) AS mu, 143 // 25 + CASE WHEN n_nationkey < 143 % 25 THEN 1 ELSE 0 END AS quota, n_nationkey % 4 AS slot FROM nation")
def schedules(t):
    k = F.col("n_nationkey")
    return t.nation.select(
        k, F.round(S.mu_schedule(F.lit(0.5), F.lit(1.5), k + 1), 6).alias("mu"), (F.lit(143 // 25) + F.when(k < 143 % 25, 1).otherwise(0)).alias("quota"), F.pmod(k, F.lit(4)).alias("slot")
    )


@query("""WITH s AS (SELECT user_id, event_id, value < 120 AS empty, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 120 ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(event_id) AS any_id, count(*) AS streak FROM s WHERE empty GROUP BY user_id, g HAVING count(*) >= 3""")
def empty_streaks(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = Window.partitionBy("user_id", "empty").orderBy("ts", "event_id")
    rows = t.events.withColumn("empty", F.col("value") < 120).withColumn("g", F.row_number().over(w) - F.row_number().over(e))
    return rows.filter("empty").groupBy("user_id", "g").agg(F.min("event_id").alias("any_id"), F.count("*").alias("streak")).filter("streak >= 3").drop("g")


@query("""WITH w AS (SELECT doc_id, len(regexp_split_to_array(text, '\\s+')) AS n FROM documents), i AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(i * 50 // n AS INTEGER) AS start, CAST(greatest(i * 50 // n + 1, (i + 1) * 50 // n) AS INTEGER) AS stop FROM i""")
def proportional_spans(t):
    """WIN14: token spans shared out in proportion."""
    n = F.size(F.split("text", r"\s+"))
    rows = t.documents.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("doc_id", "i", F.expr("cast(i * 50 div n as int)").alias("start"), F.expr("cast(greatest(i * 50 div n + 1, (i + 1) * 50 div n) as int)").alias("stop"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS y, l_quantity AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, y, y + h > 100 AS overflow FROM r WHERE y < 150""")
def overflow_reject(t):
    """WIN6, FIL9, FIL12: rows stacked downwards; what begins below the canvas
    is left out, what sticks out is marked."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.lineitem.withColumn("y", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)))
    return rows.filter("y < 150").select("l_orderkey", "l_linenumber", "y", (F.col("y") + F.col("l_quantity") > 100).alias("overflow"))
