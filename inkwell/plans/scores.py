"""Score algebra queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import grids as G
from ..operators import ordered as O
from ..registry import query

@query("""SELECT user_id, round(sum(CASE event_type WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.2 ELSE 0.1 END * value), 4) AS s FROM events GROUP BY ALL""")
def weighted_ensemble(t):
    alpha = F.expr("CASE event_type WHEN 'click' THEN 0.4D WHEN 'view' THEN 0.3D WHEN 'purchase' THEN 0.2D ELSE 0.1D END")
    return t.events.groupBy("user_id").agg(F.round(F.sum(alpha * F.col("value")), 4).alias("s"))


@query("""WITH w AS (SELECT event_type, sum(value) AS v FROM events WHERE event_type <> 'view' GROUP BY ALL) SELECT event_type, round(v / coalesce(nullif((SELECT sum(v) FROM w), 0), 1), 6) AS w FROM w""")
def weight_renorm(t):
    g = t.events.filter("event_type <> 'view'").groupBy("event_type").agg(F.sum("value").alias("v"))
    total = F.sum("v").over(Window.partitionBy())
    return g.select("event_type", F.round(F.col("v") / F.when(total == 0, 1.0).otherwise(total), 6).alias("w"))


@query("""WITH p AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.99) AS p99, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(least(l_extendedprice, p99) / (p99 + 1e-8), 6) AS clipped, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (l_extendedprice - lo) / (hi - lo) END, 6) AS scaled FROM lineitem JOIN p USING (l_returnflag)""")
def p99_scale(t):
    stats = O.exact_percentiles(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p99": 0.99}).withColumnsRenamed({"low": "lo", "high": "hi"})
    x = F.col("l_extendedprice")
    scaled = F.when(F.expr("hi - lo < 1e-9"), 0.0).otherwise((x - F.col("lo")) / F.greatest(F.expr("hi - lo"), F.lit(1e-9)))
    return t.lineitem.join(stats, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(S.clip_p99(x, F.col("p99")), 6).alias("clipped"), F.round(scaled, 6).alias("scaled"))


@query("""WITH a AS (SELECT *, l_discount * l_tax AS p, min(l_discount * l_tax) OVER w AS lo, max(l_discount * l_tax) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
b AS (SELECT *, greatest(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (p - lo) / (hi - lo) END, 0.15 * (l_quantity / 50)) AS m FROM a),
c AS (SELECT *, min(m) OVER w AS lo2, max(m) OVER w AS hi2 FROM b WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, round(CASE WHEN hi2 - lo2 < 1e-9 THEN 0 ELSE (m - lo2) / (hi2 - lo2) END, 3) AS score FROM c""")
def importance_combo(t):
    w = S.over("l_orderkey")
    inner, outer = S.importance(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, w)
    return t.lineitem.withColumn("_inner", inner).withColumn("score", outer).select("l_orderkey", "l_linenumber", F.round("score", 3).alias("score"))


EXP_SQL = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


def vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"""WITH e AS ({EXP_SQL}), s AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS z, list_max(v) AS top FROM e), q AS (SELECT vec_id, list_transform(v, lambda x: x - top - ln(z)) AS lp FROM s)
SELECT vec_id, round(lp[1 + vec_id % 64], 6) AS gathered, round(list_sum(list_transform(lp, lambda x: -exp(x) * x)) / ln(64), 6) AS entropy FROM q""")
def entropy_topk(t):
    lp = vectors(t).select("vec_id", S.log_softmax(F.col("v")).alias("lp"))
    return lp.select(
        "vec_id", F.round(F.element_at("lp", (1 + F.col("vec_id") % 64).cast("int")), 6).alias("gathered"), F.round(S.entropy(F.transform("lp", lambda x: F.exp(x)), 64), 6).alias("entropy")
    )


@query(f"WITH e AS ({EXP_SQL}) SELECT vec_id, list_transform(list_slice(list_reverse_sort(v), 1, 5), lambda x: round(x, 6)) AS top FROM e")
def top_k_values(t):
    return vectors(t).select("vec_id", F.transform(F.slice(F.sort_array("v", asc=False), 1, 5), lambda x: F.round(x, 6)).alias("top"))


@query("""WITH l AS (SELECT event_id, ln(value / 500) AS lp, ln(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 500) AS prev FROM events)
SELECT event_id, round(-lp, 6) AS surprise, round(greatest(0, prev - lp), 6) AS kl, round(coalesce(greatest(0, exp(greatest(prev, -500)) - exp(greatest(lp, -500))), 0), 6) AS dropped FROM l WHERE prev IS NOT NULL""")
def kl_confdrop_surprise(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select("event_id", S.log(F.col("value") / 500).alias("lp"), S.log(F.lag("value").over(w) / 500).alias("prev")).filter("prev IS NOT NULL")
    return rows.select(
        "event_id", F.round(-F.col("lp"), 6).alias("surprise"), F.round(S.visual_kl(F.col("prev"), F.col("lp")), 6).alias("kl"), F.round(S.confidence_drop(F.col("prev"), F.col("lp")), 6).alias("dropped")
    )


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(-list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 5) AS loss, round(sqrt(list_dot_product(v, v)), 5) AS l2, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS linf FROM e JOIN c USING (label)""")
def cosine_align(t):
    """AGG29, MTH15: against the mean vector of the own label."""
    v = vectors(t)
    means = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return v.join(centre, "label").select(
        "vec_id", F.round(-S.cosine(F.col("v"), F.col("c")), 5).alias("loss"), F.round(S.l2(F.col("v")), 5).alias("l2"), F.round(S.linf(F.col("v")), 6).alias("linf")
    )


@query("""SELECT l_orderkey, l_linenumber, greatest(-0.05, least(0.05, l_discount - l_tax)) AS clamped, round(2.0 * pow(greatest(0, l_tax - 0.04), 2), 8) AS penalty, l_tax <= 0.04 AS ok,
round(0.5 * l_discount + 0.3 * l_tax + CASE WHEN l_returnflag IN ('A', 'R') THEN 0.2 * l_quantity ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END, 6) AS cost, CAST(floor(least(greatest(l_discount, 0), 1) * 255) AS INTEGER) AS byte FROM lineitem""")
def penalty_audit(t):
    stage = F.when(F.col("l_returnflag") == "A", "stage2").when(F.col("l_returnflag") == "R", "stage3").otherwise("stage1")
    cost = S.staged_cost(stage, {"edge": F.col("l_discount"), "stroke": F.col("l_tax"), "shape": F.col("l_quantity"), "conf": F.lit(1.0)}, {"edge": 0.5, "stroke": 0.3, "shape": 0.2, "conf": 0.1})
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", S.clamp(F.col("l_discount") - F.col("l_tax"), -0.05, 0.05).alias("clamped"), F.round(S.penalty(F.lit(2.0), F.col("l_tax"), 0.04), 8).alias("penalty"),
        (F.col("l_tax") <= 0.04).alias("ok"), F.round(cost, 6).alias("cost"), S.to_byte(F.col("l_discount")).alias("byte"),
    )


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, coalesce(list_sum(list_slice(q, 2, 3)), 0) AS total, round(coalesce(list_avg(list_slice(q, 2, 3)), 0), 6) AS mean FROM o""")
def span_reduce(t):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"])
    rows = t.lineitem.groupBy("l_orderkey").agg(q.alias("q")).withColumn("s", F.slice("q", 2, 2))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return rows.select("l_orderkey", total.alias("total"), F.round(F.when(F.size("s") > 0, total / F.greatest(F.size("s"), F.lit(1))).otherwise(0.0), 6).alias("mean"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), a AS (SELECT doc_id, avg(length(w)) FILTER (WHERE regexp_matches(w, '[.,]$')) AS l, avg(length(w)) FILTER (WHERE NOT regexp_matches(w, '[.,]$')) AS v, min(length(w)) AS lo, max(length(w)) AS hi, round(avg(length(w)), 6) AS mean FROM w GROUP BY ALL)
SELECT doc_id, round(coalesce(v, 0) / (coalesce(l, 0) + 1e-9), 4) AS ratio, coalesce(v, 0) / (coalesce(l, 0) + 1e-9) > 2 AS strong, lo, hi, mean FROM a WHERE l IS NOT NULL""")
def label_value_ratio(t):
    """AGG26, AGG27: one row is one document, so nothing is shuffled."""
    from ..functions.text import words

    rows = t.documents.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.transform("w", F.char_length).alias("n"), F.transform(F.filter("w", lambda x: x.rlike("[.,]$")), F.char_length).alias("l"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = rows.select("doc_id", F.size("n").alias("k"), total("n").alias("s"), F.size("l").alias("kl"), total("l").alias("sl"), F.array_min("n").cast("bigint").alias("lo"), F.array_max("n").cast("bigint").alias("hi"))
    rows = rows.filter("kl > 0")
    value = F.when(F.col("k") > F.col("kl"), (F.col("s") - F.col("sl")) / F.when(F.col("k") > F.col("kl"), F.col("k") - F.col("kl"))).otherwise(0.0)
    ratio = value / (F.col("sl") / F.col("kl") + 1e-9)
    return rows.select("doc_id", F.round(ratio, 4).alias("ratio"), (ratio > 2).alias("strong"), "lo", "hi", F.round(F.col("s") / F.col("k"), 6).alias("mean"))


@query(f"""WITH e AS ({EXP_SQL}), p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / len(x), 6) AS mae, round(list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 6) AS worst,
round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 5) AS cosine, CASE WHEN list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) > 0.999 THEN 'exact' WHEN list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) > 0.99 THEN 'close' ELSE 'apart' END AS tier FROM p""")
def array_agreement(t):
    a = vectors(t).select("vec_id", F.col("v").alias("x"))
    b = vectors(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("y"))
    gap = F.zip_with("x", "y", lambda p, q: F.abs(p - q))
    cos = S.cosine(F.col("x"), F.col("y"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size("x"), 6).alias("mae"), F.round(F.array_max(gap), 6).alias("worst"), F.round(cos, 5).alias("cosine"),
        S.tiers(cos, [(0.999, "exact"), (0.99, "close")], "apart").alias("tier"),
    )


@query(f"""WITH e AS ({EXP_SQL}), s AS (SELECT vec_id, list_transform(v, lambda x: x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))) AS lp FROM e)
SELECT count(*) AS n, bool_and(len(lp) > 0) AS filled, bool_and(list_max(lp) <= 0) AS negative, bool_and(list_min(lp) >= -100) AS floored, bool_and(lp[1] <= list_max(lp) + 1e-4) AS gathered FROM s""")
def logprob_quality(t):
    lp = vectors(t).select(S.log_softmax(F.col("v")).alias("lp"))
    return lp.agg(
        F.count("*").alias("n"), F.bool_and(F.size("lp") > 0).alias("filled"), F.bool_and(F.array_max("lp") <= 0).alias("negative"), F.bool_and(F.array_min("lp") >= -100).alias("floored"),
        F.bool_and(F.element_at("lp", 1) <= F.array_max("lp") + 1e-4).alias("gathered"),
    )


@query(f"""WITH e AS ({EXP_SQL}) SELECT vec_id, round(list_sum(list_transform(v, lambda x: pow(x * least(1.0, 0.5 / greatest(sqrt(list_dot_product(v, v)), 1e-12)), 2))), 6) AS size2 FROM e""")
def clamp_projection(t):
    return vectors(t).select("vec_id", F.round(F.aggregate(S.project_l2(F.col("v"), 0.5), F.lit(0.0), lambda a, x: a + x * x), 6).alias("size2"))


TURNED_SQL = f"SELECT vec_id AS image, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, v[i + 1] AS a, v[(7 - i // 8) * 8 + i % 8 + 1] AS b FROM (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM ({EXP_SQL}) WHERE len(v) = 64)"
STACKED_SQL = f"SELECT vec_id // 100 AS image, vec_id % 100 AS y, CAST(i - 1 AS BIGINT) AS x, v[i] AS a, 0.9 * v[i] + 0.05 AS b FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM ({EXP_SQL}))"
#: Each pixel goes to its nine neighbours.
STENCIL_SQL = """WITH p AS ({0}), d AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)), s AS (
SELECT image, y + dy AS y, x + dx AS x, sum(-dx * (2 - abs(dy)) * a) AS gxa, sum(-dy * (2 - abs(dx)) * a) AS gya, sum(-dx * (2 - abs(dy)) * b) AS gxb, sum(-dy * (2 - abs(dx)) * b) AS gyb,
max(1 - 1 / (1 + exp(-20 * (a - 0.7)))) AS sa, max(1 - 1 / (1 + exp(-20 * (b - 0.7)))) AS sb FROM p, d GROUP BY ALL)
SELECT image AS {1}, round(avg(abs(sqrt(gxa * gxa + gya * gya) - sqrt(gxb * gxb + gyb * gyb))) + 1e-9, 6) AS edge, round(avg(abs(sa - sb)) + 1e-9, 6) AS stroke FROM s JOIN p USING (image, y, x) GROUP BY ALL"""


def stencil_costs(rows, height, width):
    found = G.differences(rows, "image", "y", "a", "b", {"edge": G.sobel, "stroke": G.strokes}, height, width)
    return found.select("image", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("edge", "stroke")])


@query(STENCIL_SQL.format(TURNED_SQL, "vec_id"))
def edge_stroke_cost(t):
    """MTH16, MTH17: each vector as an 8 x 8 picture against itself turned over."""
    rows = vectors(t).filter(F.size("v") == 64).select(F.col("vec_id").alias("image"), "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    rows = rows.select("image", "y", F.slice("v", F.col("y") * 8 + 1, F.lit(8)).alias("a"), F.slice("v", (7 - F.col("y")) * 8 + 1, F.lit(8)).alias("b"))
    return stencil_costs(rows, 8, 8).withColumnRenamed("image", "vec_id")


@query(STENCIL_SQL.format(STACKED_SQL, "image"))
def picture_cost(t):
    """MTH16, MTH17: a hundred vectors as the rows of a picture, in tiles, against
    the picture with less contrast."""
    rows = vectors(t).select(F.expr("vec_id div 100").alias("image"), (F.col("vec_id") % 100).alias("y"), F.col("v").alias("a"), F.transform("v", lambda x: 0.9 * x + 0.05).alias("b"))
    return stencil_costs(rows, 32, 24)


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.6 * l_discount * 10 + 0.4 * l_tax * 10 AS s FROM lineitem), p AS (SELECT l_orderkey, quantile_cont(s, 0.99) AS p99 FROM n GROUP BY ALL)
SELECT l_orderkey, round(avg(0.0157 + (0.0627 - 0.0157) * least(s, p99) / (p99 + 1e-8)), 5) AS mean_budget, count(*) AS n FROM n JOIN p USING (l_orderkey) GROUP BY ALL""")
def budget_pipeline(t):
    """CMP1: weighted scores, clipped and scaled, to budgets."""
    n = t.lineitem.select("l_orderkey", (0.6 * F.col("l_discount") * 10 + 0.4 * F.col("l_tax") * 10).alias("s"))
    p = n.groupBy("l_orderkey").agg(F.percentile("s", 0.99).alias("p99"))
    b = S.budget(S.clip_p99(F.col("s"), F.col("p99")), F.lit(True), 0.0157, 0.0627, 0.0)
    return n.join(p, "l_orderkey").groupBy("l_orderkey").agg(F.round(F.avg(b), 5).alias("mean_budget"), F.count("*").alias("n"))
