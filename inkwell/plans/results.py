"""Result analytics over the driver's tables. ``events`` stands for results: a
day is a configuration, a user a sample, an event type a model; ``labels`` for
two models' passes of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ordered as O
from ..operators import results as R
from ..registry import query

CELLS_SQL = """SELECT CAST(ts AS DATE) AS day, user_id, event_type, max_by(value > 250, {'t': ts, 'e': event_id}) AS pass
FROM events GROUP BY ALL"""


def cells(t):
    rows = t.events.select(F.to_date("ts").alias("day"), "user_id", "event_type", (F.col("value") > 250).alias("pass"), "ts", "event_id")
    return R.last_wins(rows, ["day", "user_id", "event_type"], "pass", F.struct("ts", "event_id"))


def labelled(t):
    """labels as one row per document and model, with the document's group."""
    long = t.labels.select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("toxic"), F.col("toxic") == 1)).alias("model", "pass"))
    return long.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


LABELLED_SQL = """SELECT l.doc_id, m.model, m.pass, d.lang, d.source, d.n_chars FROM labels l
JOIN documents d USING (doc_id), LATERAL (VALUES ('quality', l.quality = 1), ('toxic', l.toxic = 1)) m(model, pass)"""


@query(f"""WITH c AS ({CELLS_SQL}), s AS (SELECT day, user_id, count(*) FILTER (WHERE pass) AS k FROM c GROUP BY ALL)
SELECT day, count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_any, count(*) FILTER (WHERE k = (SELECT count(DISTINCT event_type) FROM c)) AS n_all
FROM s GROUP BY day""")
def pass_rates_by_config(t):
    return R.any_and_all(cells(t), ["day"], "user_id", "event_type", "pass")


@query(f"""WITH c AS ({CELLS_SQL}) SELECT day, event_type, count(DISTINCT user_id) AS n, count(*) FILTER (WHERE pass) AS n_pass,
printf('%d/%d (%.0f%%)', count(*) FILTER (WHERE pass), count(DISTINCT user_id), 100.0 * count(*) FILTER (WHERE pass) / count(DISTINCT user_id)) AS shown
FROM c GROUP BY ALL""")
def pass_rates_by_model(t):
    g = cells(t).groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("n"), F.count_if("pass").alias("n_pass"))
    return g.withColumn("shown", F.format_string("%d/%d (%.0f%%)", "n_pass", "n", F.expr("rint(100.0D * n_pass / n)")))


@query(f"""WITH c AS ({LABELLED_SQL}), s AS (SELECT lang, source, doc_id, count(*) FILTER (WHERE pass) AS k FROM c GROUP BY ALL)
SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_any, count(*) FILTER (WHERE k = 2) AS n_all FROM s GROUP BY ALL""")
def category_breakdown(t):
    return R.any_and_all(labelled(t), ["lang", "source"], "doc_id", "model", "pass", 2)


@query("""SELECT l_discount, l_tax, n FROM (SELECT l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL)
ORDER BY round(abs(l_discount - 0.03137) + abs(l_tax - 0.05), 9), l_discount, l_tax LIMIT 1""")
def primary_config(t):
    g = t.lineitem.groupBy("l_discount", "l_tax").agg(F.count("*").alias("n"))
    return g.orderBy(F.expr("round(abs(l_discount - 0.03137D) + abs(l_tax - 0.05D), 9)"), "l_discount", "l_tax").limit(1)


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 400) AS n_dirty,
round(count(*) FILTER (WHERE value > 400) / count(*), 6) AS rate FROM events GROUP BY ALL HAVING count(*) FILTER (WHERE value > 400) > 0""")
def dirty_counts(t):
    g = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 400).alias("n_dirty"))
    return g.filter("n_dirty > 0").withColumn("rate", F.round(F.col("n_dirty") / F.col("n"), 6))


OVERLAP_SQL = """count(*) AS n, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_only_a,
count(*) FILTER (WHERE NOT a AND b) AS n_only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS n_neither, count(*) FILTER (WHERE a OR b) AS n_union"""


@query(f"""WITH c AS ({LABELLED_SQL}), s AS (SELECT lang, doc_id, bool_or(pass AND model = 'quality') AS a, bool_or(pass AND model = 'toxic') AS b FROM c GROUP BY ALL)
SELECT lang, {OVERLAP_SQL} FROM s GROUP BY lang""")
def complementarity_raw(t):
    return R.complementarity(labelled(t), ["lang"], "doc_id", "model", "pass", "quality", "toxic")


@query(f"""WITH c AS ({LABELLED_SQL}), s AS (SELECT lang, doc_id, bool_or(pass AND model = 'quality') AS a, bool_or(pass AND model = 'toxic') AS b,
bool_or(model = 'quality' AND n_chars < 500) AS da, bool_or(model = 'toxic' AND (n_chars < 200 OR n_chars > 9000)) AS db FROM c GROUP BY ALL),
f AS (SELECT lang, a AND NOT da AS a, b AND NOT db AS b FROM s WHERE NOT (da AND db)) SELECT lang, {OVERLAP_SQL} FROM f GROUP BY lang""")
def complementarity_filtered(t):
    dirty = F.expr("CASE model WHEN 'quality' THEN n_chars < 500 ELSE n_chars < 200 OR n_chars > 9000 END")
    return R.complementarity(labelled(t).withColumn("dirty", dirty), ["lang"], "doc_id", "model", "pass", "quality", "toxic", "dirty")


@query("""WITH s AS (SELECT l_suppkey, coalesce(avg(l_quantity) FILTER (WHERE l_returnflag <> 'N'), 0) AS own, coalesce(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS held
FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(own, 6) AS own, round(held, 6) AS held, round(CASE WHEN abs(own) < 1e-6 THEN 0 ELSE held / own END, 6) AS ratio FROM s""")
def opt_heldout_transfer(t):
    held = F.col("l_returnflag") == "N"
    g = t.lineitem.groupBy("l_suppkey").agg(
        F.coalesce(F.avg(F.when(~held, F.col("l_quantity"))), F.lit(0.0)).alias("own"), F.coalesce(F.avg(F.when(held, F.col("l_quantity"))), F.lit(0.0)).alias("held")
    )
    return g.select("l_suppkey", F.round("own", 6).alias("own"), F.round("held", 6).alias("held"), F.round(S.transfer_ratio(F.col("held"), F.col("own")), 6).alias("ratio"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_skipped,
count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS n_pass,
round(count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) / greatest(count(*) - count(*) FILTER (WHERE o_orderstatus = 'P'), 1), 6) AS rate
FROM orders GROUP BY ALL""")
def probe_eligible_rate(t):
    skipped, good = F.col("o_orderstatus") == "P", (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(skipped).alias("n_skipped"), F.count_if(good).alias("n_pass"))
    return g.withColumn("rate", F.round(F.col("n_pass") / F.greatest(F.col("n") - F.col("n_skipped"), F.lit(1)), 6))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS mid, count(*) FILTER (WHERE l_discount > 0.05) AS n_over, count(*) AS n FROM lineitem GROUP BY ALL""")
def threshold_stats(t):
    """AGG15, AGG16."""
    keys = ["l_returnflag", "l_linestatus"]
    mids = O.exact_percentiles(t.lineitem.select(*keys, "l_quantity"), keys, "l_quantity", {"mid": 0.5}).select(*keys, "mid")
    g = t.lineitem.groupBy(*keys).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("n_over"), F.count("*").alias("n"))
    return g.join(mids, keys)


@query("""SELECT event_type, CASE WHEN avg(value) > 255 AND count(*) > 150 THEN 'STRONG' WHEN avg(value) > 248 THEN 'PASS' WHEN max(value) > 480 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict,
CASE WHEN avg(value) > 300 THEN 'high' WHEN avg(value) > 200 THEN 'middle' ELSE 'low' END AS tier FROM events GROUP BY ALL""")
def verdict(t):
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.max("value").alias("x"), F.count("*").alias("n"))
    gates = F.when((F.col("m") > 255) & (F.col("n") > 150), "STRONG").when(F.col("m") > 248, "PASS").when(F.col("x") > 480, "PARTIAL").otherwise("FAIL")
    return g.select("event_type", gates.alias("verdict"), S.tiers(F.col("m"), [(300, "high"), (200, "middle")], "low").alias("tier"))


RESULT_SQL = """SELECT l_orderkey AS image, l_returnflag AS model, round_even(l_discount, 6) AS eps, round_even(l_tax, 4) AS kappa,
coalesce(l_linestatus = 'O', false) AND coalesce(CASE WHEN l_quantity <> 13 THEN l_quantity - 20 END, 0) > 0 AS pass, {'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice} AS o FROM lineitem"""


@query(f"""SELECT image, eps, kappa, bool_or(p) FILTER (WHERE model = 'A') AS pass_a, bool_or(p) FILTER (WHERE model = 'N') AS pass_n, bool_or(p) FILTER (WHERE model = 'R') AS pass_r
FROM (SELECT image, model, eps, kappa, max_by(pass, o) AS p FROM ({RESULT_SQL}) GROUP BY ALL) GROUP BY ALL""")
def pass_matrix(t):
    """AGG5, FIL5: results by rounded configuration and image, a column for each
    model; of several records the last counts, a missing value fails."""
    delta = F.when(F.col("l_quantity") != 13, F.col("l_quantity") - 20)
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("model"), F.bround("l_discount", 6).alias("eps"), F.bround("l_tax", 4).alias("kappa"),
        R.passed(F.col("l_linestatus") == "O", delta).alias("pass"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    last = R.last_wins(rows, ["image", "model", "eps", "kappa"], "pass", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    wide = last.groupBy("image", "eps", "kappa").pivot("model", ["A", "N", "R"]).agg(F.bool_or("pass"))
    return wide.select("image", "eps", "kappa", *[F.col(m).alias(f"pass_{m.lower()}") for m in "ANR"])


@query("SELECT list_sort(list(DISTINCT event_type)) AS types, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events")
def distinct_sorted(t):
    return t.events.agg(F.sort_array(F.collect_set("event_type")).alias("types"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@query("""SELECT CAST(e.eps AS DOUBLE) AS eps, CAST(k.kappa AS DOUBLE) AS kappa, r_name, printf('%.5f_%.4f_%04d', e.eps, k.kappa, r_regionkey) AS name
FROM (VALUES (0.00784), (0.01569), (0.03137)) e(eps), (VALUES (0.05), (0.1)) k(kappa), region""")
def sweep_cross(t):
    grid = R.sweep(t.spark, [0.00784, 0.01569, 0.03137], [0.05, 0.1])
    return t.region.crossJoin(F.broadcast(grid)).select("eps", "kappa", "r_name", F.format_string("%.5f_%.4f_%04d", "eps", "kappa", "r_regionkey").alias("name"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 250) AS n_over, round(avg(value) * 250 / 60, 6) AS minutes FROM events GROUP BY ALL""")
def step_projection(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 250).alias("n_over"), F.round(F.avg("value") * 250 / 60, 6).alias("minutes"))


@query("SELECT lang, source, count(*) AS planned, count(*) FILTER (WHERE n_chars < 50) AS skipped, count(*) FILTER (WHERE n_chars >= 50) AS processed FROM documents GROUP BY ALL")
def render_plan_counts(t):
    """AGG4, AGG31."""
    short = F.col("n_chars") < 50
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("planned"), F.count_if(short).alias("skipped"), F.count_if(~short).alias("processed"))


@query("""SELECT l_orderkey, l_linenumber, 'l_discount' AS series, l_discount AS y FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def plot_series(t):
    """SNK11: an order as a run, its lines as steps."""
    return R.series(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_discount", "l_tax"])
