"""Profiles, filters, projections, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..registry import query


@query("""SELECT 'lang' AS attribute, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL""")
def dataset_counts(t):
    pairs = F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    return t.documents.select(pairs.alias("attribute", "value")).groupBy("attribute", "value").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, coalesce(min(n_chars), 0) AS low, coalesce(max(n_chars), 0) AS high, round(coalesce(avg(n_chars), 0), 6) AS mean, count(*) FILTER (WHERE regexp_matches(text, '[O0I1l]')) AS n_ambiguous FROM documents""")
def dataset_summary(t):
    c = F.col("n_chars")
    return t.documents.agg(
        F.count("*").alias("n"), F.coalesce(F.min(c), F.lit(0)).alias("low"), F.coalesce(F.max(c), F.lit(0)).alias("high"),
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mean"), F.count_if(F.col("text").rlike("[O0I1l]")).alias("n_ambiguous"),
    )


@query("""SELECT d.segment, count(c_custkey) AS n FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('SPACE')) d(segment) LEFT JOIN customer ON c_mktsegment = d.segment GROUP BY ALL""")
def fixed_domain_counts(t):
    domain = t.spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("SPACE",)], "segment string")
    counts = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("c"))
    return domain.join(counts, domain.segment == counts.c_mktsegment, "left").select("segment", F.coalesce("c", F.lit(0)).alias("n"))


@query("""SELECT l.doc_id, 'train' AS split, coalesce(d.lang, 'unknown') AS lang, coalesce(d.n_chars, 0) AS n_chars, l.quality, l.toxic, printf('%04d', l.doc_id) AS name
FROM labels l LEFT JOIN documents d USING (doc_id)""")
def metadata_projection(t):
    joined = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", "left")
    return joined.select(
        "doc_id", F.lit("train").alias("split"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "quality", "toxic",
        F.format_string("%04d", "doc_id").alias("name"),
    )


def optional_filters(df, **equal):
    """FIL1, FIL3: equality filters; an empty value switches one off, a list
    means any of its values."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('fr', 'de') AND source = 'src0' ORDER BY doc_id LIMIT 20")
def multi_filter_limit(t):
    return optional_filters(t.documents, lang=["fr", "de"], source="src0", split="").orderBy("doc_id").limit(20).select("doc_id", "lang", "source")


@query("""SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rn FROM documents WHERE length(text) >= 8) WHERE rn <= 5""")
def min_length_reject(t):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return t.documents.filter(F.char_length("text") >= 8).select("lang", "doc_id", F.row_number().over(w).alias("rn")).filter("rn <= 5")


@query("""SELECT lang, doc_id, CAST(attempt AS INTEGER) AS attempt, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY attempt) AS place FROM
(SELECT lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS attempt FROM documents) WHERE attempt <= 24 AND n >= 900) WHERE place <= 8""")
def retry_until(t):
    """FIL8, FIL10: eight texts of each language that are long enough, within
    three times as many attempts."""
    rows = t.documents.select("lang", "doc_id", F.char_length("text").alias("n"))
    return O.until(rows, ["lang"], ["doc_id"], F.col("n") >= 900, 8, 3).drop("n")


@query("""SELECT printf('%04d', doc_id) AS image_id, 'images/' || printf('%04d', doc_id) || '.png' AS image_path, trim(text) AS full_text, 'ui_web' AS domain, source AS category, 'browser' AS render_mode, doc_id * 31 % 1009 AS render_seed,
'train' AS split, false AS has_ambiguous_chars, 'web_portal' AS layout_type, source AS text_category FROM documents""")
def annotations(t):
    """PRJ3: the annotation of a rendered item, with its fixed values."""
    image = F.format_string("%04d", "doc_id")
    return t.documents.select(
        image.alias("image_id"), F.concat(F.lit("images/"), image, F.lit(".png")).alias("image_path"), F.trim("text").alias("full_text"), F.lit("ui_web").alias("domain"), F.col("source").alias("category"),
        F.lit("browser").alias("render_mode"), (F.col("doc_id") * 31 % 1009).alias("render_seed"), F.lit("train").alias("split"), F.lit(False).alias("has_ambiguous_chars"), F.lit("web_portal").alias("layout_type"), F.col("source").alias("text_category"),
    )


@query("""WITH h AS (SELECT c_mktsegment AS seg, count(*) AS have FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), w AS (SELECT c_mktsegment AS seg, 120 AS want FROM customer GROUP BY ALL)
SELECT seg, coalesce(have, 0) AS have, greatest(0, want - coalesce(have, 0)) AS need FROM w LEFT JOIN h USING (seg)""")
def resume_need(t):
    have = t.customer.filter("c_custkey % 2 = 0").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("have"))
    wanted = t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()
    return wanted.join(have, "seg", "left").select("seg", F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), 120 - F.coalesce("have", F.lit(0))).alias("need"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def union_all_items(t):
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return rows.filter("k % 2 = 0").unionByName(rows.filter("k % 3 = 0"))


TOP_SQL = "SELECT * FROM (SELECT p_partkey FROM part ORDER BY {0} DESC, p_partkey LIMIT 10)"


@query(f"""WITH a AS ({TOP_SQL.format('p_retailprice')}), b AS ({TOP_SQL.format('p_size * 1000 + p_partkey % 977')})
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'left_only' WHEN a.p_partkey IS NULL THEN 'right_only' ELSE 'both' END AS tag
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def top_set_compare(t):
    def top(e, name):
        return t.part.orderBy(F.expr(e).desc(), "p_partkey").limit(10).select(F.col("p_partkey").alias(name))

    a, b = top("p_retailprice", "x"), top("p_size * 1000 + p_partkey % 977", "y")
    tag = F.when(F.col("y").isNull(), "left_only").when(F.col("x").isNull(), "right_only").otherwise("both")
    return a.join(b, F.col("x") == F.col("y"), "full_outer").select(F.coalesce("x", "y").alias("p_partkey"), tag.alias("tag"))


@query("""WITH x AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), y AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT k FROM x INTERSECT SELECT k FROM y) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM x EXCEPT SELECT k FROM y) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM x UNION SELECT k FROM y)""")
def set_operations(t):
    x, y = (t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    named = {"intersect": x.intersect(y), "except": x.subtract(y), "union": x.union(y).distinct()}
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, d in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT n_nationkey, coalesce(CASE n_regionkey WHEN 0 THEN 'navy' WHEN 1 THEN 'teal' WHEN 2 THEN 'grey' END, 'black') AS colour FROM nation""")
def lookup_default(t):
    palette = F.create_map(*[F.lit(x) for p in ((0, "navy"), (1, "teal"), (2, "grey")) for x in p])
    return t.nation.select("n_nationkey", F.coalesce(F.try_element_at(palette, "n_regionkey"), F.lit("black")).alias("colour"))


@query("""WITH p AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(list_filter(p, lambda x: x.role = 'assistant')[1].text, 'Me') AS own, coalesce(list_filter(p, lambda x: x.role <> 'assistant')[1].text, p[1].text) AS other, len(list_filter(p, lambda x: x.role = 'assistant')) AS n_own FROM p""")
def first_match(t):
    own, order = F.col("role") == "assistant", F.struct("turn", "role", "text")
    first = lambda c: F.min_by("text", F.when(c, order))
    return t.conversations.groupBy("conv_id").agg(
        F.coalesce(first(own), F.lit("Me")).alias("own"), F.coalesce(first(~own), F.min_by("text", order)).alias("other"), F.count_if(own).alias("n_own")
    )


@query("SELECT conv_id, turn, role = 'assistant' AS is_own, text = first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opens FROM conversations")
def own_messages(t):
    """JN14: which messages are the speaker's own, and which repeat the first."""
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", (F.col("role") == "assistant").alias("is_own"), (F.col("text") == first).alias("opens"))


def by_index(rows, wanted: list[int], key: str):
    """JN15: the rows that a list names; what is not there is dropped silently,
    and where nothing is there, all rows stay."""
    found = rows.filter(F.col(key).isin(wanted))
    none = found.limit(1).agg((F.count("*") == 0).alias("_none"))
    return rows.crossJoin(F.broadcast(none)).filter(F.col(key).isin(wanted) | F.col("_none")).drop("_none")


@query("SELECT 'some' AS list, count(*) AS n FROM documents WHERE doc_id IN (3, 5, 99999999) UNION ALL SELECT 'none', count(*) FROM documents")
def semi_join_fallback(t):
    some, none = (by_index(t.documents, x, "doc_id").agg(F.count("*").alias("n")) for x in ([3, 5, 99999999], [99999999]))
    return some.select(F.lit("some").alias("list"), "n").unionByName(none.select(F.lit("none").alias("list"), "n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 99999999)")
def semi_join_indices(t):
    wanted = t.spark.createDataFrame([(3,), (5,), (8,), (99999999,)], "doc_id long")
    return t.documents.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT c_nationkey, mktsegment FROM (SELECT c_nationkey, c_mktsegment AS mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE r = 1""")
def mode_category(t):
    counts = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("c"))
    return counts.groupBy("c_nationkey").agg(F.min_by("mktsegment", F.struct(-F.col("c"), F.col("mktsegment"))).alias("mktsegment"))


@query("SELECT p_partkey, to_base64(encode(p_name)) AS b64, CASE WHEN abs(p_retailprice) >= 0.01 THEN printf('%.4f', p_retailprice) ELSE printf('%.3e', p_retailprice) END AS shown FROM part")
def float_format(t):
    from ..functions.text import compact_number

    return t.part.select("p_partkey", F.base64(F.encode("p_name", "UTF-8")).alias("b64"), compact_number(F.col("p_retailprice")).alias("shown"))


@query("SELECT n_nationkey, n_nationkey % 5 AS col, n_nationkey // 5 AS row, 100 + ((400 - 60 - n_nationkey) // 2) AS x, CAST(trunc(800 * (1 + n_nationkey % 3) / 6.0) AS INTEGER) AS px FROM nation")
def grid_layout(t):
    k = F.col("n_nationkey")
    return t.nation.select(
        k, (k % 5).alias("col"), F.expr("cast(n_nationkey div 5 as int)").alias("row"), F.expr("cast(100 + ((400 - 60 - n_nationkey) div 2) as int)").alias("x"),
        (800 * (1 + k % 3) / 6.0).cast("int").alias("px"),
    )


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) AS b FROM orders) WHERE a <= 10 OR b <= 10")
def top_bottom_10(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    top = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return top.unionByName(rows.orderBy("o_totalprice", F.desc("o_orderkey")).limit(10)).distinct()


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL ORDER BY c_nationkey, c_mktsegment")
def sorted_report(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).orderBy("c_nationkey", "c_mktsegment")
