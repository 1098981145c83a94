"""Operators that SQL can't check, or whose adverse cases the tables lack, against
plain Python."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import arrow, content as C, scores as S, text as T
from inkwell.operators import boxes as B, importance as I, masks as M, ordered as O
from inkwell.plans import content as plan
from inkwell.sources import files, sinks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert arrow.edit_distance(a, b) == distance(a, b)


def test_wrapping():
    rng = random.Random(2)
    for _ in range(200):
        words = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 40))]
        width = rng.randint(3, 25)
        lines = arrow.lines_of(words, width)
        assert "".join(lines).replace(" ", "") == "".join(words) and all(len(x) <= width for x in lines)
        for a, b in zip(lines, lines[1:]):  # greedy: the next piece would not have fitted
            assert len(a) + 1 + len(b.split(" ")[0]) > width


def plain_first_fit(boxes, radius):
    groups, out = [], []
    for b in boxes:
        def clash(o, b=b):
            over = b[0] < o[2] and b[2] > o[0] and b[1] < o[3] and b[3] > o[1]
            near = radius is not None and math.dist(((b[0] + b[2]) / 2, (b[1] + b[3]) / 2), ((o[0] + o[2]) / 2, (o[1] + o[3]) / 2)) <= radius
            return over or near

        g = next((i for i, m in enumerate(groups) if not any(map(clash, m))), len(groups))
        if g == len(groups):
            groups.append([])
        groups[g].append(b)
        out.append(g)
    return out


@pytest.mark.parametrize(("radius", "strip"), [(None, "0"), (15, "0"), (15, "pos div 7"), (None, "pos div 25")])
def test_first_fit(spark, radius, strip):
    """The same groups whatever the strips, one of them with all boxes in a heap."""
    rng = random.Random(3)
    rows = []
    for image in range(6):
        for pos in range(rng.choice([0, 1, 5, 60])):
            x, y = rng.randint(0, 80), rng.randint(0, 60)
            rows.append((image, pos, x, y, x + rng.randint(1, 30), y + rng.randint(1, 12)))
    rows += [(9, pos, 5 + pos % 3, 5, 20, 9) for pos in range(70)]
    df = spark.createDataFrame(rows, "image long, pos int, x0 int, y0 int, x1 int, y1 int")
    found = M.first_fit(df, M.conflicts(df, "image", "pos", radius), "image", "pos", F.expr(strip))
    got = {(r.image, r.pos): r.group_id for r in found.collect()}
    assert len(got) == len(rows) and M.first_fit(df.limit(0), M.conflicts(df.limit(0), "image", "pos", radius), "image", "pos", F.expr(strip)).count() == 0
    for image in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == image]
        assert [got[image, r[1]] for r in own] == plain_first_fit([r[2:] for r in own], radius)


def test_masked_passes(spark):
    """What is hidden and whose score it gives, against plain Python."""
    rng = random.Random(5)
    rows = [(k % 2, k, x := rng.randint(0, 300), y := rng.randint(0, 60), x + rng.randint(1, 40), y + 12) for k in range(60)]
    df = spark.createDataFrame(rows, "image long, pos int, x0 int, y0 int, x1 int, y1 int")
    groups = M.first_fit(df, M.conflicts(df, "image", "pos", 40), "image", "pos", F.lit(0))
    own = {r.pos: r.group_id for r in groups.collect()}
    hidden = {tuple(r) for r in M.hidden(df, groups, "image", "pos", 40).select("image", "group_id", "pos").collect()}
    centre = {r[1]: ((r[2] + r[4]) / 2, (r[3] + r[5]) / 2) for r in rows}
    assert hidden == {(a[0], own[a[1]], b[1]) for a in rows for b in rows if a[0] == b[0] and math.dist(centre[a[1]], centre[b[1]]) <= 40}
    passes = df.select("image", "pos", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("group_id")).withColumn("lp", F.col("pos") * 100 + F.col("group_id")).filter("pos <> 7")
    got = {r.pos: r.lp for r in M.scattered(groups, passes, "image", "pos").collect()}
    assert got == {k: k * 100 + g for k, g in own.items() if k != 7}


def test_near_and_overlap(spark):
    rng = random.Random(4)
    rows = [(k % 2, k, x := rng.randint(0, 300), y := rng.randint(0, 200), x + rng.randint(1, 200), y + rng.randint(1, 30)) for k in range(120)]
    df = spark.createDataFrame(rows, "image long, pos int, x0 int, y0 int, x1 int, y1 int")
    got = {tuple(r) for r in B.near_pairs(df, "image", 40).select("a.pos", "b.pos").collect()}
    centre = lambda r: ((r[2] + r[4]) / 2, (r[3] + r[5]) / 2)
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and math.dist(centre(a), centre(b)) <= 40}
    lists = {r.pos: r.near for r in B.context_lists(df.withColumn("id", F.col("pos").cast("long")), "image", 40, "id", ("pos",)).collect()}
    assert lists == {a[1]: sorted(b for x, b in got if x == a[1]) for a in rows}
    pairs = [tuple(r) for r in B.overlapping(df, df, ["image"], "x0", "x1", 32).select("a.pos", "b.pos").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[4] and b[2] < a[4]}


def test_percentiles(spark):
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", 3.0)] * 40 + [("c", float(rng.randint(0, 3))) for _ in range(77)] + [("d", None), ("e", 1.0), ("e", 2.0), (None, 5.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in O.exact_percentiles(df, ["k"], "v", {"p99": 0.99, "mid": 0.5, "low_": 0.0}, bins=16).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None} and got["d"].mid is None
    for k in ("a", "b", "c", "e", None):
        v = [x for g, x in rows if g == k]
        assert np.allclose([got[k].p99, got[k].mid, got[k].low_, got[k].high], [np.percentile(v, 99), np.percentile(v, 50), min(v), max(v)])


def test_running(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), d := rng.randint(0, 50), k, rng.randint(1, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, day int, k int, n int").repartition(5)
    got = {r.k: (r.total, r.place) for r in O.running(df, ["g"], ["day", "k"], F.floor(F.col("day") / 7), total=F.col("n"), place=F.lit(1)).collect()}
    for g in "ab":
        total = 0
        for place, (_, _, k, n) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            total += n
            assert got[k] == (total, place)


def test_anchored(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, 3, None]), start + timedelta(minutes=rng.randint(0, 3000)), k) for k in range(300)]
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz, k long").repartition(4)
    got = {r.k: r.gid for r in O.anchored_groups(df, "u", "ts", "k", timedelta(hours=2)).collect()}
    for u in (1, 2, 3, None):
        anchor, gid = None, 0
        for _, ts, k in sorted((r for r in rows if r[0] == u), key=lambda r: r[1:]):
            if anchor is None or ts - anchor > timedelta(hours=2):
                anchor, gid = ts, gid + 1
            assert got[k] == gid


def test_anchored_hot_key(spark):
    """One user with most rows, in chains of some 400 groups; no Python worker,
    and no window or join by the key alone but over what stands for stretches."""
    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(minutes=7 * k), k) for k in range(6000)] + [(2, start + timedelta(minutes=7 * k), 6000 + k) for k in range(50)] + [(1, None, 9000)]
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz, k long").repartition(4)
    found = O.anchored_groups(df, "u", "ts", "k", timedelta(hours=2))
    assert {r.k: r.gid for r in found.collect()} == {k: None if ts is None else k % 6000 // 18 + 1 for _, ts, k in rows}
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Python" not in plan and "InArrow" not in plan


def test_headers(spark):
    rows = [(1, 0, "TOTAL:", 0), (1, 1, "DUE", 0), (1, 2, "Total", 20), (1, 3, "NOW", 20), (1, 4, "ALONE", 40), (1, 5, "A", 60), (1, 6, "CODE", 80), (1, 7, "123", 80), (2, 0, "--", 0), (2, 1, "HEAD", 4)]
    df = spark.createDataFrame([(*r[:3], r[3], r[3] + 12) for r in rows], "image long, pos int, word string, y0 int, y1 int")
    df = df.withColumn("core", T.header_core(F.col("word")))
    found = B.section_boundaries(df, "image", T.is_header_word(F.col("word")), (F.col("core") != "") & ~T.is_upper(F.col("core")))
    assert sorted((r.image, r.pos) for r in found.collect()) == [(1, 0), (1, 1), (1, 4), (2, 1)]


def test_ground_truth(spark):
    schema = C.item_schema()
    items = [
        ("banking", {"bank_name": " B ", "opening_balance": "1", "transactions": [{"date": "d", "description": "x", "amount": "-2", "running_balance": None}], "summary_note": "  "}),
        ("identity", {"surname": "S", "additional_fields": {"a": "1", "b": "", "c": None}, "security_features": ["f", " "]}),
        ("communications", {"comm_type": "sms", "subject": None, "messages": [{"sender": "p", "text": "hi"}]}),
        ("other", {"title": "t"}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in items], "category string, j string").select("category", F.from_json("j", schema).alias("i")).select("category", "i.*")
    got = {r.category: r.t for r in df.select("category", C.ground_truth(F.col, F.col("category")).alias("t")).collect()}
    pages = {r.category: r.t for r in df.select("category", C.page(F.col, F.col("category")).alias("t")).collect()}
    assert pages["banking"].startswith('<article class="banking"><h1> B </h1>') and '<td class="debit">-2</td>' in pages["banking"] and pages["other"] is None
    assert "<tr><th>A</th><td>1</td></tr></table>" in pages["identity"] and '<div class="other"><b>p</b><p>hi</p></div>' in pages["communications"]
    assert got == {"banking": "B\nOpening: 1 Closing:\nd x -2", "identity": "S\n1\nf", "communications": "sms\np hi", "other": None}


def test_generated_texts(spark):
    """Formats, proportions, and that a key's result depends on nothing else."""
    tables = type("Tables", (), {"customer": spark.range(4000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"))})
    rows = plan.gen_text(tables).collect()
    assert not any("%" in x for r in rows for x in (r.short_structured, r.name_entity, r.natural_phrase, r.semi_structured, *r.lines, *r.pairs))
    assert all(len(r.lines) in (2, 3) and len(r.pairs) in (2, 3) and len({x.split(":")[0] for x in r.pairs}) == len(r.pairs) and all(x.split(":")[0] in plan.KEYS for x in r.pairs) for r in rows)
    assert {r.dominant for r in rows} == {"natural_phrase", "semi_structured", "short_structured"} and len({r.short_structured for r in rows}) > 1000
    ids = plan.gen_ids(tables).collect()
    assert all(__import__("re").fullmatch(r"\d{3}-\d{3}  \d{4} \d{4} \d{2}", r.account) for r in ids) and {r.patient.split("-")[0] for r in ids} == {"P", "MR", "PT", "HC"}
    mix = plan.layout_mix(tables).collect()
    share = lambda f: sum(map(f, mix)) / len(mix)
    assert abs(share(lambda r: r.layout == "single_line") - 0.6) < 0.04 and abs(share(lambda r: r.layout == "multi_line") - 0.2) < 0.03
    assert abs(share(lambda r: r.bold) - 0.35) < 0.04 and abs(share(lambda r: r.background == "plain") - 2 / 3) < 0.04 and len({(r.width, r.height) for r in mix}) == 16
    spec = plan.layout_spec(tables).collect()
    assert all(r[n] in v for r in spec for n, v in plan.LAYOUT.items()) and all(15 <= r.text_color[0] <= 35 and len(set(r.text_color)) == 1 and 120 <= r.good_color[1] <= 160 for r in spec)
    tables.customer = tables.customer.filter("c_custkey % 3 = 0").orderBy(F.desc("c_custkey")).repartition(7)
    assert {tuple(r) for r in plan.layout_mix(tables).collect()} <= {tuple(r) for r in mix}


def test_importance_edges(spark):
    df = spark.createDataFrame([(1, 0, "m", 2.0), (1, 1, "m", 4.0), (2, 0, "m", 0.0)], "image long, pos int, model string, norm double")
    got = {(r.image, r.pos): r.salience for r in I.salience(df, {"m": 1.0}, 0.01, 0.05).collect()}
    assert abs(got[1, 1] - 1) < 1e-9 and 0.45 < got[1, 0] < 0.55 and got[2, 0] == 0
    tops = spark.createDataFrame([(1, 0, "m", [[-0.1, -2.0]]), (1, 1, "m", None), (1, 2, "x", [[-0.1, -2.0]])], "image long, pos int, model string, top array<array<double>>")
    assert {r.pos: round(r.entropy, 6) for r in I.blank_entropy(tops, {"m": 0.5, "x": 0.5}, ("x",)).collect()} == {0: 1.0, 1: 0.0}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lp = F.array(F.lit(-1.0), F.lit(-2.0))
    assert [one(I.span_sum(lp, F.lit(a), F.lit(b))) for a, b in ((0, 2), (1, 9), (2, 3), (5, 6))] == [-3.0, -2.0, 0.0, 0.0]
    assert one(I.span_mean(lp, F.lit(0), F.lit(2))) == -1.5 and one(S.ratio(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(S.first_position(F.array(F.lit("a"), F.lit("Bob")), F.lit("Emily"))) == (1, "Bob") and one(S.first_position(F.array(F.lit("a")), F.lit("Emily"))) == (0, "a")


def test_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    line = lambda k, **x: json.dumps({"image_id": f"i{k}", "image_path": "p", "full_text": "t", **x})
    (tmp_path / "a/labels.jsonl").write_text("\n\n".join(line(k, split="train" if k % 2 else "test") for k in range(9)))
    (tmp_path / "b/labels.jsonl").write_text(line(9, split="train"))
    got = files.labels(spark, str(tmp_path / "a"), more=str(tmp_path / "b"), cap=4, split="train", contrast_level="")
    assert [r.image_id for r in got.orderBy("ord").collect()] == ["i1", "i3", "i5", "i7"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.labels(spark, str(tmp_path / "none")).count()
    (tmp_path / "bad.json").write_text('{"foo": 1}')
    with pytest.raises(ValueError, match="neither"):
        files.content_bank(spark, str(tmp_path / "bad.json"), "title string")
    assert files.first_existing(("x.ttf", "a/labels.jsonl"), str(tmp_path), "d") == "a/labels.jsonl" and files.first_existing(("x",), str(tmp_path), "d") == "d"
    rows = spark.createDataFrame([(k, "html" if k % 2 else "pil") for k in range(50)], "k int, render_mode string").repartition(2)
    sinks.write_lines_and_array(rows, str(tmp_path / "out"), "labels_ui", "render_mode")
    assert spark.read.json(str(tmp_path / "out/labels_ui.jsonl")).count() == 50
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "out/labels_ui.json").rglob("part-*")]
    assert sorted(x["k"] for a in arrays for x in a) == list(range(50)) and all(len({x["render_mode"] for x in a}) == 1 for a in arrays)
    sinks.write_lines_and_array(rows, str(tmp_path / "one"))
    assert sorted(x["k"] for p in (tmp_path / "one/labels.json").glob("part-*") for x in json.loads(p.read_text())) == list(range(50))


def plain_alignment(words, text, offsets, n):
    """Word by word over all tokens."""
    words, spans, at = words[:n], [], 0
    for w in words:
        k = text.find(w, at)
        if k < 0:
            break
        at = k + len(w)
        own = [i for i, (a, b) in enumerate(offsets) if b > k and a < at]
        spans.append((own[0], own[-1] + 1) if own else (0, 1))
    if len(spans) < n:
        return [(int(i * len(offsets) / n), max(int(i * len(offsets) / n) + 1, int((i + 1) * len(offsets) / n))) for i in range(n)]
    return spans


def test_alignment():
    rng = random.Random(9)
    for _ in range(300):
        words = ["".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]
        text = rng.choice([" ", "  ", "\n"]).join(words)
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(0, 8))))
        offsets = [(a + rng.randint(0, 1) * (b - a > 1), b) for a, b in zip(cuts, cuts[1:])]
        if rng.random() < 0.3 and words:
            words = [*words[:-1], words[-1] + "?"]
        n = max(0, len(words) + rng.randint(-2, 2))
        starts, stops = (np.array(x, np.int64) for x in (list(zip(*offsets)) or [[], []]))
        assert arrow.aligned(words, text, starts, stops, n) == plain_alignment(words, text, offsets, n)


def test_log_of_zero(spark):
    """Minus infinity, as in SQL, not null: the row stays."""
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    kl = df.select(S.log(F.col("a")).alias("x"), S.visual_kl(S.log(F.col("a")), S.log(F.col("b"))).alias("kl")).collect()
    assert [r.x for r in kl] == [-math.inf, 0.0, -math.inf, None]
    assert kl[0].kl == 0 and kl[1].kl == math.inf and math.isnan(kl[2].kl)


def test_spans_are_numbers(spark):
    """Results of whole texts are Arrow lists, not an object for each word, and
    batches of texts are small unless the session says otherwise."""
    from inkwell.registry import Tables

    found = arrow.span_lists(iter([[(0, 2), (3, 4)], None, [], [(5, 9)]]))
    assert found.to_pylist() == [[{"start": 0, "stop": 2}, {"start": 3, "stop": 4}], None, [], [{"start": 5, "stop": 9}]]
    assert arrow.span_lists(iter([])).to_pylist() == []
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for own, then in (("10000", "512"), ("77", "77")):
            spark.conf.set(rows, own)
            Tables(spark, "")
            assert spark.conf.get(rows) == then
    finally:
        spark.conf.set(rows, before)
