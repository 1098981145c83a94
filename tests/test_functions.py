"""Functions, sources and sinks without tables, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import models
from inkwell.sources import files, sinks
from inkwell.streaming.tail import rolling_pass_rates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abé ", k=rng.randint(0, 8)))
    pairs = [(word(), word()) for _ in range(60)] + [("", ""), ("x", ""), ("", "x"), ("A  b", "a B")]
    df = spark.createDataFrame(pairs, "h string, r string")
    rows = df.select("h", "r", T.cer(F.col("h"), F.col("r")).alias("c"), T.wer(F.col("h"), F.col("r")).alias("w")).collect()
    rate = lambda h, r: distance(h, r) / len(r) if r else float(bool(h))
    for x in rows:
        h, r = (" ".join(s.lower().split()) for s in (x.h, x.r))
        assert abs(x.c - rate(h, r)) < 1e-9
        assert abs(x.w - rate(h.split(), r.split())) < 1e-9


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.clean_prediction(lit(" Assistant\nTranscribe exactly all visible text. Output only the text, nothing else. Hi "))) == "Hi"
    assert one(T.strip_preamble(lit('The image shows: "abc"'))) == "abc"
    assert one(T.strip_thoughts(lit("<think>a\nb</think> c"))) == "c"
    assert one(T.html_escape(lit('a<b>&"'))) == "a&lt;b&gt;&amp;&quot;"
    assert one(T.repair_json(lit('{"a": "M" (iOS), "b": "N" (Android 9), "c": "O" (x)}'))) == '{"a": "iMessage", "b": "Android Messages", "c": "O"}'
    assert [one(T.is_label(lit(w))) for w in ("Name:", "name", "nothing", "x-")] == [True, True, False, True]
    assert [one(T.is_header_word(lit(w))) for w in ("TOTAL:", "Total", "A", "123", "ÉÀ")] == [True, False, False, False, True]
    assert one(T.wrapped(F.split(lit("aa bb cccccc d"), " "), 5)) == ["aa bb", "ccccc", "c d"]
    assert one(T.compact_number(lit(0.001))) == "1.000e-03" and one(T.compact_number(lit(float("nan")))) == "nan"
    assert one(T.forward_spans(F.split(lit("a b a"), " "), lit("a b a")))[-1].start == 4
    assert one(T.forward_spans(F.split(lit("a c"), " "), lit("a b a"))) is None
    assert one(T.paragraphs(lit("a\n\n\n\nb"))) == ["a", "b"] and one(T.paragraphs(lit(""))) == [""]


def test_sources_and_sinks(spark, tmp_path):
    rows = [
        {"image_id": "i1", "image_path": "p", "full_text": "a b", "word_boxes": [[{"word": "a", "box": [0, 0, 5, 5]}], [{"word": "b", "left": 6, "top": 0, "right": 9, "bottom": 5}]]},
        {"image_id": "i2", "image_path": "q", "full_text": "c", "num_chars": 1, "text_category": "x"},
    ]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = files.labels(spark, str(tmp_path))
    assert [(r.image_id, r.num_chars, r.text_category, r.lines) for r in got.orderBy("image_id").collect()] == [("i1", 0, "unknown", ["a b"]), ("i2", 1, "x", ["c"])]
    assert [tuple(r) for r in files.flat_words(got).orderBy("pos").collect()] == [("i1", 0, "a", 0, 0, 5, 5), ("i1", 1, "b", 6, 0, 9, 5)]

    log = str(tmp_path / "log")
    df = spark.createDataFrame([("i1", "m", True, 0.1, False), ("i2", "m", True, -0.1, True)], "image_id string, model_name string, constraint_satisfied boolean, cer_delta double, is_held_out boolean")
    sinks.append_results(df, log)
    sinks.append_event(spark, log, "run_finished", elapsed=3)
    assert files.results(spark, log).count() == 1 and files.results(spark, log, True).count() == 2 and files.events(spark, log).count() == 1

    (tmp_path / "bank.json").write_text(json.dumps([{"title": "t", "_category": "news", "_content_id": "n_0001"}]))
    (tmp_path / "old.json").write_text(json.dumps({"items": [{"data": {"title": "u"}, "category": "news", "content_id": "n_0002"}]}))
    assert [tuple(r) for n in ("bank", "old") for r in files.content_bank(spark, str(tmp_path / f"{n}.json"), "title string").collect()] == [("t", "news", "n_0001"), ("u", "news", "n_0002")]
    assert files.resumed(spark, str(tmp_path / "none"), "a int").count() == 0

    for n in ("Courier-x.ttf", "Georgia.otf", "Arial.ttf"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.family for r in files.fonts(spark, str(tmp_path)).collect()) == ["mono", "sans", "serif"]
    steps = spark.createDataFrame([("i", 0.1, 0.2, 1, 5.0), ("i", 0.1, 0.2, 0, 4.0)], "image_id string, epsilon double, kappa double, step int, fm double")
    sinks.write_trajectories(steps, str(tmp_path / "runs"))
    doc = spark.read.json(str(tmp_path / "runs")).first()
    assert doc.name == "i_eps0.10000_k0.20000.json" and [s.step for s in doc.steps] == [0, 1]
    sinks.write_lines_and_array(steps, str(tmp_path / "both"))
    assert spark.read.json(str(tmp_path / "both/labels.jsonl")).count() == 2


def test_models(spark):
    df = spark.createDataFrame([("i", "hello all", "a bb")], "image_id string, image string, text string")
    assert models.transcribe(df, "echo").first().transcript == "he11o a11"
    assert models.token_logprobs(df, "echo").first().lp == [-0.1, -0.2]
    assert models.token_logprobs(df, "echo", top_k=2).first().top == [[-0.1, -0.6], [-0.2, -0.7]]
    assert [round(x, 6) for x in models.losses(df.withColumn("reference", F.col("image")), "echo").first()[1:]] == [0.15, -1.0]
    asked = spark.createDataFrame([("news", 2), ("none", 3)], "category string, n int")
    assert sorted(r.item.title for r in models.generated(asked, "echo", "title:string").collect()) == ["news 0", "news 1"]


def test_rolling_rates(spark, tmp_path):
    rows = [{"image_id": "a", "model_name": "m", "constraint_satisfied": True, "cer_delta": d, "_timestamp": t} for d, t in ((0.1, 10.0), (0.0, 20.0), (0.2, 90_000.0))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(map(json.dumps, rows)))
    from inkwell.streaming.tail import log_stream

    q = rolling_pass_rates(log_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, r.n_pass) for r in spark.table("rates").collect()) == [(1, 1), (2, 1)]
