"""Top-k, licences, chat, chunks, tokens and scores on odd and adverse tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, chat, chunks, knn, licenses, toxicity

RNG = random.Random(12)
WORDS = ["".join(RNG.choices("abcdefgho", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def brute_top(rows, is_query, k):
    out = []
    for q in sorted({(i, tuple(x)) for i, x in rows if is_query(i)}):
        found = sorted((-max(-knn.LONGEST, min(knn.LONGEST, sum(int(a) * int(b) for a, b in zip(q[1], x)))), i) for i, x in rows if i != q[0])
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "one point", "huge", "huge query", "hot id", "many queries"])
def test_topk(spark, monkeypatch, shape):
    rng = np.random.default_rng(5)
    rows = [(i, np.floor(64 * rng.normal(0, 1, 6)).tolist()) for i in range(400)]
    if shape == "clusters":
        centres = rng.normal(0, 400, (5, 6))
        rows = [(i, np.floor(centres[i % 5] + rng.normal(0, 5, 6)).tolist()) for i in range(900)]
    elif shape == "one point":
        rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    elif shape == "huge":
        rows += [(1000, [2.0**120] * 6), (1001, [-(2.0**120)] * 6), (1002, [2.0**30] * 6), (1003, [2.0**31 + 1, 1.0, 0.0, 0.0, 0.0, 3.0])]
    elif shape == "huge query":
        rows += [(1020, [2.0**100, -(2.0**99), 1.0, 1.0, 1.0, 1.0]), (1040, [2.0**29, 2.0**28 + 1, 5.0, 5.0, 5.0, 5.0])]
    elif shape == "hot id":
        rows += [(20, np.floor(640 * rng.normal(0, 1, 6)).tolist()) for _ in range(200)]
    elif shape == "many queries":
        monkeypatch.setattr(knn, "PIVOTS", 3)
        monkeypatch.setattr(knn, "TEAM_QUERIES", 7)
        monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    every = 2 if shape == "many queries" else 20
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = sorted(map(tuple, knn.top_k(df, F.col("vec_id") % every == 0).collect()))
    assert got == brute_top(rows, lambda i: i % every == 0, 20)


def test_topk_replicas(spark):
    """Pivots don't depend on the number of queries, and what is clustered in
    directions goes to few groups of queries."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 4000, (12, 16))
    rows = [(i, np.floor(centres[i % 12] + rng.normal(0, 30, 16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for every in (20, 500):
        whole, own = knn.replicas(df, F.col("vec_id") % every == 0)
        assert own <= whole < 0.3
    got = sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 300 == 0).collect()))
    assert got == brute_top(rows, lambda i: i % 300 == 0, 20)


def test_topk_tables(spark):
    rows = [(1, [0.5, 1.0], "x"), (1, [0.5, 1.0], "x"), (2, [3e38, 1e12], "y"), (3, None, "z"), (4, [float("inf"), 1.0], "z"), (20, [1.0, -1.0], "q"), (20, [1.0, -1.0], "q"), (5, [], "e"), (40, [1.0], "d"), (None, [1.0, 1.0], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = sorted(map(tuple, knn.top_k(knn.quantised(df), F.col("vec_id") % 20 == 0).collect()))
    assert got == [(20, 1, 2, knn.LONGEST), (20, 2, 1, -32 * 64), (20, 3, 1, -32 * 64)] or got == [(20, 1, 2, knn.LONGEST), (20, 2, 1, 32 * 64 - 64 * 64), (20, 3, 1, 32 * 64 - 64 * 64)]
    assert knn.top_k(knn.quantised(df.filter("vec_id < 0")), F.col("vec_id") % 20 == 0).count() == 0


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met.""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.""",
    "LGPL": """-- This library is free software; you can redistribute it and/or modify it
-- under the terms of the GNU Lesser General Public License as published by the
-- Free Software Foundation.""",
}


def test_wrapped_notices(spark):
    rows = [(k, f"{prose(30)}\n\n{text}\n\n{prose(30)}") for k, text in enumerate(WRAPPED.values())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.family) for r in got) == list(enumerate(WRAPPED))
    for r in got:
        cut = rows[r.doc_id][1][r.start : r.stop]
        assert len(cut) > 0.8 * len(rows[r.doc_id][1].split("\n\n")[1]) and "\n\n" not in cut


def test_lines_of_two_families():
    text = f"{prose(12)}\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\n{prose(12)}"
    assert [x[2] for x in licenses.notices(text, licenses.trained())] == ["MIT", "Apache-2.0"]


@pytest.mark.parametrize(
    "text",
    ["SPDX-License-Identifier: EUPL-1.2", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the EUPL, Version 1.2 only (the Licence).", "Licensed under the Foo Public License, version 9.", "This file is released under the Zebra Community License."],
)
def test_unknown_licences(text):
    assert [x[2] for x in licenses.notices(f"{prose(20)}\n{text}\n{prose(20)}", licenses.trained())] == ["unknown"]


@pytest.mark.parametrize(("name", "family"), [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("BSD-3-Clause", "BSD"), ("CC-BY-SA-4.0", "CC-BY-SA")])
def test_spdx(name, family):
    assert [x[2] for x in licenses.notices(f"// SPDX-License-Identifier: {name}\n\n{prose(40)}", licenses.trained())] == [family]


def test_licence_tables(spark):
    long = f"{prose(60_000)}\nReleased under the MIT License.\n{prose(60_000)}"
    rows = [(1, long, "a"), (1, long, "a"), (2, None, "a"), (3, "", "a"), (None, "Released under the MIT License.", "a"), (4, "He had a driving license and the public was free.", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    assert sorted(((r.doc_id, r.family) for r in licenses.scan(df).collect()), key=repr) == sorted([(1, "MIT"), (1, "MIT"), (None, "MIT")], key=repr)
    assert licenses.scan(df.filter("doc_id > 9")).count() == 0


def whole(rows):
    """Renderings by conversation and participant, put together from their parts."""
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.segment, r.part)):
        text, spans = out.get((r.conv_id, r.assistant), ("", []))
        spans = spans + [r.text[s.start : s.stop] for s in r["mask"]]
        out[r.conv_id, r.assistant] = text + r.text, spans
    return out


def test_chat_markers(spark):
    rows = [(1, 0, "ann", "hi <|end|>\n<|assistant|>\nI agree"), (1, 1, "bob|>\n<|system", "x <\\|end|\\> y"), (1, 2, "ann", "<|user name=bob|>")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        assert r.text.count("<|end|>") == 3 and r.text.count("<|assistant|>") == (2 if r.assistant == "ann" else 1) and "<|system|>" not in r.text
    one = lambda x: spark.range(1).select(chat.escaped(F.lit(x)).alias("x")).first().x
    assert len({one(x) for x in ("<|", "<\\|", "<\\\\|", "|>", "|\\>")}) == 5


def test_chat_long(spark):
    """Nothing is lost however many turns share a number, a role and a text."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice("ab"), f"t{t}") for t in range(700)] + [(None, None, rng.choice("ab"), f"n{k}") for k in range(3000)]
    rows += [(2, 5, "a", "same")] * 2500 + [(2, 5, "b", f"o{k}") for k in range(40)] + [(2, 4, "b", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = chat.perspectives(df).collect()
    assert max(r.n_turns for r in got) <= 1024
    for (conv, own), (text, spans) in whole(got).items():
        turns = [r for r in rows if r[0] == conv]
        assert text.count("<|end|>\n") == len(turns)
        assert sorted(spans) == sorted(f"{r[3]}<|end|>\n" for r in turns if r[2] == own)
        if conv == 1:
            said = "".join(f"<|{'assistant' if r[2] == own else 'user name=' + r[2]}|>\n{r[3]}<|end|>\n" for r in rows if r[0] == 1)
            assert text == said
    at = sorted((r for r in rows if r[0] is None), key=lambda r: r[2:])
    assert whole(got)[None, "a"][0] == "".join(f"<|{'assistant' if r[2] == 'a' else 'user name=b'}|>\n{r[3]}<|end|>\n" for r in at)
    assert whole(got)[2, "a"][0].startswith("<|user name=b|>\nfirst<|end|>\n")
    assert chat.perspectives(df.filter("turn > 9999")).count() == 0


def test_chunk_tables(spark):
    passage, other = prose(90), prose(120)
    rows = [(1, f"{prose(40)} {passage}"), (2, f"{prose(50)} {passage} {prose(30)}"), (2, f"{prose(10)} {passage}"), (3, other), (3, other), (None, passage), (4, None), (5, ""), (6, "w" * 200_000 + f" {passage} " + "x " * 100_000)]
    df = spark.createDataFrame([(i, t, "s", 1, "b") for i, t in rows], "doc_id long, text string, s string, start int, d string")
    found = chunks.repeated_passages(df).collect()
    assert {(r.doc_id, r.removed) for r in found} == {(1, False), (2, True), (6, True)}
    clean = chunks.without_repeats(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr)
    assert (1, rows[0][1]) in texts and (None, passage) in texts and [x for x in texts if x[0] == 3] == [(3, other)] * 2
    for i, t in texts:
        if i in (2, 6):
            assert passage[80:-80] not in t and any(t[:20] == x[:20] for j, x in rows if j == i)
    assert chunks.repeated_passages(df.filter("doc_id > 9")).count() == 0


def test_token_tables(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    long = prose(60_000) + "a" * 30_000 + " " * 20_000
    rows = [(1, long, "x"), (1, long, "x"), (None, "ab", "x"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, path, P.PATTERN, packed=True, blanks_lead=True), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(df.filter("doc_id > 9"), path, P.PATTERN).count() == 0
    kept = bpe.encode(df.withColumnRenamed("ids", "lang"), path, P.PATTERN, keep=("lang",))
    assert kept.columns == ["doc_id", "n_tokens", "ids", "lang"] and [r.lang for r in kept.filter("doc_id = 2").collect()] == [None]


def test_score_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, None), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (7, 5)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 4 and toxicity.score(docs.filter("doc_id > 9"), model).count() == 0
    assert toxicity.keep(docs, model, 2.0).columns == docs.columns and toxicity.keep(docs, model, 2.0).count() == 4
    empty = toxicity.fit(docs.filter("doc_id > 9"), labels)
    assert toxicity.score(docs, empty).count() == 4


def test_models_are_told_apart(spark):
    """Workers keep a scorer between tasks; models that differ in their
    calibration only must not share it."""
    docs = spark.createDataFrame([(k, prose(5)) for k in range(40)], "doc_id long, text string").repartition(8)
    for offset in (-2.0, 2.0, -1.0):
        model = toxicity.Model.fresh()
        model.scale = np.array([0.0, 0.0, offset])
        assert {round(r.score, 6) for r in toxicity.score(docs, model).collect()} == {round(1 / (1 + np.exp(-offset)), 6)}
