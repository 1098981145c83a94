"""The filter audit against plain Python."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from inkwell.llm import audit

DOCS = "doc_id long, text string, source string, mask string, part int"
RNG = random.Random(11)


def masks_of(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, source, *_ in rows:
        t = t or ""
        words = [w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and i > least[t],
        ]
        out.append((i, source or "", "".join(x for x, f in zip("ABCDE", fails) if f)))
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, masks = {}, masks_of(rows)
    for part in {m[1] for m in masks}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[1] == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [m for m in left if x in m[2]]
                left = [m for m in left if x not in m[2]]
                own = sum(m[2] == x for m in masks if m[1] == part)
                found[part, order, step] = [
                    len(left), len(here), sum(x in m[2] for m in gone), own, sum(m[0] in good for m in here), sum(m[0] in toxic for m in here)
                ]
                gone += here
                shapley[x] += len(here)
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return found


def rows_of(n):
    words = ["".join(RNG.choices("abcdeé", k=5)) for _ in range(400)]
    texts = [None, "", " \t ", "A", "ÀÉ one two", "#"]
    for _ in range(30):
        text = " ".join(RNG.choices(words[: RNG.choice([8, 60, 400])], k=RNG.choice([3, 150, 199, 200, 260])))
        texts.append(RNG.choice([text, text.upper(), text.title(), f"{text}\x0b\n|", text.replace(" ", "\x1c")]))
    rows = [(RNG.choice([None, *range(n // 2)]), RNG.choice(texts), RNG.choice([None, "", "a", "b", "b"]), "x", 3) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("partitions", [1, 13])
def test_brute(spark, partitions):
    rows = rows_of(500) + [(10_000 + i, "one text of a third of all rows", "b", None, None) for i in range(250)]
    RNG.shuffle(rows)
    labels = [(RNG.choice([None, *range(300)]), RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for _ in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, DOCS).repartition(5)
        got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_repeats_cross_ranges(spark):
    """A text of many ids lies in many ranges, short Arrow batches and all."""
    rows = [(i // 2, "same", "a", None, None) for i in range(600)] + [(i, f"own {i % 150}", "a", None, None) for i in range(300)] + [(None, "same", "a", None, None)] * 3
    RNG.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = audit.repeats(spark.createDataFrame(rows, DOCS), then={"n": F.length("text")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    want = Counter((i, len(t), i is not None and i > (0 if t == "same" else i % 150)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.repeat) for r in got) == want


def test_one_fingerprint(spark, monkeypatch):
    """Different texts of one fingerprint are told apart, wherever ranges are cut."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    rows = [(i, f"text {i % 3}", "a", None, None) for i in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.repeats(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.doc_id, r.repeat) for r in got} == {(i, i > 2) for i in range(90)}


def test_empty_and_own_rules(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    docs = spark.createDataFrame([(1, "a b", "s", None, None), (2, "a b", "s", None, None), (3, None, "s", None, None)], DOCS)
    masks = audit.failures(docs, {"L": F.length("text") < 2}, "source")
    assert {(r.doc_id, r.mask) for r in masks.collect()} == {(1, 0), (2, 2), (3, 1)}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.good_lost, r.shapley) for r in audit.interactions(masks, labels, "LE").collect()}
    assert got == {("LE", 1): (2, 1, 0, 2), ("LE", 2): (1, 1, 0, 2), ("EL", 1): (2, 1, 0, 2), ("EL", 2): (1, 1, 0, 2)}
    with pytest.raises(ValueError):
        audit.interactions(masks, labels, "ABCDEFG")
