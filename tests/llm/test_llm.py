"""The training-data operators against brute force, round trips and fixtures."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import bpe, chat, chunks, decontaminate, knn, licenses, pii, simhash, toxicity
from inkwell.llm.common import connected_components

RNG = random.Random(3)
WORDS = ["".join(RNG.choices("abcdefgho", k=RNG.randint(2, 7))) for _ in range(400)]
prose = lambda n, rng=RNG: " ".join(rng.choices(WORDS, k=n))


def docs_of(spark, rows):
    """With an extra column whose name clashes with those of results."""
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}
    assert connected_components(df.filter("u < 0")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.2, (600, 8)).tolist()
    v[7:200] = [v[6]] * 193  # one very frequent vector, so ties
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (None, v[0]), (3, v[3])]
    df = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = rows_of(knn.top_k(df, F.col("vec_id") % 20 == 0))
    data = [(i, np.floor(64 * np.float32(x).astype(float)).astype(int)) for i, x in rows[:600]] + [(3, np.floor(64 * np.float32(v[3]).astype(float)).astype(int))]
    want = []
    for q, x in data[:600]:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in data if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    few = df.filter("vec_id < 4")
    assert knn.top_k(few, F.col("vec_id") == 0).count() == 4
    assert knn.top_k(df.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_bpe(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [prose(40), "", None, " a", "a ", "x\n\n y  z", "日本語テキスト it's 12345 !!", "ab" * 4000, "é b \n", " " * 50, "!?" * 300, "supercalifragilistic" * 9]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    df = docs_of(spark, [*enumerate(texts), (None, "null id"), (0, texts[0])])
    for lead in (True, False):
        got = {r.doc_id: r.ids for r in bpe.encode(df, path, P.PATTERN, blanks_lead=lead).collect()}
        assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    packed = bpe.decode(bpe.encode(df, path, P.PATTERN, packed=True), path, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in packed.collect() if r.doc_id is not None)


def test_pii(spark):
    text = "mail jane.doe42@mail.example.com or +1 (643) 555-5742, card 4111 1111 1111 1111 not 4111 1111 1111 1112; 10.0.3.255 1984-02-29 29/02/1984 123-45-6789 DE89370400440532013000 token = \"2d480315a6562b81c25342984c4087344558d00e\""
    df = docs_of(spark, [(1, text), (2, "again 4111111111111111 and jane.doe42@mail.example.com"), (3, None), (4, ""), (5, "no data, 12 of 2021-02-30")])
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[1].pii_kinds == ["email", "phone", "card", "ip", "date", "date", "ssn", "iban", "credential"]
    assert "4111 1111 1111 1112" in got[1].text and "jane.doe42" not in got[1].text and "1984" not in got[1].text
    card = got[2].text.split()[1]
    digits = [int(c) for c in card]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert " ".join(card[i : i + 4] for i in range(0, 16, 4)) in got[1].text  # linked
    assert got[2].text.split()[-1] in got[1].text
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "no data, 12 of 2021-02-30") and got[5].fp == "x"
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    assert other[1] != got[1].text
    days = spark.range(3000).select(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(days, "k").select("text").distinct().count() == 3000


def brute_simhash(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min(low.get(g, i), i)
    return sorted(((i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, group)), key=repr)


def test_simhash(spark):
    base = [prose(n) for n in (300, 300, 80, 40, 5, 2)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    for k in range(40):
        w = base[k % 3].split()
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
        rows.append((200 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (299, "  "), (302, base[0].upper()), (302, base[0].upper())]
    df = docs_of(spark, rows)
    assert rows_of(simhash.near_duplicates(df)) == brute_simhash(rows)
    kept = simhash.keep_one(df, simhash.components(simhash.fingerprints(df)))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_simhash(rows)})
    assert simhash.near_duplicates(df.filter("doc_id < 0")).count() == 0
    assert simhash.near_duplicates(docs_of(spark, [(None, "a b")])).first().component_id is None


def test_similar(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng.choice([60, 150, 400]), rng)) for i in range(120)]
    for k in range(90):  # edited copies, some of them too far
        w = rows[k % 30][1].split()
        for _ in range(rng.randrange(1, max(2, len(w) // 30))):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, rows[0][1].upper()), (1000, rows[120][1])]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    group = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((group[i], group[j]))
            group = {k: a if g == b else g for k, g in group.items()}
    df = docs_of(spark, rows)
    found = simhash.similar_components(df).select("doc_id", "component_id")
    got = dict(map(tuple, found.collect()))
    assert found.count() == len(rows)
    assert sum(got[i] != group[i] for i in group) <= 0.03 * len(group)
    assert all(group[i] == group[got[i]] for i in got)  # and no wrong link
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.similar_components(df.filter("doc_id < 0")).count() == 0
    assert simhash.similar_components(docs_of(spark, [(None, "a b")])).first().component_id is None


def edited(text, n, rng):
    """With ``n`` words replaced, far enough apart not to share shingles."""
    w = text.split()
    step = len(w) // n
    for k in range(n):
        w[k * step + rng.randrange(step - 5)] = "x" + rng.choice(WORDS)
    return " ".join(w)


def test_similar_star(spark):
    rng = random.Random(4)
    original = " ".join(f"w{k}" for k in range(300))
    rows = [(5000, original)] + [(k, edited(original, 5, rng)) for k in range(1000)]
    assert len({c for _, c in simhash.similar_components(docs_of(spark, rows)).select("doc_id", "component_id").collect()}) == 1


def test_similar_frequent_lines(spark):
    line, many = "one line of nine words that comes very often\n", lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    rows = [(1, line * 150 + many("a", 100)), (2, line * 150 + many("b", 100)), (3, f"{many('c', 200)}\n{line}"), (4, f"{many('c', 200)}\n{line * 6}")]
    rows += [(7, many("d", 150)), (8, many("d", 150) + " end")]
    found = simhash.similar_components(docs_of(spark, rows)).select("doc_id", "component_id")
    assert dict(map(tuple, found.collect())) == {1: 1, 2: 2, 3: 3, 4: 3, 7: 7, 8: 7}


def test_set_links():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(150)]
    pairs = {(i, j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    parts = lambda found: sorted(map(sorted, _classes(150, found)))
    assert parts(simhash.set_links(sets, 0.5)) == parts(pairs)


def test_simhash_runs():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fp = np.r_[fp, fp[:100] ^ np.uint64(7), fp[:50] ^ np.uint64(1 << 40)]
    want = {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    parts = lambda pairs: sorted(len(c) for c in _classes(len(fp), pairs))
    assert parts(simhash._forest(fp, 3)) == parts(want)


def _classes(n, pairs):
    own = {i: {i} for i in range(n)}
    for i, j in pairs:
        if own[i] is not own[j]:
            own[i] |= own[j]
            for k in own[j]:
                own[k] = own[i]
    return {id(s): s for s in own.values()}.values()


def test_licenses(spark):
    line = "Released under the MIT License."
    rows = [(1, f"{prose(20)}\n{line}\n{prose(9)}"), (2, prose(200)), (3, None), (4, ""), (5, f"{prose(150)} Licensed under the Apache License, Version 2.0. {prose(60)}"), (6, "Licensed under the Foo Public License, version 9.")]
    got = licenses.scan(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.family) for r in got if r.family != "unknown"} == {(1, "MIT"), (5, "Apache-2.0")}
    one = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][one.start : one.stop] == line[:-1]
    held_out = [(w, y) for w, y in licenses._examples(99)]
    model = licenses.trained()
    right = sum((model.family(w) or (licenses.NONE,))[0] in (y, "unknown") for w, y in held_out)
    assert right >= 0.98 * len(held_out)


def test_chat(spark):
    rows = [(1, 1, "bob", "hi"), (1, 0, "system", "be"), (1, 2, "ann", None), (2, 0, "system", "x"), (3, 0, None, "q"), (3, 300, None, "r"), (None, 0, "u", "n")]
    got = rows_of(chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    first = "<|system|>\nbe<|end|>\n"
    bob = next(r for r in got if r[:2] == (1, "bob"))
    assert bob[4] == first + "<|assistant|>\nhi<|end|>\n<|user name=ann|>\n<|end|>\n"
    assert [bob[4][s.start : s.stop] for s in bob[5]] == ["hi<|end|>\n"]
    assert {r[:3] for r in got} == {(1, "ann", 0), (1, "bob", 0), (3, "unknown", 0), (3, "unknown", 1), (None, "u", 0)}


def test_decontaminate(spark):
    items = [(i, prose(n)) for i, n in enumerate((40, 30, 60, 12))] + [(9, "tiny item"), (10, None), (None, "x")]
    edited = items[2][1].split()
    for k in (5, 30, 50):
        edited[k] = "zzz"
    half = " ".join(items[0][1].split()[:15])
    rows = [(1, f"{prose(50)} {items[0][1].upper()} {prose(20)}"), (2, f"{prose(9)}\n{' '.join(edited)}"), (3, prose(400)), (4, f"{prose(30)} {half} {prose(30)}"), (5, None), (6, ""), (7, "a  tiny\nitem here"), (8, items[3][1])]
    got = rows_of(decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert [r[:2] for r in got] == [(1, 0), (2, 2), (7, 9), (8, 3)]
    assert got[0][2] == 0 and 0 < got[1][2] <= 0.2 * len(items[2][1])
    left = decontaminate.drop_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs_of(spark, rows), none).count() == 0


def test_decontaminate_cut_front():
    item = prose(50)
    cut = item[item.index(" ", 25) + 1 :]
    assert len(item) - len(cut) <= 0.2 * len(item)
    for texts in ([cut], [prose(40), f"{cut} {prose(30)}"], ["", cut]):
        assert [x[:2] for x in decontaminate.Index([(7, item)], 0.8).leaks(texts)] == [(len(texts) - 1, 7)]


def test_edit_distance():
    for _ in range(200):
        a, b = ("".join(RNG.choices("ab", k=RNG.randint(1, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1)] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert decontaminate.edit_within(a, b, 99)[0] == min(table[-1])


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["nastyword", "vilething", "awfulone"]
    make = lambda y: prose(rng.randint(5, 120), rng) + (" " + rng.choice(bad) + " " + prose(8, rng) if y else "")
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(2400)]
    docs, labels = docs_of(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.3, y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert sum(p == bool(y) for p, y in held) >= 0.95 * len(held)
    edge = docs_of(spark, [(1, None), (2, ""), (None, "a b"), (3, "w " * 50_000 + bad[0]), (3, "w")])
    scores = toxicity.score(edge, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.keep(docs, model, 0.3).columns == docs.columns
    flat = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.score < 0.3 for r in toxicity.score(edge, flat).collect())


def test_toxicity_calibration():
    model = toxicity.Model.fresh(1)
    texts = [prose(n % 90) for n in range(200)]
    toxicity._calibrate(model, texts, np.array([n % 5 == 0 for n in range(200)], float))
    assert np.abs(model.scale).max() < 100
    assert abs(toxicity.Scorer(model).scores(texts).mean() - 0.2) < 0.02


def test_toxicity_gradient():
    model, words = toxicity.Model.fresh(1), ["ab", "cde", "f"]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    index, y, w = np.array([[1, 2, 3, 0], [3, 1, 0, 0]]), np.array([1.0, 0.0]), np.full(2, 0.5)

    def loss():
        scorer = toxicity.Scorer(model)
        at = scorer._index([words])[0]
        z = model.logits(scorer.table, np.where(index > 0, at[index - 1], 0)).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    g = toxicity._step(model, words, index, y, w)
    for k in ("wf", "ub", "cb", "att", "out", "bias"):
        for at in list(np.ndindex(model.p[k].shape))[:: max(1, model.p[k].size // 4)][:4]:
            keep, model.p[k][at] = model.p[k][at], model.p[k][at] + 0.02
            up = loss()
            model.p[k][at] = keep - 0.02
            down = loss()
            model.p[k][at] = keep
            assert abs((up - down) / 0.04 - g[k][at]) < 5e-3


def test_chunks(spark):
    passage = prose(90)
    rows = [(1, f"{prose(60)} {passage} {prose(40)}"), (2, f"{prose(33)} \n{passage} {prose(9)}"), (3, prose(300)), (4, None), (5, ""), (6, "same " * 500), (7, f"{prose(100)} short common line {prose(3)}"), (8, f"{prose(90)} short common line"), (None, passage), (3, None)]
    got = chunks.repeated_passages(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.first_doc_id, r.removed) for r in got} == {(1, 1, False), (2, 1, True)}
    for r in got:
        cut = " ".join(dict((i, t) for i, t in rows if t)[r.doc_id].encode()[r.start : r.stop].decode().split())
        assert cut[5:-5] in f"{rows[0][1]} {passage}" and r.n_words > 50
    clean = {r.doc_id: r.text for r in chunks.without_repeats(docs_of(spark, rows[:3])).collect()}
    assert clean[1] == rows[0][1] and clean[3] == rows[2][1] and len(clean[2]) < len(rows[1][1]) - 300
    data = ("é" * 9000 + "ab " * 4000 + prose(500)).encode()
    ends = chunks.cuts(data)
    assert ends[-1] == len(data) and all(data[a:b].decode() for a, b in zip([0, *ends], ends)) and max(np.diff([0, *ends])) <= chunks.MOST + 3
    assert chunks.cuts(b"") == []


def test_chunks_first_stays(spark):
    header, passage = prose(60), prose(90)
    rows = [(1, f"{header} {prose(30)}"), (2, f"{prose(20)} {header} {passage} {prose(20)}"), (3, f"{prose(25)} {header} {passage} {prose(15)}"), (4, f"{passage} {header}")]
    docs = docs_of(spark, rows)
    digests = lambda df: {bytes(r.digest) for r in chunks.chunk_table(df).collect()}
    held = [r for r in chunks.repeated_passages(docs).collect() if r.removed]
    spans = {}
    for r in held:
        spans.setdefault(r.doc_id, []).append((r.start, r.stop))
    left = {bytes(r.digest) for r in chunks.chunk_table(docs).collect() if not any(a <= r.start and r.stop <= b for a, b in spans.get(r.doc_id, []))}
    assert left == digests(docs) and {2, 3, 4} <= spans.keys()
    clean = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    assert passage[60:-60] in clean[2] and passage[60:-60] not in clean[3] and header[60:-60] not in clean[2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    bad, leak = "nastyword vilething", prose(40)
    rng = random.Random(8)
    texts = {i: prose(60, rng) + (f" {bad} {bad} " + prose(20, rng) if i % 4 == 0 else "") for i in range(1600)}
    texts |= {5001: texts[1], 5002: f"{prose(20)} {leak} {prose(20)}", 5003: "call +1 (643) 555-5742 " + prose(30)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {5001, 5002} & out.keys() and {1, 5003} <= out.keys()
    clean = [i for i in range(1600) if i % 4]
    assert sum(i % 4 == 0 for i in out if i < 1600) <= 20
    codec = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert codec.decode(np.array(out[1].ids, "<u4").tobytes()).decode() == texts[1]
    assert "555-5742" not in codec.decode(np.array(out[5003].ids, "<u4").tobytes()).decode()
    assert len(set(clean) & out.keys()) >= 0.98 * len(clean)


@pytest.mark.parametrize("name", ["op3_bpe"])
def test_digests(spark, name):
    from inkwell.llm import queries

    sf = "/root/testdata/sf0.001"
    row = queries.queries()[name](spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
