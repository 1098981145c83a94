"""Near duplicates: hot keys, large groups, odd tables, clashing columns."""

import random

import numpy as np
import pytest

from inkwell.llm import simhash

RNG = random.Random(6)
WORDS = ["".join(RNG.choices("abcdefgho", k=RNG.randint(2, 7))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def classes(df):
    return dict(map(tuple, df.select("doc_id", "component_id").collect()))


def test_one_segment_shared_by_many(spark):
    """50,000 fingerprints with one upper half, some of them near."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 32, 50_000).astype(np.uint64)
    near = low[:3000] ^ np.uint64(1 << 5) ^ (np.uint64(1) << rng.integers(8, 32, 3000).astype(np.uint64))
    upper = np.uint64(0x1234ABCD << 32)
    fp = np.r_[low, near] | upper
    fp[-500:] ^= np.uint64(1 << 40)  # the third bit in the shared half
    df = spark.createDataFrame(list(enumerate(fp.view(np.int64).tolist())), "doc_id long, fp long").repartition(4)
    got = classes(simhash.components(df))
    distinct, where = np.unique(fp, return_index=True)
    want = {}
    for group in _groups(len(distinct), simhash._forest(distinct, 3)):
        low = min(int(where[x]) for x in group)
        want |= {int(where[x]): low for x in group}
    assert got == {i: want[int(where[at])] for i, at in enumerate(np.searchsorted(distinct, fp).tolist())}
    assert 47_000 < len(set(got.values())) < 50_500


def test_run_edges_of_long_runs(monkeypatch):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    fp = np.unique(np.r_[fp, fp[:900] ^ np.uint64(7), fp[:500] ^ np.uint64(1 << 40 | 1 << 3)])
    parts = lambda pairs: sorted(map(sorted, _groups(len(fp), pairs)))
    want = parts(simhash._run_edges(fp, 3))
    monkeypatch.setattr(simhash, "LONG_RUN", 100)
    assert parts(simhash._run_edges(fp, 3)) == want


def _groups(n, pairs):
    own = {i: {i} for i in range(n)}
    for i, j in pairs:
        if own[i] is not own[j]:
            own[i] |= own[j]
            for k in own[j]:
                own[k] = own[i]
    return {id(s): s for s in own.values()}.values()


@pytest.mark.parametrize("shape", ["star", "dense", "mixed"])
def test_large_groups(spark, monkeypatch, shape):
    """A group worked on in blocks gives the classes of one worked on whole."""
    rng = random.Random(9)
    original = prose(200, rng).split()
    rows = [(500, " ".join(original))] if shape != "dense" else []
    for k in range(160):
        w = list(original)
        for at in range(rng.randrange(10), 195, 200 // (4 if shape == "star" else 1 if shape == "dense" else rng.choice([1, 4, 9]))):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(simhash.similar_components(df))
    monkeypatch.setattr(simhash, "TASK_SHINGLES", 2000)
    assert classes(simhash.similar_components(df)) == want
    if shape != "mixed":
        assert len(set(want.values())) == 1


def test_edges(spark):
    text = prose(80)
    rows = [(3, text, {"a": 1}), (3, text, {"a": 1}), (1, text.upper(), None), (4, text + " end", None), (7, None, None), (8, "", None), (None, text, None), (9, "w " * 300_000, None), (5, prose(70), None), (5, prose(60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key map<string,int>").selectExpr("*", "'f' as fp", "1 as component_id", "'k' as kept", "2 as rep")
    got = simhash.similar_components(df)
    assert got.count() == len(rows)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(3, 1), (1, 1), (4, 1), (7, 7), (8, 7), (None, None), (9, 9), (5, 5)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.kept) for r in kept.collect()), key=repr) == sorted([(1, "k"), (5, "k"), (7, "k"), (9, "k"), (None, "k")], key=repr)
    only = df.select("doc_id")
    assert simhash.keep_one(only, got).count() == 5 and simhash.keep_one(only, got).columns == ["doc_id"]
    assert simhash.keep_one(df.filter("doc_id > 99")).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} >= {1, 5, 7, 9, None}


def test_simhash_candidates(spark):
    """A link that no band of minima has and the fingerprints have."""
    rng = random.Random(12)
    while True:
        line = prose(40, rng)
        tail = [f"t{rng.random()}" for _ in range(100)]
        other = [f"x{k}" if k % 40 == 5 else w for k, w in enumerate(tail)]
        a, b = ("\n".join([line] * 40 + [" ".join(t)]) for t in (tail, other))
        x, y = simhash.shingle_set(a, 5), simhash.shingle_set(b, 5)
        both = len(np.intersect1d(x, y))
        if both < 0.8 * (len(x) + len(y) - both) or (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3:
            continue
        if not (simhash.band_keys(x) == simhash.band_keys(y)).any():
            break
    df = spark.createDataFrame([(1, a), (2, b), (3, prose(200, rng))], "doc_id long, text string")
    assert classes(simhash.similar_components(df)) == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3]
