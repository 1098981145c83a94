"""Benchmark decontamination against brute force over all documents and items."""

import random

import numpy as np
import pytest

from inkwell.llm import decontaminate as D

LETTERS = "abcdefghilmnoprstuv "


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(1, 9))) for _ in range(n))


def edited(text, share, rng, kind):
    if kind == "even":  # one letter of every few replaced
        step = round(1 / share)
        return "".join(rng.choice(LETTERS[:-1]) if i % step == step // 2 and c != " " else c for i, c in enumerate(text))
    out = list(text)
    for at in sorted(rng.sample(range(len(text)), int(share * len(text) + 1e-9)), reverse=True):
        turn = rng.random()
        if turn < 0.4:
            out[at] = rng.choice(LETTERS)
        elif turn < 0.7:
            del out[at]
        else:
            out.insert(at, rng.choice(LETTERS))
    return " ".join("".join(out).split())


def limit(item):
    return int(0.2 * len(item) + 1e-9)


@pytest.mark.parametrize("words", [9, 15, 25, 40, 70])
@pytest.mark.parametrize(("share", "kind"), [(0.05, "mixed"), (0.1, "mixed"), (0.15, "mixed"), (0.2, "mixed"), (1 / 6, "even"), (1 / 8, "even")])
def test_recall(words, share, kind):
    rng = random.Random(words)
    items = [prose(rng, words) for _ in range(80)]
    index, found, real = D.Index(list(enumerate(items))), 0, 0
    for k, item in enumerate(items):
        text = f"{prose(rng, 8)} {edited(item, share, rng, kind)} {prose(rng, 8)}"
        if D.edit_within(item, text, limit(item)):
            real += 1
            found += any(x[1] == k for x in index.leaks([text]))
    assert real >= 60 and found >= 0.9 * real


def test_against_brute_force():
    """Whole, edited and cut items, at beginnings and ends of texts, in one batch
    and alone: what is found is right, and nearly all that is there is found."""
    rng = random.Random(2)
    items = [(k, prose(rng, n)) for k, n in enumerate([12, 15, 20, 30, 45, 60] * 3)]
    texts = []
    for _, item in items:
        cut = limit(item)
        texts += [item, item[cut:], item[:-cut], item[2:], item[cut // 2 : -(cut // 2)], f"{prose(rng, 30)} {item[cut:]}", f"{item[:-cut]} {prose(rng, 30)}"]
        texts += [f"{prose(rng, 20)} {edited(item, 0.12, rng, 'mixed')} {prose(rng, 20)}", item[: len(item) // 2], prose(rng, 60), ""]
    texts = [D.normalise(t) for t in texts]
    real = {(t, k) for t, text in enumerate(texts) for k, item in items if D.edit_within(item, text, limit(item))}
    index = D.Index(items)
    for found in (list(index.leaks(texts)), [(t, *x[1:]) for t, text in enumerate(texts) for x in index.leaks([text])]):
        assert {x[:2] for x in found} <= real
        assert len(found) >= 0.99 * len(real)
        for t, k, distance, start, stop in found:
            item = dict(items)[k]
            assert distance == D.edit_within(item, texts[t], len(item))[0]
            assert D.edit_within(item, texts[t][start:stop], distance, anchored=True)[0] == distance
            assert D.edit_within(item[::-1], texts[t][start:stop][::-1], distance, anchored=True)[0] == distance


def test_edges(spark):
    rng = random.Random(4)
    item, wide = prose(rng, 30), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    items = [(1, item), (2, wide), (3, "two words"), (3, "other words"), (None, item), (5, None), (6, ""), (1, item)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    long = f"{'x' * 300_000} {prose(rng, 20_000)} {item} {prose(rng, 20_000)}"
    docs = [(1, long), (1, long), (2, f"甲乙{wide}丙"), (3, "TWO\n words, two words"), (None, item), (4, None), (5, ""), (6, "two wordsy")]
    df = spark.createDataFrame([(i, t, "x", {"a": 1}) for i, t in docs], "doc_id long, text string, item_id string, distance map<string,int>")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.find_leaks(df, benchmark).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (None, 1, 0)], key=repr)
    left = D.drop_leaks(df, benchmark)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6]
    assert D.find_leaks(df.filter("doc_id < 0"), benchmark).count() == 0
    assert D.drop_leaks(df, benchmark.filter("item_id < 0")).count() == len(docs)


def test_walks_of_no_item_end_early():
    """And those that agree with an item's are the same as without sieves."""
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.choice([5, 12, 40]))) for k in range(40)]
    index = D.Index(items)
    data, starts = D.symbols(" ".join([text(4000), items[3][1], text(500), items[9][1][5:]]) + "\0" * 30)
    assert {t[1] for t in index.tables} == {26, 14, 10}
    walked = index.walks[0].hashes(data, starts, index.steps, index.early[0])
    assert len(walked[26][0]) < len(starts) / 2
    found = [x.tolist() for x in index.matches(data, starts)]
    index.early = [None for _ in index.walks]
    assert [x.tolist() for x in index.matches(data, starts)] == found and found[0]


def test_block_distances():
    rng = random.Random(32)
    make = lambda n: "".join(rng.choices("abcd ", k=n)).strip() or "a"
    items = [(k, D.normalise(make(rng.randint(17, 64)))) for k in range(60)]
    index = D.Index(items)
    text = make(3000)
    low = np.array([rng.randrange(2900) for _ in items])
    size = np.array(sorted(rng.choice([-3, 0, 1, 40, 90]) for _ in items))
    got = index._block_distance(D.symbols(text)[0] & 31, low, low + size, np.arange(len(items)))
    want = [D.edit_within(x, text[a : a + max(n, 0)], len(x))[0] for (_, x), a, n in zip(items, low, size, strict=True)]
    assert got.tolist() == want
