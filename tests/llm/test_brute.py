"""Chunk dedup and the Feistel network against plain Python."""

import hashlib
import random

import pytest
import xxhash
from inkwell.llm import chunks, pii

RNG = random.Random(31)
WORDS = ["".join(RNG.choices("abcdefgho", k=RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def plain_passages(rows, least=20):
    texts = {(i, t) for i, t in rows if i is not None and t}
    cut = {}
    for i, t in texts:
        data, at = chunks.compact(t.encode())
        begin, out = 0, []
        for end in chunks.cuts(data):
            part = data[begin:end]
            words = sum(c != 32 and (begin + k == 0 or data[begin + k - 1] == 32) for k, c in enumerate(part))
            out.append((int(at[begin]) if begin else 0, int(at[end]), words, xxhash.xxh3_128_digest(part)))
            begin = end
        cut[i, t] = out
    holders = {}
    for (i, _), parts in cut.items():
        for p in parts:
            holders.setdefault(p[3], set()).add(i)
    found = set()
    for (i, t), parts in cut.items():
        runs, last = [], None
        for start, stop, words, digest in parts:
            if len(holders[digest]) < 2:
                continue
            if last != start:
                runs.append([])
            runs[-1].append((start, stop, words, min(holders[digest])))
            last = stop
        for run in runs:
            if sum(p[2] for p in run) < least:
                continue
            pieces = []
            for p in run:
                if not pieces or (pieces[-1][-1][3] == i) != (p[3] == i):
                    pieces.append([])
                pieces[-1].append(p)
            for q in pieces:
                found.add((i, xxhash.xxh64_intdigest(t.encode(), 42), q[0][0], q[-1][1], sum(p[2] for p in q), len(q), min(p[3] for p in q), q[0][3] != i))
    return found


def test_passages(spark):
    passages = [prose(RNG.choice([8, 25, 60, 120])) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [RNG.choice(passages) if RNG.random() < 0.5 else prose(RNG.randint(1, 60)) for _ in range(RNG.randint(0, 5))]
        rows.append((i % 50, RNG.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(7, "one " * 300), (8, "one " * 250), (None, passages[0]), (9, None), *rows[:5]]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    flat = {(r.doc_id, r.text_key % (1 << 64), r.start, r.stop, r.n_words, r.n_chunks, r.first_doc_id, r.removed) for r in got}
    assert len(got) == len(flat) and flat == plain_passages(rows) and len(flat) > 30


def plain_feistel(symbols, moduli, key, kind):
    half = len(symbols) // 2
    left, right = list(symbols[:half]), list(symbols[half:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in range(pii.ROUNDS):
        own, other, base = (left, right, 0) if r % 2 == 0 else (right, left, half)
        h = sha("|".join([key, kind, str(r), ",".join(map(str, other))]))
        for i, x in enumerate(list(own)):
            own[i] = (x + int(sha(f"{h}|{i}")[:12], 16)) % moduli[base + i]
    return left + right



@pytest.mark.parametrize("kind", ["card", "ip", "ssn", "phone"])
def test_feistel(spark, kind):
    rng, texts, want = random.Random(kind), [], []
    for _ in range(40):
        if kind == "card":
            body = [rng.randint(0, 9) for _ in range(rng.choice([12, 15, 18]))]
            check = lambda d: (10 - sum((2 * x - 9 * (x > 4)) if k % 2 == 0 else x for k, x in enumerate(reversed(d))) % 10) % 10
            moved = plain_feistel(body, [10] * len(body), "k", "card")
            source, target = "".join(map(str, [*body, check(body)])), "".join(map(str, [*moved, check(moved)]))
        elif kind == "ip":
            body = [rng.randint(0, 255) for _ in range(4)]
            source, target = ".".join(map(str, body)), ".".join(map(str, plain_feistel(body, [256] * 4, "k", "ip")))
        elif kind == "ssn":
            area, group, serial = rng.choice([1, 665, 667, 899]), rng.randint(1, 99), rng.randint(1, 9999)
            a, g, s = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], pii.SSN_SIDES, "k", "ssn")
            source, target = f"{area:03}-{group:02}-{serial:04}", f"{a + (2 if a >= 665 else 1):03}-{g + 1:02}-{s + 1:04}"
        else:
            body = [rng.randint(0, 9) for _ in range(10)]
            moved = plain_feistel(body, [10] * 10, "k", "phone")
            layout = lambda d: "({}{}{}) {}{}{}-{}{}{}{}".format(*d)
            source, target = layout(body), layout(moved)
        texts.append(f"a {source} b")
        want.append(f"a {target} b")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()] == want
