"""The trie of conversations against one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from inkwell.llm import prefixes

RNG = random.Random(12)
TURNS = "conv_id long, turn long, role string, text string, depth int, a long"


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(x)] for c, x in own.items()}


def plain(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = set()

    def walk(node):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = not children[node]
        for child in children[node]:
            s, n = walk(child)
            saved, leaves = saved + s, leaves + n
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        out.add((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), int(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
        return saved, leaves

    if paths:
        walk(())
    return out


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def table():
    texts = ["", "yes", "no", None, "längér 🙂", "x" * 3000]
    rows = []
    for c in [*RNG.sample(range(450), 160), 100, 200, 1000, 2003]:
        for turn in range(RNG.choice([1, 1, 2, 4, 7, 8])):
            rows.append((c, RNG.choice([turn, turn, None, 3]), RNG.choice(["user", "user", None, "bot"]), RNG.choice(texts), 9, 9))
    return rows + rows[:15] + [(None, 1, "user", "lost", 1, 1)]


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("stretch", [1024, 3])
def test_brute(spark, stretch):
    rows = table()
    RNG.shuffle(rows)
    steps = prefixes.numbered(spark.createDataFrame(rows, TURNS).repartition(3))
    got = found(prefixes.trie(*prefixes.spliced(steps), stretch=stretch))
    assert got == sorted(plain(spliced(ordered(rows))), key=str)


def test_plain_trie_of_equal_conversations(spark, monkeypatch):
    """One conversation with a third of all turns, many that are the same, and
    ids joined in several strings."""
    monkeypatch.setattr(prefixes, "JOINED", 7)
    rows = [(5, i, "user", f"turn {i % 4}", 0, 0) for i in range(400)]
    rows += [(c, i, "user", f"turn {i % 4}", 0, 0) for c in range(1000, 1200) for i in range(3)] + [(-7, 0, "user", "turn 0", 0, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame(rows, TURNS)
        assert found(prefixes.prefix_trie(turns)) == sorted(plain(ordered(rows)), key=str)
        places = prefixes.numbered(turns).filter("conv_id = 5").orderBy("depth").collect()
        assert [r.depth for r in places] == list(range(1, 401))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_and_empty(spark):
    """An id whose first turns all go and whose base is absent ends at the root."""
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "user", "a", 0, 0), (lone + 400, 0, "user", "b", 0, 0)]
    steps = prefixes.numbered(spark.createDataFrame(rows, TURNS))
    assert found(prefixes.trie(*prefixes.spliced(steps))) == sorted(plain(spliced(ordered(rows))), key=str)
    steps = prefixes.numbered(spark.createDataFrame([], TURNS))
    assert prefixes.trie(*prefixes.spliced(steps)).count() == 0
