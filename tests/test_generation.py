"""The generator as a data source and the collection of its answers as a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import models
from inkwell.sources import files
from inkwell.sources.generation import Asked, GenerationReader, GenerationSource, PrunedReader
from inkwell.streaming import generation as G

OPTIONS = {"categories": "email, chat,email,none", "n": "25", "batchsize": "10", "pause": "0"}


@pytest.fixture
def source(spark):
    spark.dataSource.register(GenerationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **more: spark.read.format("inkwell_generation").options(**(OPTIONS | more)).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_source(source):
    rows = source()
    assert rows.columns == ["category", "batch", "n", "attempts", "answer"] and rows.rdd.getNumPartitions() == 9
    assert sorted((r.category, r.batch, r.n) for r in rows.collect()) == sorted((c, b, n) for c in ("email", "chat", "none") for b, n in enumerate((10, 10, 5)))
    assert {r.answer for r in rows.filter("category = 'none'").collect()} == {"I can't."}
    assert source(n="0").count() == 0
    with pytest.raises(Exception, match="categories"):
        source(categories=" ").count()


def test_pushed_filter(source):
    """Categories that a filter leaves out are not asked for."""
    rows = source(pushdown="true").filter(F.col("category").isin("email", "other") & (F.col("batch") < 2))
    assert {r.category for r in rows.collect()} == {"email"} and rows.count() == 2
    assert rows.rdd.getNumPartitions() == 3


def test_retries(source, monkeypatch):
    class Fails:
        left, closed = 2, 0

        def generate(self, category, n):
            if category == "chat" and Fails.left:
                Fails.left -= 1
                raise OSError("busy")
            return "[]"

        def close(self):
            Fails.closed += 1

    monkeypatch.setitem(models.GENERATORS, "fails", Fails)
    reader = GenerationReader(OPTIONS | {"generator": "fails", "retries": "2"})
    assert [r[3] for p in reader.partitions() for r in reader.read(p)] == [1, 1, 1, 3, 1, 1, 1, 1, 1] and Fails.closed == 9
    Fails.left = 9
    with pytest.raises(OSError):
        list(reader.read(Asked("chat", 0, 10)))
    assert Fails.left == 6 and Fails.closed == 10
    with pytest.raises(Exception, match="nobody"):
        source(generator="nobody").count()
    assert list(PrunedReader(OPTIONS).pushFilters([])) == []


def answers_of(n, rng):
    out = []
    for category in ("email", "chat", "dull", "rare"):
        for k in range(n):
            size = {"email": rng.choice([0, 3, 10]), "chat": 7, "dull": 1 if k < 4 else 0, "rare": 1 if k % 3 == 0 else 0}[category]
            out.append({"category": category, "ordinal": k, "items": [f"{category} {k} {i}" for i in range(size)]})
    return out


def test_stream_restarts(spark, tmp_path):
    """Stopped after every few files and once in the middle of a write: the items
    are those of one pass over all answers."""
    rng = random.Random(4)
    answers = answers_of(24, rng)
    want = {}
    for category in {a["category"] for a in answers}:
        own = [a["items"] for a in answers if a["category"] == category]
        state, items = G.advanced((0, 0, 0), own, 20, 60, 3)
        want |= {f"{category}_{i:04d}": x for i, x in enumerate(items)}
        assert state[0] == len(items) <= 20
    assert len([x for x in want if x.startswith("dull")]) == 4 and len([x for x in want if x.startswith("chat")]) == 20
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    broken = {"now": False}
    real = type(spark.range(1).write).json

    def json_or_fail(self, path, *args, **kwargs):
        real(self, path, *args, **kwargs)
        if broken["now"]:
            broken["now"] = False
            raise OSError("lost after the write, before the commit")

    try:
        type(spark.range(1).write).json = json_or_fail
        for part in range(4):
            rows = [a for a in answers if a["ordinal"] // 6 == part]
            (tmp_path / "in" / f"{part}.json").write_text("\n".join(map(json.dumps, rows)))
            stream = spark.readStream.schema("category string, ordinal long, items array<string>").json(folder)
            broken["now"] = part == 2
            query = G.save(G.collected(stream, 20, 3), out, mark)
            if part == 2:
                with pytest.raises(Exception, match="lost after"):
                    query.awaitTermination()
                query = G.save(G.collected(stream, 20, 3), out, mark)
            query.awaitTermination()
    finally:
        type(spark.range(1).write).json = real
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = [(r.content_id, r.item) for r in spark.read.json(out).collect()]
    assert dict(got) == want and len(got) == len(want)


def test_advanced():
    assert G.advanced((0, 0, 0), [[], [], ["a"], [], [], [], ["b"]], 5, 100, 3) == ((1, 6, 3), ["a"])
    assert G.advanced((4, 1, 0), [["a", "b"], ["c"]], 5, 100, 3) == ((5, 2, 0), ["a"])
    assert G.advanced((0, 0, 0), [["a"]] * 9, 50, 4, 3) == ((4, 4, 0), ["a"] * 4)


def counted():
    """A class of its own, which goes to workers as a value."""

    class Counted(models.EchoReader):
        """Tells a file what is done with it."""

        path = None

        def tell(self, what):
            with open(self.path, "a") as f:
                f.write(f"{what} {os.getpid()}\n")

        def __init__(self, path):
            self.path = path
            self.tell("load")

        def transcribe(self, images):
            if "bad" in images:
                raise ValueError("unreadable")
            return super().transcribe(images)

        def rest(self):
            self.tell("rest")

        def wake(self):
            self.tell("wake")

        def close(self):
            self.tell("close")

    return Counted


def test_pool(tmp_path):
    """Loaded once, put to rest between tasks, closed on eviction and failure."""
    Counted = counted()
    made = {n: (lambda n=n: Counted(str(tmp_path / n))) for n in "ab"}
    said = lambda n: [x.split()[0] for x in (tmp_path / n).read_text().splitlines()]
    pool = models.Pool(1)
    for _ in range(3):
        with pool.lent("a", made["a"]):
            pass
    assert said("a") == ["load", "rest", "wake", "rest", "wake", "rest"]
    with pool.lent("b", made["b"]):
        pass
    assert said("a")[-1] == "close" and list(pool.idle) == ["b"]
    with pytest.raises(OSError), pool.lent("b", made["b"]):
        raise OSError
    assert said("b") == ["load", "rest", "wake", "close"] and not pool.idle


def test_pool_in_tasks(spark, tmp_path, monkeypatch):
    path, Counted = str(tmp_path / "log"), counted()
    monkeypatch.setitem(models.REGISTRY, "counted", lambda: Counted(path))
    rows = spark.range(40).selectExpr("cast(id AS string) AS image_id", "'hello' AS image").repartition(20)
    assert models.transcribe(rows, "counted").count() == models.transcribe(rows, "counted").filter("transcript = 'he11o'").count() == 40
    told = [x.split() for x in (tmp_path / "log").read_text().splitlines()]
    loads = [pid for what, pid in told if what == "load"]
    assert len(loads) == len(set(loads)) < 20 and sum(what == "rest" for what, _ in told) >= 20
    bad = spark.range(1).selectExpr("'1' AS image_id", "'bad' AS image")
    with pytest.raises(Exception, match="unreadable"):
        models.transcribe(bad, "counted").collect()
    assert "close" in (tmp_path / "log").read_text()


def test_cap_reads_first_files(spark, tmp_path):
    """Files beyond those that hold the first rows are not read."""
    folder = tmp_path / "labels.jsonl"
    folder.mkdir()
    for k in range(6):
        rows = [json.dumps({"image_id": f"{k}-{i}", "split": "train" if i % 2 else "test"}) for i in range(4)]
        (folder / f"{k}.json").write_text("\n".join(rows) if k < 5 else "{broken")
    got = files.labels(spark, str(tmp_path), cap=3, split="train")
    assert [r.image_id for r in got.collect()] == ["0-1", "0-3", "1-1"] and {f.rsplit("/")[-1] for f in got.inputFiles()} == {f"{k}.json" for k in range(4)}
    got = files.labels(spark, str(tmp_path), cap=2)
    assert [r.image_id for r in got.collect()] == ["0-0", "0-1"] and len(got.inputFiles()) == 1
