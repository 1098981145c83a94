"""Token files against the library, their random access and their manifest."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkwell.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(13)
DOCS = "doc_id long, text string, start string, part int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strings(n):
    letters = ["a", "Σ", "ς", "é", "é", "́", "İ", "ß", "ﬁ", "你", "٣", "9", "'", "'S", "'ll", "-", "…", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "🙂", "​", "<|endoftext|>", "Word", "\u0000", "A", "K.", "!?", "'T", "$", "\u0338"]
    return ["".join(RNG.choices(letters, k=RNG.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("folds", [False, True])
def test_words_as_the_library(library, folds):
    words = tokenfiles.Words(PATH, folds, known=50)
    for text in strings(3000):
        assert np.frombuffer(words.ids(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces():
    for text in [b"", b"abc", b"ab cd  ef\ngh " * 50, b"x" * 99, b"x" * 99 + b" y", " é ".encode() * 40]:
        parts = list(tokenfiles.pieces(text, 10))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_round_trip(spark, tmp_path, library):
    rows = [(RNG.choice([None, *range(-20, 200)]), t, "x", 1) for t in [*strings(300), None, "", "word " * 9000]]
    rows += [(77, "a hot id", "x", 1)] * 150
    RNG.shuffle(rows)
    folder = f"file://{tmp_path}/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write(spark.createDataFrame(rows, DOCS), folder, PATH, 2, length=16, batch=4, folds=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, folder, "ids_crc32 long", tokenfiles.crc32).collect())
    assert len(got) == len(rows)
    at = 0
    for _, _, start, n, _ in sorted(got, key=lambda r: r[2]):
        assert start == at
        at += n
    assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == [r[:2] for r in got]
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i is not None, i or 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((a, b, n, crc) for a, b, _, n, crc in got) == sorted(want)

    # Every sequence by random access is what all ids, cut file by file, give.
    shards = tokenfiles.shards(spark, folder)
    assert len(shards) > 1
    table = {r.sequence: (r.ids, r["mask"]) for r in tokenfiles.sequences(spark, folder).collect()}
    n_real = 0
    for shard in shards:
        file = tokenfiles.SequenceFile(folder, shard.file)
        own = [np.concatenate(views) for _, docs in file.parts() for views in docs]
        stream = np.concatenate(own)
        for i in range(-(-len(stream) // 16)):
            ids, mask = file.sequence(i)
            real = stream[i * 16 : (i + 1) * 16]
            assert len(ids) == len(mask) == 16 and ids[: len(real)].tolist() == real.tolist() and mask.to_pylist() == [True] * len(real) + [False] * (16 - len(real))
            assert table[shard.first_sequence + i] == (ids.tolist(), mask.to_pylist())
            n_real += mask.true_count
    assert n_real == at and len(table) == sum(-(-n // 16) for n in file_sizes(spark, folder))


def file_sizes(spark, folder):
    return [r.n_ids for r in spark.read.parquet(f"{folder}/_manifest").collect()]


def test_zero_copy(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    tokenfiles.write(spark.createDataFrame([(i, "some words here", "", 0) for i in range(100)], DOCS).coalesce(1), folder, PATH, 2, length=8, batch=4)
    shard = tokenfiles.shards(spark, folder)[0]
    before = pa.total_allocated_bytes()
    file = tokenfiles.SequenceFile(folder, shard.file)
    kept = [file.sequence(i) for i in range(20)]
    ids, mask = kept[5]
    assert ids.base is not None and not ids.flags.writeable and pa.total_allocated_bytes() - before < 4096
    after = file.sequence(6)
    assert ids.ctypes.data + 16 == after[0].ctypes.data and mask.buffers()[1].address == after[1].buffers()[1].address


def test_orphans_and_empty(spark, tmp_path):
    """What a lost task leaves isn't read; empty tables give no row."""
    folder = f"file://{tmp_path}/out"
    tokenfiles.write(spark.createDataFrame([(1, "a b", "", 0)], DOCS), folder, PATH, 2)
    (tmp_path / "out" / "part-000000-left.arrow").write_bytes(b"half")
    (tmp_path / "out" / "part-000000-left.docs.arrow").write_bytes(b"")
    assert [(r.doc_id, r.start, r.n_tokens) for r in tokenfiles.read(spark, folder, "crc long", tokenfiles.crc32).collect()] == [(1, 0, 3)]
    folder = f"file://{tmp_path}/none"
    tokenfiles.write(spark.createDataFrame([], DOCS), folder, PATH, 2)
    assert tokenfiles.read(spark, folder, "crc long", tokenfiles.crc32).count() == 0 and tokenfiles.sequences(spark, folder).count() == 0
