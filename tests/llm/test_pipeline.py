"""The pipeline on adverse tables, and its stages against the operators' rules by
brute force."""

import random

import corpus_pipeline
import public_tokenizers as P
from inkwell.llm import bpe, decontaminate, simhash

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}
RNG = random.Random(21)
WORDS = ["".join(RNG.choices("abcdefgho", k=RNG.randint(2, 7))) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def written(spark, folder, **tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in texts]


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "lang", "source"] and out.count() == 0


def test_adverse_rows(spark, tmp_path):
    long = prose(30_000)
    texts = [(1, prose(60)), (2, None), (3, ""), (None, prose(40)), (None, None), (4, long), (5, "mail jane@example.com " + prose(30)), (6, "same " + prose(50))]
    texts += [(1, texts[0][1]), (7, texts[0][1].upper()), (6, prose(45))]
    folder = written(spark, tmp_path, documents=rows_of(texts), labels=[(1, 1, 0), (None, 1, 1), (99, 0, 1)], benchmark=[(None, prose(20)), (1, None), (2, "")])
    out = corpus_pipeline.run(spark, folder).collect()
    codec = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert sorted((r.doc_id for r in out), key=repr) == sorted([1, 2, 4, 5, 6, None, None], key=repr)
    by_id = {r.doc_id: codec.decode(b"".join(x.to_bytes(4, "little") for x in r.ids)).decode() for r in out if r.doc_id}
    assert by_id[1] == texts[0][1] and by_id[4] == long and "jane" not in by_id[5] and by_id[2] == "" and by_id[6] in {t for i, t in texts if i == 6}


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, held against the plain rule."""
    items = [(k, prose(25)) for k in range(6)]
    base = [(k, prose(RNG.choice([30, 80, 200]))) for k in range(60)]
    texts = list(base)
    for k in range(30):
        w = base[k % 12][1].split()
        w[RNG.randrange(len(w))] = "changed"
        texts.append((100 + k, " ".join(w)))
    texts += [(200 + k, f"{prose(10)} {item} {prose(10)}") for k, item in items]
    folder = written(spark, tmp_path, documents=rows_of(texts), labels=[], benchmark=items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, folder)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts}
    own = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and own[i] != own[j]:
                a, b = sorted((own[i], own[j]))
                own = {k: a if v == b else v for k, v in own.items()}
    assert {r.doc_id for r in kept.collect()} == set(own.values()) and kept.columns == docs.columns
    clean = stages["decontamination"](spark, kept, folder)
    leaks = {i for i, t in texts for _, x in items if decontaminate.edit_within(x, decontaminate.normalise(t), int(0.2 * len(x) + 1e-9))}
    assert {r.doc_id for r in clean.collect()} == set(own.values()) - leaks and clean.columns == docs.columns
    assert stages["pii"](spark, clean, folder).columns == docs.columns
