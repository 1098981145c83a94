"""A corpus made ready for training, by five of the operators in ``inkwell.llm``.

Each stage takes what its predecessor kept. Toxic documents go, one document of
each near-duplicate group stays, documents that hold a benchmark item go,
personal data becomes pseudonyms, and texts become token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontaminate, pii, simhash, toxicity
from inkwell.llm.common import checkpointed, table
from inkwell.llm.queries import PII_KEY, RANKS, TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, learned from the labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash by multi-index hashing, as ``op5_simhash``, and MinHash for links
    beyond its radius; links of both are verified on the whole sets."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(docs, PII_KEY).drop("pii_kinds")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, blanks_lead=True, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("tokens", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs


#: Trained and byte-level stages can't be written in SQL.
ORACLE_SQL = None
