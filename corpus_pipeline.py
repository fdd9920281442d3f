"""From raw documents to packed training sequences: toxicity, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from countspark.llm import packing, pii, shingles, simhash, toxicity
from countspark.llm.common import materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels of these documents, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: operator 8's index links SimHashes of five-word shingles, min-hash
    bands what these are too short for, and a Jaccard similarity of 0.8 or more, verified, decides."""
    return simhash.keep_one(docs, find=shingles.near_duplicates)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kinds of personal data in place of the data."""
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Fitted models, hashes and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has written: the pieces of every document that stays, as packing.pack_documents() gives them.

    A null or empty text is no toxic one; all such rows are copies of each other, of which one stays, with a piece that holds the end alone. Rows
    that share an id are documents of their own. Ties go to the smallest id, repeated rows leave one, very long texts are kept whole, an empty table
    gives no piece, and extra columns of any name travel along until the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
