"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, tokens.

``STAGES`` lists the stages. Each takes the documents that its predecessor wrote and returns what it
keeps of them, with the columns of documents; the last returns token ids with digests.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, langid, mixing, pii, simhash
from skyloom.session import remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return langid.accepted(docs, langid.fit(docs, labelled=~langid.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one whose id names the group."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes; a document may come once for each pass over its source."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was encoded and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level bpe", tokens),
]

#: SQL cannot train the language model, run message passing or tokenize; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written as Parquet and read again.

    What a stage read is removed once its own rows are written; the last stage's rows stay for the reader.
    Rows with null, empty or repeated ids, null or empty texts go through every stage by the rules that its operator
    states; a text without a letter is rejected by the first. An empty table gives an empty result.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
