"""A training corpus from raw documents: five stages, each written as Parquet before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.llm import language, mixing, neardup, packing, surrogates
from strandbook.llm.common import shared_dir

LEAST_SCORE = 0.5  # mean probability of the language below which a document is rejected


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letters, or in none of the learned languages, go.

    So null and empty texts go; repeated rows stay; an empty table stays empty."""
    named = language.identify(docs, language.fit(docs))
    return named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and one row of each doc_id.

    Rows without doc_id stay; an empty table stays empty."""
    return neardup.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the text.

    The key is the session's setting or a new one for each run; null texts stay null."""
    return surrogates.replace(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place in the mix; every row stays.

    A column named position is replaced.  The rows are not sorted: packing reads the place."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c != "position"], "position")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences, which follow the mix.

    Null and empty texts are one piece of the end id alone; an empty table gives no pieces."""
    return packing.pack_in_order(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: trained networks and tokenizers can't be expressed in SQL; the stages' tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
