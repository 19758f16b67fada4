"""A pipeline over `documents`: language, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, jaccard, language, mixing, secrets
from pagewright.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; those that are null or have none go. Where nothing can be learned, the letter alone decides."""
    model = language.train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word five-grams are alike (0.8 or more): the one with the smallest id."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text where it was changed."""
    found = secrets.scan(docs.select(F.struct("*").alias("row"), "text"))
    text = secrets.redacted(F.col("text"), F.col("secrets"))
    found = found.select("row", text.alias("text"), (F.size("secrets") > 0).alias("changed"))
    size = F.when(F.col("changed"), F.char_length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and n_tokens."""
    return bpe.encode(docs)


STAGES = [
    ("language", known_language),
    ("near copies", without_near_copies),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("tokens", tokens),
]

#: Classifiers, banding and a tokeniser are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
