"""A training-data pipeline over ``documents``: language, near copies, personal data, mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import language, mixing, packing, pii, simhash
from wayfold.llm.names import free_name
from wayfold.storage import written

#: Documents whose nearest profile is further off than this are in none of the languages.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or near no language profile. The rest keep their columns as they are."""
    learned = language.profiles(docs.where(language.trains("doc_id")))
    pred, score = (free_name(x, docs) for x in ("lang_pred", "score"))
    seen = language.identify(docs, learned, pred=pred, score_as=score)
    return seen.where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars, where there is one, follows the text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", identify_language),
    ("near-copy removal", drop_near_copies),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and 64-bit hashes of shingles are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
