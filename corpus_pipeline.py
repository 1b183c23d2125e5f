"""A training-data pipeline: quality, language, near duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame, which is written as
Parquet to the shared folder and read back as the next stage's docs. All but the last return the columns of documents.
An empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import bpe, decontamination, langid, neardup, quality
from chronolens.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Below such a pooled probability the network has no language for a text.
LANGUAGE_SCORE = 0.4


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't reject; all where labels of one class only, or none, teach it nothing."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fold(5) != 0)
    if not model.learned:
        return docs.select(*COLUMNS)
    return quality.scored(docs, model, COLUMNS).where(F.col("predicted") == 1).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network finds to be in one of the languages it has learned; all where no labelled text teaches it any."""
    model = langid.fit(docs, _fold(3) != 1)
    if model is None:
        return docs.select(*COLUMNS)
    found = langid.identified(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return neardup.deduplicated(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of ids and decoded text."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"]).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Models and signatures are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
