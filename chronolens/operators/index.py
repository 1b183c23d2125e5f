"""An inverted index of searchable facts: which of them hold a term, without reading or cutting their texts again.

Three tables of Spark's own, each with a folder a batch, so that a batch that runs again replaces itself:
  postings   token, id: sorted by token within ranges of tokens, so that a term, or the beginning of one, is a short stretch of few files, which the
             statistics of the files' row groups find; a token of very many facts spans several files
  words      token, n: in how many facts of the batch it is
  facts      id and what ranking takes besides tokens
A fact belongs to one batch. Ranking gives what corpus.rank gives for the same facts, ids included that hold no term.

Facts without tokens have no postings; null ids and null tokens are left out. Empty tables give an index that finds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus

BATCH = "batch"


def _write(rows: DataFrame, path: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={number}")


def add(rows: DataFrame, path: str, id: str = "id", number: int = 0, ranges: int | None = None) -> None:
    """Puts facts (id, tokens and other columns) into the index under path, as batch `number`."""
    rows = rows.where(F.col(id).isNotNull())
    each = rows.select(F.col(id).alias("id"), F.explode(F.array_distinct("tokens")).alias("token")).where(F.col("token").isNotNull())
    # by token and id, so that the ranges stay even whatever a token's share is
    dealt = each.repartitionByRange(ranges, "token", "id") if ranges else each.repartitionByRange("token", "id")
    _write(dealt.sortWithinPartitions("token", "id"), path, "postings", number)
    postings = rows.sparkSession.read.parquet(f"{path}/postings/{BATCH}={number}")
    _write(postings.groupBy("token").agg(F.count("*").alias("n")).repartitionByRange("token").sortWithinPartitions("token"), path, "words", number)
    _write(rows.drop("tokens").withColumnRenamed(id, "id"), path, "facts", number)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop(BATCH)


def _holds(term: str) -> Column:
    """Whether a posting's token is the term, or begins with it if it has three characters: both are pushed to the scan."""
    return F.col("token").startswith(term) if len(term) >= 3 else F.col("token") == term


def terms(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """token, n (facts): the words that begin so."""
    return _read(spark, path, "words").where(F.col("token").startswith(prefix)).groupBy("token").agg(F.sum("n").alias("n"))


def hits(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """id, tokens: which of the wanted terms a fact holds, for facts that hold any."""
    wanted = list(dict.fromkeys(t for t in wanted if t))
    if not wanted:
        return _read(spark, path, "postings").limit(0).groupBy("id").agg(F.collect_list("token").alias("tokens"))
    any_of = _holds(wanted[0])
    for t in wanted[1:]:
        any_of = any_of | _holds(t)
    found = _read(spark, path, "postings").where(any_of).groupBy("id").agg(*(F.max(_holds(t)).alias(f"_{i}") for i, t in enumerate(wanted)))
    return found.select("id", F.array_compact(F.array(*(F.when(F.col(f"_{i}"), F.lit(t)) for i, t in enumerate(wanted)))).alias("tokens"))


def idf(spark: SparkSession, path: str, wanted: list[str]) -> dict[str, float]:
    """ln(1 + N / (1 + df)) as corpus.idf gives it, from the postings of the terms alone."""
    if not wanted:
        return {}
    total = _read(spark, path, "facts").count()
    found = hits(spark, path, wanted)
    df = found.agg(*(F.count_if(F.array_contains("tokens", t)).alias(f"_{i}") for i, t in enumerate(wanted))).first()
    return {t: math.log(1 + total / (1 + df[i])) for i, t in enumerate(wanted)}


def ranked(spark: SparkSession, path: str, wanted: list[str], now_ms: int, **how) -> DataFrame:
    """The facts of the index with what corpus.rank gives them. A term that a fact holds stands for the token it was found by: whatever begins with the one begins with the other."""
    rows = _read(spark, path, "facts").join(hits(spark, path, wanted), "id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    return corpus.rank(rows, wanted, now_ms, weight=idf(spark, path, wanted), **how)
