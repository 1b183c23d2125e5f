"""The numbered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontamination, infill, langid, licenses, neardup, outliers, quality, rnnlm, sstable, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return sstable.read_shards(manifest)


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "n_words")


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.scores(table(spark, sf_dir, "documents"), F.coalesce(fold(10) != 0, F.lit(True)), fold(10) == 0)


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ["doc_id"], keep=False)


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(3) != 1)
    return langid.identified(docs.withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False))), model, ["doc_id", "held_out"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as it stands against the same turns with the last answer of conversation conv_id XOR 1, the tables having no preferences of their own."""
    turns = chat.with_other_answers(table(spark, sf_dir, "conversations"), F.col("conv_id").bitwiseXOR(1))
    return chat.preference_pairs(turns, F.col("pair"), F.col("is_chosen"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.scored(docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))), model, ["doc_id", "held_out"])


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = outliers.quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(variants.word_counts(table(spark, sf_dir, "documents"), deletions=199))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infilled(table(spark, sf_dir, "documents"), ["doc_id"])
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restored(output, form), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_token_shards": op2_token_shards,
    "op3_bag_minhash": op3_bag_minhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_forced_boundary_bpe": op6_forced_boundary_bpe,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_preference_format": op9_preference_format,
    "op10_quality": op10_quality,
    "op11_robust_outliers": op11_robust_outliers,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}
