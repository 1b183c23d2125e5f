"""The pipeline on a small corpus with known cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolens.llm.common import staged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    vocabulary = {"en": ["tion", "ing", "the", "er", "and"], "de": ["ung", "keit", "sch", "ein", "ver"]}
    text = lambda lang, n: " ".join("".join(rng.choices(vocabulary[lang], k=rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), rng.randrange(60, 120)), lang) for i in range(200)]
    item = text("en", 30)
    rows += [(300, rows[0][1], "en"), (301, rows[1][1] + " tioning", "en"), (302, text("en", 40) + " " + item + " " + text("en", 40), "en")]
    rows += [(400 + i, " ".join(w + "###" for w in text("en", 80).split()), "en") for i in range(60)]
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert not any(i >= 400 for i in left["quality"]) and len(left["quality"]) >= 200
    assert len(left["language"]) >= 0.99 * len(left["quality"])
    assert {300, 301}.isdisjoint(left["near_duplicates"]) and {0, 1} <= left["near_duplicates"]
    assert left["near_duplicates"] - left["decontamination"] == {302}
    assert left["tokens"] == left["decontamination"]


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
    assert docs.count() == 0


def test_null_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(2).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
    assert docs.count() > 100


def test_language_stage_keeps_unlabelled_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, docs, folder).count() == docs.count()


def test_quality_stage_without_two_classes(spark, tmp_path):
    """Labels of one class only teach nothing, and no document goes."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(22)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, labels in {"low": [(0, 0), (1, 0)], "high": [(0, 1), (1, 1)], "none": []}.items():
        spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.quality_stage(spark, docs, f"{tmp_path}/{name}").count() == 22
