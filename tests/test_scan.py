"""Scans in two passes against the windows of intervals.py, and one session of very many events."""

import random

import pytest
from pyspark.sql import functions as F

from chronolens.operators import intervals, scan

SCHEMA = "session long, ord long, ts_ms long, end_ms long, repository string"


@pytest.fixture(scope="module")
def events(spark):
    rng, rows = random.Random(4), []
    for i in range(1_500):
        session = rng.choice([1, 1, 1, 1, 2, 3, None])
        ts = rng.randrange(0, 4_000) * 10
        rows.append((session, i, ts, rng.choice([ts, ts + 5, ts + 900, None]), rng.choice(["a", "a", "b", None])))
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_scans_equal_windows(events, blocks):
    e = events.withColumn("end_ms", F.coalesce("end_ms", "ts_ms"))
    same(scan.gap_buckets(e, ["session"], 60, blocks=blocks), intervals.gap_buckets(e, ["session"], 60))
    same(scan.repo_gap_buckets(e, ["session"], 60, blocks=blocks), intervals.repo_gap_buckets(e, ["session"], 60))
    same(scan.changes_only(e, ["session"], F.col("repository"), blocks=blocks), intervals.changes_only(e, ["session"], F.col("repository")))
    same(scan.run_collapse(e, ["session"], F.col("repository"), blocks=blocks), intervals.run_collapse(e, ["session"], F.col("repository")))
    spans = e.select("session", F.col("ts_ms").alias("start"), F.col("end_ms").alias("end"))
    same(scan.merged_spans(spans, ["session"], 20, blocks=blocks), intervals.merged_spans(spans, ["session"], 20))


@pytest.mark.parametrize("blocks", [1, 9])
def test_pause_gate_equals_join(spark, events, blocks):
    rng = random.Random(6)
    pauses = [(rng.choice([1, 1, 2, None]), f := rng.randrange(40_000), rng.choice([f + rng.randrange(-5, 900), f])) for _ in range(60)] + [(3, 20_000, None), (1, None, 5)]
    p = spark.createDataFrame(pauses, "session long, from_ms long, until_ms long")
    got = scan.pause_gate(events, p, ["session"], blocks)
    same(got, intervals.pause_gate(events, p, ["session"]))
    assert 0 < got.count() < events.count() and got.columns == events.columns
    same(scan.pause_gate(events, p.limit(0), ["session"], blocks), events)


def test_empty(spark, events):
    none = events.limit(0)
    assert scan.gap_buckets(none, ["session"], 60).count() == 0 and scan.run_collapse(none, ["session"], F.col("repository")).count() == 0


def test_one_session_of_a_million_events(spark, monkeypatch):
    """Blocks stay small: no window's task sees much more than its share."""
    n, blocks = 1_000_000, 50
    e = spark.range(n).select(F.lit(7).alias("session"), F.col("id").alias("ord"), (F.col("id") * 1000 + F.when(F.col("id") % 1000 == 0, 900).otherwise(0)).alias("ts_ms"), (F.col("id") * 1000 + 500).alias("end_ms"), F.lit("r").alias("repository"))
    held = []
    monkeypatch.setattr(scan, "staged", lambda df, name: held.append(scan_staged(df, name)) or held[-1])
    got = scan.gap_buckets(e, ["session"], 600, blocks=blocks)
    assert tuple(got.agg(F.count("*"), F.max("bucket"), F.countDistinct("bucket")).first()) == (n, 1_000, 1_000)
    sizes = [r["count"] for r in held[0].groupBy("_block").count().collect()]
    assert len(sizes) == blocks and max(sizes) < 3 * n / blocks


scan_staged = scan.staged
