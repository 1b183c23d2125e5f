"""Evaluation of groupings against labels through contingency counts; no pairs of events are made.

Truth: session_id, ref, tag (null: noise), important. Prediction: session_id, ref, cluster (null: none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .intervals import gap_buckets, repo_gap_buckets


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def contingency(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """session_id, tag, cluster, n over labelled events; an event that is in no cluster is one of its own."""
    both = truth.where(F.col("tag").isNotNull()).join(predicted, ["session_id", "ref"], "left")
    own = F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("?"), F.col("ref").cast("string")))
    return both.groupBy("session_id", F.col("tag"), own.alias("cluster")).agg(F.count("*").alias("n"))


def pairwise(counts: DataFrame) -> DataFrame:
    """session_id, tp, truth_pairs, pred_pairs, events, precision, recall, f1, false_merge, false_split, ari."""
    cells = counts.groupBy("session_id").agg(F.sum(_pairs(F.col("n"))).alias("tp"), F.sum("n").alias("events"))
    side = lambda c, name: counts.groupBy("session_id", c).agg(F.sum("n").alias("n")).groupBy("session_id").agg(F.sum(_pairs(F.col("n"))).alias(name))
    m = cells.join(side("tag", "truth_pairs"), "session_id").join(side("cluster", "pred_pairs"), "session_id")
    ratio = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    m = m.withColumns({"precision": ratio("tp", "pred_pairs", 0.0), "recall": ratio("tp", "truth_pairs", 0.0)})
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    m = m.withColumns({"false_merge": F.when(F.col("pred_pairs") > 0, 1 - F.col("precision")).otherwise(0.0), "false_split": 1 - F.col("recall")})
    every, expected = _pairs(F.col("events")), F.col("truth_pairs") * F.col("pred_pairs") / _pairs(F.col("events"))
    most = (F.col("truth_pairs") + F.col("pred_pairs")) / 2
    return m.withColumn("ari", F.when((every > 0) & (most != expected), (F.col("tp") - expected) / (most - expected)).otherwise(1.0))


def split_merge(counts: DataFrame) -> DataFrame:
    """session_id, merged (clusters with events of several tags), split (tags over several clusters), delta (clusters less tags), coverage, purity (means over tags of the best cluster's)."""
    tags = counts.groupBy("session_id", "tag").agg(F.countDistinct("cluster").alias("clusters"), F.sum("n").alias("size"), F.max_by(F.struct("cluster", "n"), F.struct(F.col("n"), F.col("cluster"))).alias("best"))
    clusters = counts.groupBy("session_id", "cluster").agg(F.countDistinct("tag").alias("tags"), F.sum("n").alias("cluster_size"))
    matched = tags.join(clusters.select("session_id", F.col("cluster").alias("bc"), "cluster_size"), (F.col("best.cluster") == F.col("bc")) & (tags.session_id == clusters.session_id)).select(tags.session_id, "clusters", (F.col("best.n") / F.col("size")).alias("coverage"), (F.col("best.n") / F.col("cluster_size")).alias("purity"))
    t = matched.groupBy("session_id").agg(F.count_if(F.col("clusters") > 1).alias("split"), F.count("*").alias("n_tags"), F.avg("coverage").alias("coverage"), F.avg("purity").alias("purity"))
    c = clusters.groupBy("session_id").agg(F.count_if(F.col("tags") > 1).alias("merged"), F.count("*").alias("n_clusters"))
    return t.join(c, "session_id").select("session_id", "merged", "split", (F.col("n_clusters") - F.col("n_tags")).alias("delta"), "coverage", "purity")


def matches(counts: DataFrame) -> DataFrame:
    """session_id, tag, cluster, n: each tag and cluster in one pair at most, by falling n (ties: smaller tag, then cluster), as one takes the greatest pair that is left again and again.

    In rounds: every pair that is the first of its tag and of its cluster at once is taken, as nothing can come before it; a round takes one pair a session at least, mostly far more."""
    best = [F.desc("n"), F.asc("tag"), F.asc("cluster")]
    first = lambda side: F.row_number().over(Window.partitionBy("session_id", side).orderBy(*best)) == 1
    left, out = staged(counts.select("session_id", "tag", "cluster", "n"), "counts"), None
    while True:
        taken = staged(left.withColumns({"_t": first("tag"), "_c": first("cluster")}).where("_t and _c").drop("_t", "_c"), "taken")
        out = taken if out is None else out.union(taken)
        rest = left.join(taken.select("session_id", "tag"), ["session_id", "tag"], "left_anti").join(taken.select("session_id", "cluster"), ["session_id", "cluster"], "left_anti")
        left = staged(rest.select("session_id", "tag", "cluster", "n"), "rest")
        if left.isEmpty():
            return out


def important_recall(truth: DataFrame, predicted: DataFrame, counts: DataFrame) -> DataFrame:
    """session_id, important_recall: of a tag's important events, those in its best cluster; mean over tags."""
    best = counts.groupBy("session_id", "tag").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("best"))
    rows = truth.where(F.col("tag").isNotNull() & F.col("important")).join(predicted, ["session_id", "ref"], "left").join(best, ["session_id", "tag"])
    tags = rows.groupBy("session_id", "tag").agg(F.avg(F.coalesce(F.col("cluster").cast("string") == F.col("best"), F.lit(False)).cast("int")).alias("r"))
    return tags.groupBy("session_id").agg(F.avg("r").alias("important_recall"))


def noise_absorbed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """session_id, noise_absorbed: noise events in clusters that hold labelled events."""
    both = truth.join(predicted, ["session_id", "ref"]).where(F.col("cluster").isNotNull())
    real = both.where(F.col("tag").isNotNull()).select("session_id", "cluster").distinct()
    return both.where(F.col("tag").isNull()).join(real, ["session_id", "cluster"], "left_semi").groupBy("session_id").agg(F.count("*").alias("noise_absorbed"))


#: Baselines: events (session_id, ref, ord, ts_ms, end_ms, app, repository) to predictions.
PREDICTORS = {
    "single": lambda e: e.select("session_id", "ref", F.lit("all").alias("cluster")),
    "per-event": lambda e: e.select("session_id", "ref", F.col("ref").cast("string").alias("cluster")),
    "per-repository": lambda e: e.select("session_id", "ref", F.coalesce("repository", F.lit("none")).alias("cluster")),
    "per-application": lambda e: e.select("session_id", "ref", F.coalesce("app", F.lit("none")).alias("cluster")),
    "time-gap": lambda e: gap_buckets(e, ["session_id"], 15 * 60_000).select("session_id", "ref", F.col("bucket").cast("string").alias("cluster")),
    "repository-and-gap": lambda e: repo_gap_buckets(e, ["session_id"], 15 * 60_000).select("session_id", "ref", F.col("bucket").cast("string").alias("cluster")),
}


def oracle(truth: DataFrame) -> DataFrame:
    """The labels as a prediction."""
    return truth.select("session_id", "ref", F.col("tag").cast("string").alias("cluster"))


def from_assignments(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """The grouping engine's contexts as a prediction; events in none have a null cluster. events: session_id, work_day, ord, ref."""
    on = ["session_id", "work_day", "ord"]
    held = events.select(*on, "ref").join(assigned.select(*on, "context"), on, "left")
    return held.select("session_id", "ref", F.concat_ws(".", F.col("work_day").cast("string"), F.when(F.col("context").isNotNull(), F.col("context").cast("string"))).alias("c"), "context").select("session_id", "ref", F.when(F.col("context").isNotNull(), F.col("c")).alias("cluster"))


def registry(events: DataFrame, truth: DataFrame, assigned: DataFrame) -> dict[str, DataFrame]:
    """All eight predictions by name: the baselines, the labels themselves and the engine's contexts."""
    return {name: f(events) for name, f in PREDICTORS.items()} | {"labels": oracle(truth), "engine": from_assignments(events, assigned)}


def detail(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """All measures of each session in one row; matches as an array of (tag, cluster, n), the largest first."""
    counts = staged(contingency(truth, predicted), "contingency")
    listed = matches(counts).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tag", "cluster"))).alias("all"))
    listed = listed.select("session_id", F.transform("all", lambda x: F.struct(x["tag"].alias("tag"), x["cluster"].alias("cluster"), (-x["less"]).alias("n"))).alias("matches"))
    out = pairwise(counts)
    for part in (split_merge(counts), important_recall(truth, predicted, counts), noise_absorbed(truth, predicted), listed):
        out = out.join(part, "session_id", "left")
    return out.withColumn("noise_absorbed", F.coalesce("noise_absorbed", F.lit(0).cast("long")))


def summary(truth: DataFrame, predictions: dict[str, DataFrame], sessions: str | None = None) -> DataFrame:
    """predictor, sessions, f1, false_merge, false_split, ari: means over the sessions, of those whose name holds the text given."""
    if sessions is not None:
        truth = truth.where(F.contains("session_id", F.lit(sessions)))
    out = None
    for name, predicted in predictions.items():
        means = pairwise(contingency(truth, predicted)).agg(F.count("*").alias("sessions"), *[F.avg(c).alias(c) for c in ("f1", "false_merge", "false_split", "ari")])
        means = means.select(F.lit(name).alias("predictor"), "*")
        out = means if out is None else out.union(means)
    return out
