"""Islands, unions of intervals, gaps and runs: window functions partitioned by a key that bounds them (a session's work day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: list[str] | None = None, tolerance: int = 0) -> DataFrame:
    """spans with a column island (from 1, within keys): a span more than `tolerance` beyond all earlier ends opens a new one."""
    by = Window.partitionBy(*keys).orderBy(start, *(order or [end]))
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0)
    return spans.withColumn("_opened", opened).withColumn("island", F.sum("_opened").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opened")


def merged_spans(spans: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """keys, island, start, end, n: the union of the spans of each key."""
    return islands(spans, keys, tolerance=tolerance).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def covered_ms(spans: DataFrame, keys: list[str], least_ms: int = 30_000) -> DataFrame:
    """keys, covered_ms: length of the union of the spans, each lasting `least_ms` at least."""
    floored = spans.select(*keys, "start", F.greatest("end", F.col("start") + least_ms).alias("end"))
    return merged_spans(floored, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_ms"))


def gap_buckets(events: DataFrame, keys: list[str], gap_ms: int, ts: str = "ts_ms", end: str = "end_ms") -> DataFrame:
    """events with a column bucket: a new one begins more than gap_ms after all earlier ends."""
    return islands(events, keys, ts, end, ["ord"], gap_ms).withColumnRenamed("island", "bucket")


def repo_gap_buckets(events: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """As gap_buckets, a new one also where the repository differs from the last known one."""
    by = Window.partitionBy(*keys).orderBy("ts_ms", "ord")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    reach, last = F.max("end_ms").over(before), F.last("repository", ignorenulls=True).over(before)
    opened = reach.isNull() | (F.col("ts_ms") > reach + gap_ms) | F.coalesce(F.col("repository") != last, F.lit(False))
    return events.withColumn("_opened", opened.cast("int")).withColumn("bucket", F.sum("_opened").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opened")


def run_collapse(events: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Consecutive events of one value as one row: keys, value, start, end, n."""
    by = Window.partitionBy(*keys).orderBy("ts_ms", "ord")
    marked = events.withColumn("value", value).withColumn("_new", (~F.col("value").eqNullSafe(F.lag("value").over(by)) | F.lag("ord").over(by).isNull()).cast("int"))
    runs = marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", "value").agg(F.min("ts_ms").alias("start"), F.max("end_ms").alias("end"), F.count("*").alias("n"))


def changes_only(events: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The events whose value differs from the one before; the first always."""
    by = Window.partitionBy(*keys).orderBy("ts_ms", "ord")
    marked = events.withColumn("_v", value)
    marked = marked.withColumn("_p", F.lag("_v").over(by)).withColumn("_first", F.row_number().over(by) == 1)
    return marked.where(F.col("_first") | ~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p", "_first")


def bursts(events: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """keys, start, end (of the last stamp), n: runs of stamps not more than gap_ms apart. Session windows, aggregated before the shuffle."""
    stamped = events.withColumn("_t", F.timestamp_millis("ts_ms"))
    grouped = stamped.groupBy(*keys, F.session_window("_t", f"{gap_ms} milliseconds")).agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"), F.count("*").alias("n"))
    return grouped.drop("session_window")


def pause_gate(events: DataFrame, pauses: DataFrame, keys: list[str]) -> DataFrame:
    """Events outside all pauses (keys, from_ms, until_ms; null until_ms: still paused) of their key. An equi-join on keys with a range condition."""
    p = pauses.select(*[F.col(k).alias(f"_{k}") for k in keys], "from_ms", "until_ms")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = (F.col("ts_ms") >= F.col("from_ms")) & (F.col("until_ms").isNull() | (F.col("ts_ms") < F.col("until_ms")))
    on = inside
    for s in same:
        on = on & s
    return events.join(p, on, "left_anti")
