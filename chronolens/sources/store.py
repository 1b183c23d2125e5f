"""The event store: a table partitioned by work day. Only rows with a redaction stamp may enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(events: DataFrame, path: str) -> None:
    """Write redacted events; fails if the stamp is missing, drops what isn't safely redacted."""
    if "redaction_ok" not in events.columns:
        raise ValueError("events have no redaction stamp")
    events.where(F.coalesce("redaction_ok", F.lit(False))).hint("rebalance", "work_day").sortWithinPartitions("work_day", "ts_ms", "ord").write.mode("append").partitionBy("work_day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_sessions(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The store with all rows of fresh's keys replaced by fresh's."""
    return store.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def recent(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("ts_ms"), F.desc("ord")).limit(limit)


def for_day(events: DataFrame, day: str, limit: int) -> DataFrame:
    return events.where(F.col("work_day") == F.lit(day).cast("date")).orderBy("ts_ms", "ord").limit(limit)


def days(events: DataFrame, limit: int) -> DataFrame:
    grouped = events.groupBy("work_day").agg(F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"), F.max(F.coalesce("end_ms", "ts_ms")).alias("last_ms"))
    return grouped.orderBy(F.desc("work_day")).limit(limit)


def work_paths(events: DataFrame, since_ms: int, limit: int, paths: list[Column] | None = None) -> DataFrame:
    """The most frequent places of work since a time; paths: where to look for them, first found first."""
    found = paths or [F.get_json_object("metadata", f"$.{k}") for k in ("projectPath", "workspacePath", "cwd", "path")]
    rows = events.where(F.col("ts_ms") >= since_ms).select(F.coalesce(*found).alias("path")).where(F.col("path").isNotNull())
    return rows.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(limit)


def total(events: DataFrame) -> int:
    return events.count()


def close_spans(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Focus samples (keys, ts_ms, ord, key) as spans: a span ends where the next one begins; the last one is open (null end)."""
    from pyspark.sql import Window

    from ..operators.intervals import changes_only

    first = changes_only(samples, keys, F.col("key"))
    return first.withColumn("end_ms", F.lead("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms", "ord")))
