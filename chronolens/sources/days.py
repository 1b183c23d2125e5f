"""Tables kept by work day, and results that follow them: a batch of events, late ones among them, has just its days read and computed anew.

The store's files lie in folders work_day=.../batch=...; a batch replaces what it wrote under its number, so that running it again changes nothing. Reading is
pruned to the days that are wanted by their folders' names, and results are written by overwriting those days' folders only. An event delivered again, in the same batch or a
later one, counts once: of the rows of a key the latest batch's stays (of one batch's, the largest).

Rows without a work day belong to none and are left out. A day whose result is empty loses its folder. Batches of a day are folded into one when there are many; at
any moment a reader may see a row in both its old place and its new one, which count once as any row delivered again does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged

DAY, BATCH = "work_day", "batch"


def put(batch: DataFrame, number: int, path: str) -> None:
    """Writes a batch under its number. A day of very many rows becomes several files, days of few rows share a task."""
    rows = batch.where(F.col(DAY).isNotNull()).withColumn(BATCH, F.lit(number).cast("long"))
    rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(path)


def _day_type(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.col(DAY).cast("date")).withColumn(BATCH, F.col(BATCH).cast("long"))


def stored(spark: SparkSession, path: str, days: list | None = None) -> DataFrame:
    """All rows ever put, or those of some days."""
    rows = _day_type(spark.read.parquet(path))
    return rows if days is None else rows.where(F.col(DAY).isin(list(days)))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the latest batch's. Aggregated before the shuffle."""
    others = [c for c in rows.columns if c not in (*keys, DAY)]
    last = rows.groupBy(DAY, *keys).agg(F.max(F.struct(BATCH, *(c for c in others if c != BATCH))).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others if c != BATCH), DAY)


def touched(spark: SparkSession, path: str, number: int) -> list:
    """Days that a batch has rows of, from the names of its folders; a batch has as many of them as days."""
    found = _day_type(spark.read.parquet(path)).where(F.col(BATCH) == number).select(DAY).distinct()
    return sorted(r[0] for r in found.collect())


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def recompute(spark: SparkSession, store: str, target: str, days: list, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> None:
    """Results of some days anew, from the store's rows of these days alone. compute: rows to rows with a work day, each depending on its day only."""
    if not days:
        return
    fresh = staged(compute(latest(stored(spark, store, days), keys)).where(F.col(DAY).isin(list(days))), "days")
    fresh.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(target)
    left = {r[0] for r in fresh.select(DAY).distinct().collect()}
    for day in days:
        if day not in left:
            drop_folder(spark, f"{target}/{DAY}={day}")


def following(store: str, target: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: puts the batch into the store and computes the days it touches anew."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put(batch, number, store)
        if exists(spark, store):
            recompute(spark, store, target, touched(spark, store, number), keys, compute)

    return run


def fold(spark: SparkSession, path: str, days: list, keys: list[str]) -> None:
    """All batches of some days as one, under the latest one's number. The folded rows are there before the old folders go."""
    rows = stored(spark, path, days)
    names = [(r[0], r[1]) for r in rows.select(DAY, BATCH).distinct().collect()]
    newest = {day: max(b for d, b in names if d == day) for day, _ in names}
    if not newest:
        return
    last = spark.createDataFrame(list(newest.items()), f"{DAY} date, {BATCH} long")
    whole = staged(latest(rows, keys).join(F.broadcast(last), DAY), "folded")  # a row a day
    whole.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(path)
    for day, b in names:
        if b != newest[day]:
            drop_folder(spark, f"{path}/{DAY}={day}/{BATCH}={b}")


def crowded(spark: SparkSession, path: str, most: int = 16) -> list:
    """Days of more than so many batches."""
    counts = stored(spark, path).select(DAY, BATCH).distinct().groupBy(DAY).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return sorted(r[0] for r in counts.collect())


def results(spark: SparkSession, target: str, days: Column | None = None) -> DataFrame:
    rows = spark.read.parquet(target)
    rows = rows.withColumn(DAY, F.col(DAY).cast("date"))
    return rows if days is None else rows.where(days)
