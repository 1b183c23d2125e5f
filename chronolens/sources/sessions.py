"""Sessions that are replaced as a whole, in a bucketed table.

An agent's session file grows, and each reading of it gives all its rows anew. A batch is written as a version of its sessions, under the batch's number, into a
table of Spark's own that is partitioned by version and bucketed and sorted by session. So
 - a batch that runs again replaces itself, and what is delivered again is just a newer version;
 - the latest version of every session is found without moving the store: both the aggregate and the join keep to the buckets;
 - some sessions are read from their buckets alone;
 - old versions are folded into one, each task taking a bucket, again without moving the store.

Rows with a null key belong to no session and are left out. A folded version is complete before the older ones go, and whoever reads in between sees the older rows outdone, so that a fold may be cut
short anywhere and run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .days import drop_folder, exists

VERSION = "version"


def create(spark: SparkSession, table: str, path: str, columns: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """The table over the folder, which may hold versions from before."""
    named = ", ".join(f"`{k}`" for k in keys)
    by = ", ".join(f"`{k}`" for k in [*keys, *order])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {VERSION} BIGINT) USING parquet PARTITIONED BY ({VERSION}) CLUSTERED BY ({named}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if exists(spark, path):
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def _write(rows: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    spark = rows.sparkSession
    names = spark.table(table).columns
    # as many partitions as buckets, so that a task writes one; a session of very many rows may be split, which makes one more file of its bucket
    dealt = rows.select(*names).hint("rebalance", buckets, *keys)
    was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", was)


def put(batch: DataFrame, number: int, table: str, keys: list[str], buckets: int = 64) -> None:
    """All rows of the batch's sessions, as version `number`."""
    _write(batch.dropna(subset=keys).withColumn(VERSION, F.lit(number).cast("long")), table, keys, buckets)


def replacing(table: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""
    return lambda batch, number: put(batch, number, table, keys, buckets)


def _outdone(rows: DataFrame, keys: list[str]) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max(VERSION).alias("_last"))
    # >= and not =, so that the version is no key of the join, which would have to move the store
    return rows.join(last, keys).where(F.col(VERSION) >= F.col("_last")).drop("_last")


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The rows of each session's latest version."""
    return _outdone(spark.table(table), keys)


def of_sessions(spark: SparkSession, table: str, key: str, ids: list) -> DataFrame:
    """Current rows of some sessions of a table with one key, read from their buckets only."""
    return _outdone(spark.table(table).where(F.col(key).isin(ids)), [key])


def versions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(r[0].partition("=")[2]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def fold(spark: SparkSession, table: str, path: str, keys: list[str], least: int | None = None, buckets: int = 64) -> None:
    """All versions (those from `least` on) as one, under the latest one's number."""
    every = [v for v in versions(spark, table) if least is None or v >= least]
    if len(every) < 2:
        return
    rows = spark.table(table).where(F.col(VERSION).isin(every))
    _write(_outdone(rows, keys).withColumn(VERSION, F.lit(every[-1])), table, keys, buckets)
    for v in every[:-1]:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({VERSION} = {v})")
        drop_folder(spark, f"{path}/{VERSION}={v}")
