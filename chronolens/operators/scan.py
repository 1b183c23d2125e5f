"""Running values over very long sequences: a scan in two passes over blocks, so that no key's rows come together in one task.

Rows are dealt by ranges of (keys, order) into blocks of about one size, whatever the keys; a key of very many rows spans several. Within each block of a key the running value is found by a window, as
usual. Then each block is folded to one row (its greatest end, its last value, its count), these few rows are scanned in the order of the blocks, and what was before a block is
handed to all its rows. Both the window and the handing over keep to (keys, block), so that rows move once for the ranges and once for the blocks.

Results are those of the functions of the same names in intervals.py. The order (a time, then ord) is to be unique within keys; rows equal in it stand in one block. Null keys are
keys of their own. The ranges are drawn from a sample and held in a staged table, so that a block stays what it is when tasks are run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

BLOCK, KEY = "_block", "_key"


def blocked(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """rows with the number of their block and their keys as one value (never null, so that it joins), staged; as many blocks as shuffle partitions unless given."""
    by = [F.col(c) for c in (*keys, *order)]
    dealt = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    return staged(dealt.withColumns({BLOCK: F.spark_partition_id(), KEY: F.struct(*keys)}), "blocks")


def carried(rows: DataFrame, fold: dict[str, Column], scan: dict[str, Column]) -> DataFrame:
    """rows (blocked) with what is before their block. fold: aggregates of a block's rows; scan: columns from the blocks before (window functions of these)."""
    blocks = rows.groupBy(KEY, BLOCK).agg(*(value.alias(name) for name, value in fold.items()))
    before = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(blocks.select(KEY, BLOCK, *(value.over(before).alias(name) for name, value in scan.items())), [KEY, BLOCK], "left")


def _within(order: list[str]):
    by = Window.partitionBy(KEY, BLOCK).orderBy(*order)
    return by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)


def _numbered(rows: DataFrame, order: list[str], opened: Column, name: str) -> DataFrame:
    """name: how many rows up to this one have `opened`."""
    marked = rows.withColumn("_opened", opened.cast("int"))
    _, until = _within(order)
    counted = carried(marked, {"_sum": F.sum("_opened")}, {"_sum_before": F.sum("_sum")})
    total = F.sum("_opened").over(until) + F.coalesce("_sum_before", F.lit(0))
    return counted.withColumn(name, total.cast("long")).drop("_opened", "_sum_before")


def reach(rows: DataFrame, order: list[str], end: Column, name: str = "reach") -> DataFrame:
    """rows (blocked) with the greatest `end` of all rows before; null at a key's first."""
    before, _ = _within(order)
    marked = carried(rows.withColumn("_end", end), {"_most": F.max("_end")}, {"_most_before": F.max("_most")})
    return marked.withColumn(name, F.greatest(F.max("_end").over(before), "_most_before")).drop("_end", "_most_before")


def last_known(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows (blocked) with the last value before that isn't null."""
    before, _ = _within(order)
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    marked = carried(rows.withColumn("_value", value), {"_last": F.max_by("_value", known)}, {"_last_before": F.last("_last", ignorenulls=True)})
    return marked.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(before), "_last_before")).drop("_value", "_last_before")


def gap_buckets(events: DataFrame, keys: list[str], gap_ms: int, ts: str = "ts_ms", end: str = "end_ms", blocks: int | None = None) -> DataFrame:
    order = [ts, "ord"]
    rows = reach(blocked(events, keys, order, blocks), order, F.col(end), "_reach")
    opened = F.col("_reach").isNull() | (F.col(ts) > F.col("_reach") + gap_ms)
    return _numbered(rows, order, opened, "bucket").drop("_reach", BLOCK, KEY)


def repo_gap_buckets(events: DataFrame, keys: list[str], gap_ms: int, blocks: int | None = None) -> DataFrame:
    order = ["ts_ms", "ord"]
    rows = reach(blocked(events, keys, order, blocks), order, F.col("end_ms"), "_reach")
    rows = last_known(rows, order, F.col("repository"), "_repository")
    opened = F.col("_reach").isNull() | (F.col("ts_ms") > F.col("_reach") + gap_ms) | F.coalesce(F.col("repository") != F.col("_repository"), F.lit(False))
    return _numbered(rows, order, opened, "bucket").drop("_reach", "_repository", BLOCK, KEY)


def _changes(events: DataFrame, keys: list[str], value: Column, blocks: int | None) -> DataFrame:
    """events (blocked) with value, and _new where it differs from the one before, nulls being a value too."""
    order = ["ts_ms", "ord"]
    rows = blocked(events, keys, order, blocks).withColumn("value", value)
    own = F.struct(F.col("value"))  # never null, so that a null value is told from no row
    rows = carried(rows, {"_last": F.max_by(own, F.struct(*order))}, {"_last_before": F.last("_last", ignorenulls=True)})
    prior = F.coalesce(F.lag(own).over(Window.partitionBy(KEY, BLOCK).orderBy(*order)), "_last_before")
    return rows.withColumn("_prior", prior).withColumn("_new", F.col("_prior").isNull() | ~F.col("value").eqNullSafe(F.col("_prior.value"))).drop("_prior", "_last_before")


def changes_only(events: DataFrame, keys: list[str], value: Column, blocks: int | None = None) -> DataFrame:
    """The events whose value differs from the one before; the first always."""
    return _changes(events, keys, value, blocks).where("_new").drop("_new", "value", BLOCK, KEY)


def run_collapse(events: DataFrame, keys: list[str], value: Column, blocks: int | None = None) -> DataFrame:
    """Consecutive events of one value as one row: keys, run, value, start, end, n. Partial results are aggregated in each block before runs come together."""
    rows = _numbered(_changes(events, keys, value, blocks), ["ts_ms", "ord"], F.col("_new"), "run")
    return rows.groupBy(*keys, "run", "value").agg(F.min("ts_ms").alias("start"), F.max("end_ms").alias("end"), F.count("*").alias("n"))


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: list[str] | None = None, tolerance: int = 0, blocks: int | None = None) -> DataFrame:
    """spans with a column island (from 1, within keys): a span more than `tolerance` beyond all earlier ends opens a new one."""
    by = [start, *(order or [end])]
    rows = reach(blocked(spans, keys, by, blocks), by, F.col(end), "_reach")
    return _numbered(rows, by, F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + tolerance), "island").drop("_reach", BLOCK, KEY)


def merged_spans(spans: DataFrame, keys: list[str], tolerance: int = 0, blocks: int | None = None) -> DataFrame:
    """keys, island, start, end, n: the union of the spans of each key."""
    return islands(spans, keys, tolerance=tolerance, blocks=blocks).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def pause_gate(events: DataFrame, pauses: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Events outside all pauses (keys, from_ms, until_ms; null until_ms: still paused) of their key, by one scan: an event is inside where the greatest end of the pauses begun by then lies behind it.

    No event meets a pause in a join, however many there are of either. A pause that ends before it begins holds nothing."""
    never = (1 << 63) - 1
    mine = events.select(F.struct(*events.columns).alias("_event"), *keys, F.col("ts_ms").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_until"))
    theirs = pauses.select(F.lit(None).cast(mine.schema["_event"].dataType).alias("_event"), *keys, F.col("from_ms").alias("_at"), F.lit(0).alias("_kind"), F.coalesce("until_ms", F.lit(never)).alias("_until"))
    order = ["_at", "_kind"]
    rows = reach(blocked(mine.unionByName(theirs.where("_at is not null")), keys, order, blocks), order, F.col("_until"), "_reach")
    out = rows.where(F.col("_event").isNotNull() & (F.col("_reach").isNull() | (F.col("_at").isNull() | (F.col("_reach") <= F.col("_at")))))
    return out.select("_event.*")
