"""Joins of points or intervals with intervals, as equi-joins on bins of time.

An interval stands in the bins of its own level: bins of the least power of two that isn't shorter than it, of which it touches two at most. A point asks at each level that the
intervals have (some forty for spans of milliseconds to centuries, few in practice) in the one bin that it lies in. So the rows that meet are those within a few lengths of the
interval, and their number grows with the matches, not with the product; each match is met once. The exact condition follows.

Intervals are half open: from_ms <= t < until_ms; an open end (null until_ms) lasts for ever, one that doesn't end after its begin holds nothing. Null times match nothing, null keys
match each other. A key of very many points and intervals is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = 1 << 62


def _level(length: Column) -> Column:
    """The least k with 2 ** k >= length, in whole numbers."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _cut(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Each interval once for every bin it touches: _level, _bin, and _k0.. for its keys."""
    until = F.coalesce("until_ms", F.lit(FOREVER))
    held = intervals.where(F.col("from_ms").isNotNull()).withColumn("_until", until).where(F.col("_until") > F.col("from_ms"))
    held = held.withColumn("_level", F.least(_level(F.col("_until") - F.col("from_ms")), F.lit(62)).cast("int"))
    bins = F.array_distinct(F.array(F.call_function("shiftright", "from_ms", "_level"), F.call_function("shiftright", F.col("_until") - 1, "_level")))
    return held.withColumn("_bin", F.explode(bins)).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def levels(intervals: DataFrame) -> list[int]:
    """Levels that the intervals have: 63 at most."""
    return sorted(r[0] for r in _cut(intervals, []).select("_level").distinct().collect())


def within(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str = "ts_ms") -> DataFrame:
    """Each pair of a point and an interval of its keys that it lies in: the points' columns and the intervals' other ones."""
    cut = _cut(intervals, keys)
    asked = points.withColumn("_asked", F.explode(F.array(*map(F.lit, levels(intervals))).cast("array<int>"))).withColumn("_at", F.call_function("shiftright", F.col(ts).cast("long"), F.col("_asked")))
    on = (F.col("_asked") == F.col("_level")) & (F.col("_at") == F.col("_bin"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = (F.col(ts) >= F.col("from_ms")) & (F.col(ts) < F.col("_until"))
    return asked.join(cut, on & inside).drop("_asked", "_at", "_level", "_bin", "_until", *(f"_k{i}" for i in range(len(keys))))


def overlapping(spans: DataFrame, intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each pair of a span (half open too) and an interval of its keys that have a time in common, once. The names of the intervals' columns are to differ from the spans'.

    Two that overlap either have the interval's begin in the span, or the span's begin in the interval and after the interval's."""
    names = {c: f"_i_{c}" for c in intervals.columns}
    marked = spans.where(F.col(end) > F.col(start))
    first = within(marked, intervals, keys, start)
    begun = intervals.where(F.coalesce("until_ms", F.lit(FOREVER)) > F.col("from_ms")).withColumnsRenamed(names)
    whole = marked.withColumns({"from_ms": F.col(start) + 1, "until_ms": F.col(end)})
    second = within(begun, whole.withColumnsRenamed({k: f"_i_{k}" for k in keys}), [f"_i_{k}" for k in keys], "_i_from_ms").drop("from_ms", "until_ms")
    back = {v: k for k, v in names.items() if k not in keys}
    kept = [c for c in first.columns if c not in keys]
    second = second.withColumnsRenamed({f"_i_{k}": k for k in keys}).withColumnsRenamed(back)
    return first.select(*keys, *kept).unionByName(second.select(*keys, *kept))
