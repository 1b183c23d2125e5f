"""Rhythm, interruptions, suggestions and drift over a contexts frame.

Contexts: session_id, work_day, key, start, end, active_ms, ord (order of creation), fallback (the key is only an application's name); tz in minutes.
Groups are sessions' days, or sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import HOUR_MS, hour_of

DAY = ["session_id", "work_day"]
#: Fixed values.
DEEP_MS, LEAST_OBSERVATIONS, LEAST_TRANSITIONS, LEAST_SHARE = 25 * 60_000, 3, 4, 0.15
DRIFT_LEAST_MS, DRIFT_USUAL_MS = 5 * 60_000, 15 * 60_000


def _median(x: Column) -> Column:
    return F.round(F.percentile(x, 0.5)).cast("bigint")


def _by_start() -> Window:
    return Window.partitionBy(*DAY).orderBy("start", "ord")


def day_rhythm(contexts: DataFrame) -> DataFrame:
    """One row a session's day: active_ms, n_contexts, median_ms, deep_n, deep_ms, switches, first_hour, last_hour, named_share."""
    deep, at = F.col("active_ms") >= DEEP_MS, F.struct("start", "ord")
    return contexts.groupBy(*DAY).agg(
        F.sum("active_ms").alias("active_ms"), F.count("*").alias("n_contexts"), _median(F.col("active_ms")).alias("median_ms"),
        F.count_if(deep).alias("deep_n"), F.coalesce(F.sum(F.when(deep, F.col("active_ms"))), F.lit(0)).alias("deep_ms"), (F.count("*") - 1).alias("switches"),
        F.min_by(hour_of(F.col("start"), F.col("tz")), at).alias("first_hour"), F.max_by(hour_of(F.col("end"), F.col("tz")), at).alias("last_hour"),
        F.when(F.sum("active_ms") > 0, F.coalesce(F.sum(F.when(~F.col("fallback"), F.col("active_ms"))), F.lit(0)) / F.sum("active_ms")).otherwise(0.0).alias("named_share"),
    )


def busiest_switch_hour(contexts: DataFrame) -> DataFrame:
    """session_id, work_day, hour, n: the hour in which most contexts but the first begin; ties to the hour seen first."""
    later = contexts.withColumn("nth", F.row_number().over(_by_start())).where("nth > 1").withColumn("hour", hour_of(F.col("start"), F.col("tz")))
    counted = later.groupBy(*DAY, "hour").agg(F.count("*").alias("n"), F.min("nth").alias("seen"))
    return counted.groupBy(*DAY).agg(F.max_by(F.struct("hour", "n"), F.struct(F.col("n"), -F.col("seen"))).alias("b")).select(*DAY, "b.hour", "b.n")


def typical_day(days: DataFrame) -> DataFrame:
    """session_id, n_days and the medians of its days (from day_rhythm)."""
    medians = [_median(F.col(c)).alias(f"typical_{c}") for c in ("active_ms", "n_contexts", "deep_ms", "switches", "first_hour", "last_hour")]
    return days.groupBy("session_id").agg(F.count("*").alias("n_days"), *medians)


def active_by_hour(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hour, active_ms: a context's span is cut each full hour from its own start; a slice's share of the activity goes to the hour it starts in."""
    spans = contexts.where(F.col("end") > F.col("start")).withColumn("at", F.explode(F.sequence("start", F.col("end") - 1, F.lit(HOUR_MS).cast("bigint"))))
    share = F.least(F.lit(HOUR_MS), F.col("end") - F.col("at")) * (F.col("active_ms") / (F.col("end") - F.col("start")))
    return spans.groupBy(*keys, hour_of(F.col("at"), F.col("tz")).alias("hour")).agg(F.round(F.sum(share)).cast("bigint").alias("active_ms"))


def interruptions(contexts: DataFrame) -> DataFrame:
    """Returns to a key within a day: session_id, work_day, key, left_at, returned_at, away_ms, resumed_ms."""
    by = Window.partitionBy(*DAY, "key").orderBy("start", "ord")
    seen = contexts.withColumn("left_at", F.lag("end").over(by)).where(F.col("start") > F.col("left_at"))
    return seen.select(*DAY, "key", "left_at", F.col("start").alias("returned_at"), (F.col("start") - F.col("left_at")).alias("away_ms"), F.col("active_ms").alias("resumed_ms"))


def return_rate(contexts: DataFrame) -> DataFrame:
    """session_id, left_n, returned_n, rate: keys that weren't a day's last one, and keys seen twice in a day; distinct over days."""
    last = F.row_number().over(Window.partitionBy(*DAY).orderBy(F.desc("start"), F.desc("ord"))) == 1
    marked = contexts.withColumn("last", last).withColumn("times", F.count("*").over(Window.partitionBy(*DAY, "key")))
    sums = marked.groupBy("session_id").agg(F.countDistinct(F.when(~F.col("last"), F.col("key"))).alias("left_n"), F.countDistinct(F.when((F.col("times") > 1) & ~F.col("last"), F.col("key"))).alias("returned_n"))
    return sums.withColumn("rate", F.when(F.col("left_n") > 0, F.col("returned_n") / F.col("left_n")).otherwise(0.0))


def return_medians(observed: DataFrame) -> DataFrame:
    """session_id, key, n, median_away_ms: of keys with three interruptions at least."""
    return observed.groupBy("session_id", "key").agg(F.count("*").alias("n"), _median(F.col("away_ms")).alias("median_away_ms")).where(F.col("n") >= LEAST_OBSERVATIONS)


def transitions(contexts: DataFrame) -> DataFrame:
    """session_id, key, next_key, n: from context to context within a day, to others only."""
    pairs = contexts.withColumn("next_key", F.lead("key").over(_by_start())).where(F.col("next_key") != F.col("key"))
    return pairs.groupBy("session_id", "key", "next_key").agg(F.count("*").alias("n"))


def hour_histogram(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("session_id", "key", hour_of(F.col("start"), F.col("tz")).alias("hour")).agg(F.count("*").alias("n"))


def suggest_next(contexts: DataFrame, current: DataFrame, at_hour: int, limit: int = 3) -> DataFrame:
    """current: session_id, from_key (null: unknown). session_id, rank, key, score, transition_n, hour_n.

    score = max(share of transitions from from_key, .15) * max(share of the key's starts within an hour of at_hour, .15); candidates without either
    evidence, and sessions of fewer than four transitions, have none."""
    moves = transitions(contexts)
    total = moves.groupBy("session_id").agg(F.sum("n").alias("all_n")).where(F.col("all_n") >= LEAST_TRANSITIONS)
    from_n = moves.groupBy("session_id", F.col("key").alias("from_key")).agg(F.sum("n").alias("from_n"))
    out = moves.select("session_id", F.col("key").alias("from_key"), F.col("next_key").alias("key"), F.col("n").alias("transition_n"))
    near = F.col("hour").isin([(at_hour + d) % 24 for d in (-1, 0, 1)])
    hours = hour_histogram(contexts).groupBy("session_id", "key").agg(F.sum("n").alias("starts"), F.coalesce(F.sum(F.when(near, F.col("n"))), F.lit(0)).alias("hour_n"))
    last = contexts.groupBy("session_id", "key").agg(F.max("end").alias("last_active"))
    frame = hours.join(last, ["session_id", "key"]).join(total.select("session_id"), "session_id").join(current, "session_id")
    frame = frame.join(out, ["session_id", "from_key", "key"], "left").join(from_n, ["session_id", "from_key"], "left").where(~F.col("key").eqNullSafe(F.col("from_key")))
    frame = frame.withColumn("transition_n", F.coalesce("transition_n", F.lit(0))).where((F.col("transition_n") > 0) | (F.col("hour_n") > 0))
    share = F.coalesce(F.col("transition_n") / F.col("from_n"), F.lit(0.0))
    frame = frame.withColumn("score", F.greatest(share, F.lit(LEAST_SHARE)) * F.greatest(F.col("hour_n") / F.col("starts"), F.lit(LEAST_SHARE)))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), F.desc("last_active"), "key"))
    return frame.withColumn("rank", rank).where(F.col("rank") <= limit).select("session_id", "rank", "key", "score", "transition_n", "hour_n")


def detect_drift(contexts: DataFrame, now_ms: int, usual_return: DataFrame | None = None) -> DataFrame:
    """Sessions whose current context (latest end) isn't the established one (most activity among the rest) and has lasted long enough.

    usual_return: session_id, usual_ms (median return); else 15 minutes; 5 minutes at least. session_id, current, established, away_ms."""
    latest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("end"), "ord")) == 1
    marked = contexts.withColumn("latest", latest)
    value = lambda c: F.struct(F.col("key"), F.col("active_ms"), F.col("end")).alias("v")  # noqa: E731, ARG005
    now = marked.where("latest").select("session_id", F.col("key").alias("current"), F.col("active_ms").alias("current_ms"))
    rest = marked.where("not latest").groupBy("session_id").agg(F.max_by(value(0), F.struct(F.col("active_ms"), -F.col("ord"))).alias("b"))
    both = now.join(rest, "session_id").where(F.col("b.active_ms") > F.col("current_ms")).withColumn("away_ms", F.lit(now_ms) - F.col("b.end"))
    usual = F.lit(DRIFT_USUAL_MS)
    if usual_return is not None:
        both, usual = both.join(usual_return, "session_id", "left"), F.coalesce(F.col("usual_ms"), F.lit(DRIFT_USUAL_MS))
    return both.where(F.col("away_ms") >= F.greatest(F.lit(DRIFT_LEAST_MS), usual)).select("session_id", "current", F.col("b.key").alias("established"), "away_ms")


def lunch_hour(events: DataFrame) -> DataFrame:
    """session_id, hour: upper median over days of the hour of the longest gap that begins in [11, 15) and lasts 20 minutes; 12 for fewer than three such days."""
    gap = F.lead("ts_ms").over(Window.partitionBy(*DAY).orderBy("ts_ms", "ord")) - F.col("ts_ms")
    gaps = events.withColumn("gap", gap).withColumn("hour", hour_of(F.col("ts_ms"), F.col("tz")))
    found = gaps.where(F.col("hour").between(11, 14) & (F.col("gap") >= 20 * 60_000)).groupBy(*DAY).agg(F.max_by("hour", F.struct(F.col("gap"), -F.col("ts_ms"))).alias("hour"))
    hours = found.groupBy("session_id").agg(F.array_sort(F.collect_list("hour")).alias("h"))
    picked = hours.select("session_id", F.when(F.size("h") >= 3, F.get("h", F.floor(F.size("h") / 2).cast("int"))).otherwise(12).alias("hour"))
    return events.select("session_id").distinct().join(picked, "session_id", "left").select("session_id", F.coalesce("hour", F.lit(12)).alias("hour"))


def predicted(contexts: DataFrame, now_ms: int, at_hour: int, usual_return: DataFrame | None = None, limit: int = 3) -> dict[str, DataFrame]:
    """What the history of contexts says for now, each part as a frame: rhythm, interruptions, suggestions by the hour alone (nothing is known of what went before) and drift."""
    current = contexts.select("session_id").distinct().withColumn("from_key", F.lit(None).cast("string"))
    return {"rhythm": day_rhythm(contexts), "interruptions": interruptions(contexts), "suggestions": suggest_next(contexts, current, at_hour, limit), "drift": detect_drift(contexts, now_ms, usual_return)}
