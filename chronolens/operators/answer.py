"""Answers from ranked facts: what counts as a result, why a question is refused, and which contexts the answer comes from.

Ranked rows are those of corpus.rank(): key, kind, context, first_ms, last_ms, lexical, context_score, score. Without terms a
question asks about a time: everything in its window is a result. Ties in score and time go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import THRESHOLD

#: Fixed values.
HIGHLIGHTS, RESULTS, CLOSEST, SOURCES, QUIET_EVENTS = 6, 24, 3, 2, 40
BEST_FIRST = [F.desc, F.desc, F.asc]


def _order() -> list[Column]:
    return [f(c) for f, c in zip(BEST_FIRST, ("score", "last_ms", "key"))]


def _is_relevant() -> Column:
    return (F.col("lexical") > 0) | (F.col("context_score") > 0)


def overlaps(window: tuple[int, int], start: str = "start", end: str = "end") -> Column:
    return (F.col(start) < window[1]) & (F.col(end) >= window[0])


def relevant(ranked: DataFrame, terms: list[str]) -> DataFrame:
    """Rows that match a term themselves or lie in a context that does; all rows where there are no terms."""
    return ranked.where(_is_relevant()) if terms else ranked


def results(ranked: DataFrame, terms: list[str], n: int = RESULTS) -> DataFrame:
    return relevant(ranked, terms).orderBy(*_order()).limit(n)


def verdict(ranked: DataFrame, terms: list[str], causal: bool = False, contexts: DataFrame | None = None) -> DataFrame:
    """One row: rows, relevant, sources (rows that match a term), best (highest relevant score), refusal (null: there is an answer).

    contexts: those in the question's window, for questions without terms."""
    found = ranked.agg(
        F.count("*").alias("rows"), F.count_if(_is_relevant()).alias("relevant"),
        F.countDistinct(F.when(F.col("lexical") > 0, F.col("key"))).alias("sources"), F.max(F.when(_is_relevant(), F.col("score"))).alias("best"),
    )
    if not terms:
        held = contexts.agg(F.count("*").alias("_contexts")) if contexts is not None else ranked.sparkSession.createDataFrame([(0,)], "_contexts long")
        empty = (F.col("rows") == 0) & (F.col("_contexts") == 0)
        return found.crossJoin(held).withColumn("refusal", F.when(empty, "empty_window")).drop("_contexts")  # one row by one row
    refusal = F.when(F.col("relevant") == 0, "no_match").when(F.col("best") < THRESHOLD, "below_threshold")
    if causal:
        refusal = refusal.when(F.col("sources") < SOURCES, "insufficient_evidence")
    return found.withColumn("refusal", refusal)


def closest(ranked: DataFrame, n: int = CLOSEST) -> DataFrame:
    """What a refusal shows: the best relevant rows; where there are none, the best of all."""
    nearest = ranked.withColumn("_relevant", _is_relevant()).orderBy(F.desc("_relevant"), *_order()).limit(n)
    first = nearest.agg(F.max("_relevant").alias("_any"))
    return nearest.join(F.broadcast(first), F.col("_relevant") == F.col("_any")).drop("_relevant", "_any")  # n rows by one


def rollup(contexts: DataFrame, ranked: DataFrame, keys: list[str], window: tuple[int, int] | None = None, hard: bool = False) -> DataFrame:
    """contexts (keys, start, end, ...) with score (of their best row, else 0) and highlights (keys of their best rows, six at most).

    Titles of windows are a highlight only where they are the best row. A hard window keeps only contexts that overlap it."""
    if window and hard:
        contexts = contexts.where(overlaps(window))
    # the best of a context and the best that are no windows are enough, so that each part of the rows hands on a few a context
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))
    narrow = ranked.select(*keys, "kind", "score", "last_ms", "key")
    first = narrow.withColumn("_nth", nth).where(F.col("_nth") <= 1).where(F.coalesce(F.col("kind") == "window", F.lit(True)))
    others = narrow.where(F.col("kind") != "window").withColumn("_nth", nth).where(F.col("_nth") <= HIGHLIGHTS)
    kept = first.unionByName(others).withColumn("_k", nth).where(F.col("_k") <= HIGHLIGHTS)
    shown = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "key"))), lambda x: x["key"]).alias("highlights"))
    best = ranked.groupBy(*keys).agg(F.max("score").alias("score"))
    out = contexts.join(best, keys, "left").join(shown, keys, "left")
    none = F.array().cast(dict(shown.dtypes)["highlights"])
    return out.withColumns({"score": F.coalesce("score", F.lit(0.0)), "highlights": F.coalesce("highlights", none)})


def morning_brief(contexts: DataFrame, events: DataFrame, today: str, quiet: int = QUIET_EVENTS) -> DataFrame:
    """The context each session ended its latest earlier work day with; nothing for sessions with more than `quiet` events today."""
    day = F.lit(today).cast("date")
    busy = events.where(F.col("work_day") == day).groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > quiet)
    earlier = contexts.where(F.col("work_day") < day).join(busy.select("session_id"), "session_id", "left_anti")
    last = earlier.groupBy("session_id").agg(F.max("work_day").alias("work_day"))
    ended = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("end"), F.desc("start"), F.desc("ord")))
    rows = earlier.join(last, ["session_id", "work_day"], "left_semi").where(F.col("active_ms") > 0)
    return rows.withColumn("_n", ended).where(F.col("_n") == 1).drop("_n")


def loose_events(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """Events of activities that are in no context, with nth: the newest of a day first."""
    keys = ["session_id", "work_day", "ord"]
    outside = assigned.where(F.col("context").isNull() & F.col("activity").isNotNull()).select(*keys)
    nth = F.row_number().over(Window.partitionBy("session_id", "work_day").orderBy(F.desc("ts_ms"), F.desc("ord")))
    return events.join(outside, keys, "left_semi").withColumn("nth", nth)


def latest_for_project(contexts: DataFrame, resources: DataFrame, path: str) -> DataFrame:
    """Of each session the latest context of a project: its repository is the path's last part, or one of its resources (session_id, work_day, context, target) lies in the path."""
    from .projects import same_place

    keys = ["session_id", "work_day", "context"]
    leaf = [p for p in path.replace("\\", "/").split("/") if p][-1:] or [""]
    inside = resources.where(same_place(F.col("target"), F.lit(path))).select(*keys).distinct().withColumn("_inside", F.lit(True))
    mine = contexts.join(inside, keys, "left").where(F.col("_inside") | (F.lower("repository") == leaf[0].lower())).drop("_inside")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("end"), F.desc("start"), F.desc("context")))
    return mine.withColumn("_n", nth).where(F.col("_n") == 1).drop("_n")
