"""Silver events: the one schema all timeline operators take.

session_id, ord (position, tie-break of every order), ts_ms, end_ms, tz, work_day, source, type, app, title, repository, importance, metadata (JSON text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import ts_millis, work_day

#: Importance of an event of the driver's tables by its type.
IMPORTANCE = {"error": 85, "purchase": 90, "signup": 70, "click": 45, "view": 30}
TZ_MINUTES = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a timeline: a user is a session, `value` is a span in minutes, props.k gives the repository."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    importance = F.lit(None).cast("int")
    for kind, n in IMPORTANCE.items():
        importance = F.when(F.col("event_type") == kind, n).otherwise(importance)
    ts = ts_millis(F.col("ts"))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), ts.alias("ts_ms"),
        (ts + F.floor(F.coalesce("value", F.lit(0.0)) * 60_000).cast("bigint")).alias("end_ms"), F.lit(TZ_MINUTES).alias("tz"),
        work_day(ts, F.lit(TZ_MINUTES)).alias("work_day"), F.lit("app").alias("source"), F.col("event_type").alias("type"), F.col("event_type").alias("app"),
        F.concat(F.lit("repo-"), (k % 7).cast("string")).alias("repository"), importance.alias("importance"), F.col("props").alias("metadata"),
    )


#: What the events table is told as in work_history(): the kind of an event by its number.
KINDS = [
    "ide.file.saved", "browser.navigation", "terminal.command", "terminal.error_tail", "git.commit",
    "git.branch.checkout", "git.status.summary", "manual.note", "agent.session", "external.run.finished",
]
PLACES = ["/work/atlas", "/work/borealis", "/work/tmp/x", "/work/atlas/sub"]


def work_history(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """All events as a history of work: types, titles and metadata of the collectors' kind, made from event_id and props.k. Columns of silver_events and app_display.

    by: columns whose equal values are brought together before anything is made, in parts that don't depend on the file's; what is grouped by them needs no further shuffle."""
    e = silver_events(spark, sf_dir)
    e = (e.repartition(*by) if by else e).withColumn("_k", F.coalesce(F.get_json_object("metadata", "$.k").try_cast("int"), F.lit(0)))
    n, k = F.col("ord"), F.col("_k")
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod(n, F.lit(10)).cast("int"))
    place = F.get(F.array(*map(F.lit, PLACES)), k % 4)
    text = lambda prefix, m: F.concat(F.lit(prefix), (k % m).cast("string"))
    of = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    branch = F.when(F.pmod(n, F.lit(3)) == 0, "HEAD").otherwise(text("feature/ab-", 5))
    made = F.struct(
        of(F.concat(place, text("/src/file", 9), F.lit(".py")), KINDS[0]).alias("path"), of(text("https://docs.example.org:8080/p", 11), KINDS[1]).alias("url"),
        of(text("make t", 6), KINDS[2]).alias("commandRedacted"), of(F.concat(place, F.lit("/src")), KINDS[2]).alias("cwd"),
        of(F.when(F.pmod(n, F.lit(20)) == 2, F.pmod(n, F.lit(3))), KINDS[2]).alias("exitCode"), of((k % 4) * 50_000, KINDS[2]).alias("durationMs"),
        of(F.array(text("E", 8), F.lit("at line"), text("", 3)), KINDS[3]).alias("lines"), of(text("msg ", 13), KINDS[4]).alias("messageRedacted"), of(F.lpad(n.cast("string"), 9, "0"), KINDS[4]).alias("sha"),
        of(branch, KINDS[4], KINDS[6]).alias("branch"), of(place, KINDS[4], KINDS[5], KINDS[6]).alias("worktree"), of(branch, KINDS[5]).alias("to"), of(k % 4, KINDS[6]).alias("dirtyFiles"),
        of(text("note ", 17), KINDS[7]).alias("text"), of(place, KINDS[8]).alias("projectPath"), of(branch, KINDS[8]).alias("gitBranch"), of(k % 5, KINDS[8]).alias("toolCallCount"),
        of(F.array(F.concat(text("src/a", 7), F.lit(".py")), F.concat(text("/abs/b", 5), F.lit(".py")), F.lit("/tmp/z.py")), KINDS[8]).alias("filesTouched"),
        of(text("r", 4), KINDS[9]).alias("runId"), of(F.when(k % 2 == 0, "succeeded").otherwise("failed"), KINDS[9]).alias("status"),
    )
    title = F.when(kind == KINDS[1], text("Guide ", 3)).when(kind == KINDS[8], F.when(k % 3 == 0, "Codex — atlas").otherwise(text("Fix crash ", 6)))
    return e.withColumns({"type": kind, "title": title, "app": F.concat(F.lit("app"), F.pmod(n, F.lit(10)).cast("string")), "app_display": F.concat(F.lit("App "), F.pmod(n, F.lit(10)).cast("string")), "metadata": F.to_json(made)}).drop("_k")
