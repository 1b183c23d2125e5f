"""Text exports: standup lines, work logs, hand-over briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import next_step_sentence
from ..functions.time import clock, format_duration

DAY = ["session_id", "work_day"]


def standup(contexts: DataFrame) -> DataFrame:
    """session_id, work_day, line: contexts with activity in order of their start, each with its duration."""
    text = F.concat(F.col("key"), F.lit(" ("), format_duration(F.col("active_ms")), F.lit(")"))
    rows = contexts.where("active_ms > 0").groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("start", "ord", text.alias("text")))).alias("all"))
    return rows.select(*DAY, F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("line"))


def standup_detailed(contexts: DataFrame, card: DataFrame) -> DataFrame:
    """session_id, work_day, text: contexts with activity, one line each: name, place (project, repository, branch), duration, the first two things produced, and whether something failed.

    card: lines of resume.capped(resume.lines()) of the same contexts."""
    keys = [*DAY, "context"]
    produced = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("bucket") == "produced", F.struct("ts_ms", "ord", "label")))), 1, 2), lambda x: x["label"])
    done = card.groupBy(*keys).agg(produced.alias("produced"), F.coalesce(F.bool_or(F.col("bucket") == "failure"), F.lit(False)).alias("failed"))
    rows = contexts.where("active_ms > 0").join(done, keys, "left")
    some = lambda *parts: F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))
    where = some(F.col("project"), F.col("repository"), F.col("branch"))
    tail = F.array_join(F.filter(F.concat(F.coalesce("produced", F.array().cast("array<string>")), F.when(F.col("failed"), F.array(F.lit("blocked"))).otherwise(F.array().cast("array<string>"))), lambda x: x != ""), " · ")
    line = F.concat(
        F.lit("- "), F.col("label"), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""), F.lit(" — "), format_duration(F.col("active_ms")), F.when(tail != "", F.concat(F.lit(" — "), tail)).otherwise("")
    )
    listed = rows.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("start", "ord", line.alias("text")))).alias("all"))
    return listed.select(*DAY, F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))


def worklog(contexts: DataFrame) -> DataFrame:
    """session_id, work_day, text: one line a context with clock times."""
    text = F.concat(clock(F.col("start"), F.col("tz")), F.lit("-"), clock(F.col("end"), F.col("tz")), F.lit("  "), F.col("key"), F.lit("  "), format_duration(F.col("active_ms")))
    rows = contexts.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("start", "ord", text.alias("text")))).alias("all"))
    return rows.select(*DAY, F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))


def brief(card: DataFrame, step: DataFrame) -> DataFrame:
    """A context's hand-over as text: from resume.capped(resume.lines()) and resume.next_step()."""
    keys = [*DAY, "context"]
    lines = card.groupBy(*keys, "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "ord", "label"))), lambda x: x["label"]), "; ").alias("l"))
    joined = lines.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit(": "), "l"))), "\n").alias("text"))
    step = step.withColumnRenamed("text", "next_text")
    follow = F.when(F.col("rule").isNotNull(), F.concat(F.lit("\nnext ("), "rule", F.lit("): "), F.coalesce("next_text", F.lit("")))).otherwise("")
    return joined.join(step, keys, "left").select(*keys, F.concat("text", follow).alias("text"))


#: Sections of a hand-over in their order: bucket of a card's lines and title.
SECTIONS = {"working": "Files", "reading": "Reading", "ran": "Ran", "failure": "Failed", "produced": "Produced"}


def agent_brief(contexts: DataFrame, card: DataFrame, step: DataFrame, resources: DataFrame) -> DataFrame:
    """session_id, work_day, context, text: all that whoever goes on needs to know, as plain text.

    contexts: label, project, repository, branch, end, active_ms, tz, apps (names in order); card: lines of resume.capped(); step: resume.next_step(); resources: resume.resources()."""
    keys = [*DAY, "context"]
    detail = F.when((F.col("bucket") == "ran") & (F.coalesce("detail", F.lit("")) != ""), F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise("")
    listed = card.groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "ord", F.concat(F.lit("- "), "label", detail).alias("line")))).alias("all"))
    shown = listed.select(*keys, "bucket", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("lines"))
    held = shown.groupBy(*keys).agg(*(F.max(F.when(F.col("bucket") == b, F.concat(F.lit(f"{title} :\n"), "lines"))).alias(f"_{b}") for b, title in SECTIONS.items()))
    places = resources.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), "kind", F.lit(" "), "target").alias("line")))).alias("all"))
    places = places.select(*keys, F.concat(F.lit("Open again :\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("_open"))
    rows = contexts.join(held, keys, "left").join(places, keys, "left").join(step.withColumnRenamed("text", "_step"), keys, "left")
    where = F.concat_ws(" · ", *(F.nullif(F.col(c), F.lit("")) for c in ("project", "repository", "branch")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Context : "), "label"), F.when(where != "", F.concat(F.lit("Place : "), where)),
        F.concat(F.lit("Last activity : "), clock(F.col("end"), F.col("tz")), F.lit(" · "), format_duration(F.col("active_ms")), F.lit(" active")), F.when(F.size("apps") > 0, F.concat(F.lit("Apps : "), F.array_join("apps", " → "))),
    )
    follow = F.when(F.col("rule").isNotNull(), F.concat(F.lit("Next : "), next_step_sentence(F.col("rule"), F.col("_step"))))
    return rows.select(*keys, F.concat_ws("\n\n", head, *(F.col(f"_{b}") for b in SECTIONS), follow, F.col("_open")).alias("text"))
