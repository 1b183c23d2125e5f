"""Resume card of a context: what was worked on, read, run and produced, what failed, what to do next, what to open.

Events here carry session_id, work_day, context, ord, ts_ms, type, title, metadata, importance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import absolute
from ..functions.meta import number, text, typed
from ..functions.meta import shown as shown_number
from ..functions.text import leaf

KEYS = ["session_id", "work_day", "context"]
#: Fixed values.
CAPS = {"working": 5, "reading": 5, "ran": 3, "produced": 4, "failure": 1}
RESOURCE_ORDER = ["workspace", "folder", "terminal", "file", "url"]
RESOURCES, AGENT_FILES = 10, 8
#: Fixed value: paths of temporary folders.
THROWAWAY = r"(?i)[/\\](?:temp|tmp)[/\\]|^/var/folders/"


def _list(name: str) -> Column:
    return F.from_json(F.get_json_object("metadata", f"$.{name}"), "array<string>")


AGENT_TYPES = ["external.run.finished", "external.mission.started", "agent.session.started", "agent.session", "agent.activity"]


def _app_display(events: DataFrame) -> Column:
    return F.col("app_display") if "app_display" in events.columns else F.lit(None).cast("string")


def lines(events: DataFrame) -> DataFrame:
    """KEYS, ord, ts_ms, bucket, label, detail, tone: events as lines. A file name or address worked on or read stands once, at its first event; all others each time."""
    events = typed(events)
    kind, exit_code = F.col("type"), number("exitCode")
    path, tail = F.coalesce(text("path"), text("toPath")), _list("lines")
    own, none = F.col("ord").cast("string"), F.lit(None).cast("string")
    shown = F.coalesce(_app_display(events), F.lit("Agent"))

    def line(bucket: str, label: Column, detail: Column, key: Column = own, tone: Column = none) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), label.alias("label"), detail.cast("string").alias("detail"), key.alias("key"), tone.alias("tone"))

    agent = (
        F.when(kind == "external.mission.started", F.concat(F.lit("Mission: "), F.coalesce(text("mission"), F.lit(""))))
        .when(kind == "external.run.finished", F.concat(F.lit("Run "), F.coalesce(text("runId"), F.lit("")), F.lit(" — "), F.coalesce(text("status"), F.lit(""))))
        .when(kind == "agent.session.started", F.lit("Session started"))
        .when(kind == "agent.session", F.coalesce(text("title"), F.col("title"), shown))
        .otherwise(F.concat(shown, F.lit(" — "), F.coalesce(shown_number(number("toolCallCount")), F.lit("0")), F.lit(" tool calls")))
    )
    passed = F.coalesce(exit_code == 0, F.lit(False))
    made = (
        F.when(kind.isin("ide.file.opened", "ide.file.saved", "fs.file.created", "fs.file.renamed") & path.isNotNull(), line("working", leaf(path), path, leaf(path)))
        .when((kind == "browser.navigation") & text("url").isNotNull(), line("reading", F.coalesce(F.col("title"), text("host"), text("url")), text("url"), text("url")))
        .when((kind == "terminal.command") & text("commandRedacted").isNotNull(), line("ran", text("commandRedacted"), F.concat(F.lit("exit "), F.coalesce(shown_number(exit_code), F.lit("?"))), tone=F.when(passed, "success").otherwise("failure")))
        .when((kind == "terminal.error_tail") & (F.size(tail) > 0), line("failure", F.get(tail, 0), F.array_join(F.slice(tail, 2, 1 << 20), "\n"), tone=F.lit("failure")))
        .when(kind == "git.commit", line("produced", F.coalesce(text("messageRedacted"), F.lit("commit")), F.left(text("sha"), F.lit(7)), tone=F.lit("success")))
        .when(kind == "manual.note", line("note", F.coalesce(text("text"), F.lit("")), none))
        .when(kind.isin(AGENT_TYPES), line("produced", agent, F.array_join(_list("filesTouched"), ", ")))
    )
    # exploded, as a filter on the line would be pushed down to the source and work out the metadata again at each mention
    long = events.select(*KEYS, "ord", "ts_ms", F.explode(F.array_compact(F.array(made))).alias("l")).select(*KEYS, "ord", "ts_ms", "l.*")
    first = F.row_number().over(Window.partitionBy(*KEYS, "bucket", "key").orderBy("ts_ms", "ord")) == 1
    return long.withColumn("_f", first).where("_f").drop("_f", "key")


def capped(card: DataFrame) -> DataFrame:
    """Of each bucket the latest lines; notes all."""
    nth = F.row_number().over(Window.partitionBy(*KEYS, "bucket").orderBy(F.desc("ts_ms"), F.desc("ord")))
    cap = F.lit(1 << 30)
    for bucket, n in CAPS.items():
        cap = F.when(F.col("bucket") == bucket, n).otherwise(cap)
    return card.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")


def next_step(events: DataFrame) -> DataFrame:
    """KEYS, rule, text: last note, else last failing command, else latest status with uncommitted files, else last agent event."""
    events = typed(events)
    at = F.struct("ts_ms", "ord")
    kind = F.col("type")
    last = lambda when, what, name: F.max_by(F.when(when, what), F.when(when, at)).alias(name)
    found = events.groupBy(*KEYS).agg(
        last((kind == "manual.note") & text("text").isNotNull(), text("text"), "note"),
        last((kind == "terminal.command") & ~F.coalesce(number("exitCode") == 0, F.lit(False)), text("commandRedacted"), "failing"),
        last((kind == "git.status.summary") & (number("dirtyFiles") > 0), shown_number(number("dirtyFiles")), "dirty"),
        last(kind.startswith("agent."), F.coalesce(text("outcome"), text("agent")), "agent"),
    )
    rules = [("note", "note"), ("failing", "failing"), ("dirty", "dirty"), ("agent", "agent")]
    rule, value = F.lit(None).cast("string"), F.coalesce(*[F.col(c) for _, c in rules])
    for name, c in reversed(rules):
        rule = F.when(F.col(c).isNotNull(), name).otherwise(rule)
    return found.select(*KEYS, rule.alias("rule"), value.alias("text")).where(F.col("rule").isNotNull())


def resources(events: DataFrame) -> DataFrame:
    """KEYS, nth, kind, target: what to open, workspaces first, RESOURCES at most; no temporary paths, each target once, where it came up first."""
    events = typed(events)
    kind, path = F.col("type"), F.coalesce(text("path"), text("toPath"))
    project = F.coalesce(text("projectPath"), text("worktree"), text("cwd"))
    one = lambda when, name, target: F.when(when, F.struct(F.lit(name).alias("kind"), target.alias("target")))
    touched = F.slice(_list("filesTouched"), 1, AGENT_FILES)
    touched = F.transform(touched, lambda f: F.when(F.trim(f) != "", F.struct(F.lit("file").alias("kind"), absolute(f, project).alias("target"))))
    some = F.array(
        one(kind.isin("ide.file.opened", "ide.file.saved", "fs.file.created", "fs.file.renamed"), "file", path), one(kind == "browser.navigation", "url", text("url")),
        one(kind.isin("git.commit", "git.status.summary"), "folder", text("worktree")), one(kind.isin("git.branch.checkout", "git.repo.detected"), "folder", F.coalesce(text("worktree"), text("path"))),
        one(kind == "ide.workspace.opened", "workspace", text("workspacePath")), one(kind.isin(AGENT_TYPES), "workspace", project),
    )
    every = F.array_compact(F.concat(some, F.when(kind.isin(AGENT_TYPES) & touched.isNotNull(), touched).otherwise(F.array().cast("array<struct<kind:string,target:string>>"))))
    long = events.select(*KEYS, "ord", "ts_ms", F.posexplode(every).alias("rank", "r")).select(*KEYS, F.lit(0).alias("last"), "ts_ms", "ord", "rank", "r.*")
    stood = events.select(*KEYS, "ord", "ts_ms", F.explode(F.array_compact(F.array(text("cwd")))).alias("target"))
    cwd = stood.groupBy(*KEYS).agg(F.max_by("target", F.struct("ts_ms", "ord")).alias("target"))
    long = long.unionByName(cwd.select(*KEYS, F.lit(1).alias("last"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("rank"), F.lit("terminal").alias("kind"), "target"))
    long = long.withColumn("target", F.trim("target")).where((F.col("target") != "") & ~F.rlike("target", F.lit(THROWAWAY)))
    at = ["last", "ts_ms", "ord", "rank"]
    once = long.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS, "target").orderBy(*at))).where("_n = 1")
    place = F.array_position(F.array(*map(F.lit, RESOURCE_ORDER)), F.col("kind"))
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy(place, *at))
    return once.withColumn("nth", nth).where(F.col("nth") <= RESOURCES).select(*KEYS, "nth", "kind", "target")
