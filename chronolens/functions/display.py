"""Display of events: headlines, outcomes, what can be opened, matched terms, sentences for the next step.

Events carry type, title, app, app_display (may be absent) and metadata (JSON text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .meta import number
from .text import leaf

TARGET_FILES = 12


def meta(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def absolute(file: Column, base: Column) -> Column:
    """A file as reported inside base, with the separator that base uses; rooted ones stay."""
    separator = F.when(F.contains(base, F.lit("\\")) & ~F.contains(base, F.lit("/")), "\\").otherwise("/")
    rooted = base.isNull() | (base == "") | F.startswith(file, F.lit("/")) | F.rlike(file, F.lit("^[A-Za-z]:"))
    return F.when(rooted, file).otherwise(F.concat(F.regexp_replace(base, r"[/\\]+$", ""), separator, file))


def headline(app_display: Column) -> Column:
    """One line for an event by its type; by title or application where the type has no text of its own."""
    shown = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(app_display, F.lit("")), F.nullif(F.col("app"), F.lit("")), F.col("type"))
    text = {
        "terminal.command": F.coalesce(meta("commandRedacted"), F.lit("command")),
        "terminal.error_tail": F.coalesce(meta("lines[0]"), F.lit("error")),
        "git.commit": F.coalesce(meta("messageRedacted"), F.lit("commit")),
        "git.branch.checkout": F.concat(F.lit("checkout "), or_empty(meta("to"))),
        "git.status.summary": F.concat(F.coalesce(meta("dirtyFiles"), F.lit("0")), F.lit(" uncommitted file(s) · "), or_empty(meta("branch"))),
        "git.repo.detected": F.concat(F.lit("repository found · "), or_empty(leaf(meta("path")))),
        "git.stash": F.concat(F.lit("stash · "), or_empty(meta("target"))),
        "manual.note": or_empty(meta("text")),
        "ide.file.saved": or_empty(leaf(meta("path"))),
        "ide.file.opened": or_empty(leaf(meta("path"))),
        "ide.workspace.opened": or_empty(leaf(meta("workspacePath"))),
        "ide.diagnostic.error": F.coalesce(meta("messageRedacted"), F.lit("error")),
        "fs.batch": F.concat(F.coalesce(meta("count"), F.lit("0")), F.lit(" changed files")),
        "fs.file.created": or_empty(leaf(meta("path"))),
        "fs.file.modified": or_empty(leaf(meta("path"))),
        "fs.file.renamed": F.concat(or_empty(leaf(meta("fromPath"))), F.lit(" → "), or_empty(leaf(meta("toPath")))),
        "agent.session": F.coalesce(F.nullif(F.coalesce(meta("title"), F.col("title")), F.lit("")), F.concat(F.lit("session "), F.coalesce(app_display, F.lit("agent")))),
        "agent.activity": F.concat(F.coalesce(app_display, F.lit("Agent")), F.lit(" — "), F.coalesce(meta("toolCallCount"), F.lit("0")), F.lit(" tool calls")),
        "external.mission.started": F.concat(F.lit("mission: "), or_empty(meta("mission"))),
        "external.run.finished": F.concat(F.lit("run "), or_empty(meta("runId")), F.lit(" — "), or_empty(meta("status"))),
        "external.agent.started": F.concat(F.lit("agent "), or_empty(meta("agent")), F.lit(" started")),
    }
    text["agent.session.started"] = text["agent.session"]
    out = shown
    for kind, c in text.items():
        out = F.when(F.col("type") == kind, c).otherwise(out)
    return out


def is_win() -> Column:
    """A commit, a command that passed, a run that succeeded."""
    kind = F.col("type")
    passed = (kind == "terminal.command") & (number("exitCode", F.col("metadata")) == 0) | (kind == "external.run.finished") & (meta("status") == "succeeded")
    return (kind == "git.commit") | F.coalesce(passed, F.lit(False))


def targets() -> Column:
    """array of struct(kind, target): what an event points at, the files it touched (TARGET_FILES at most) last, made absolute."""
    one = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    files = F.slice(F.from_json(meta("filesTouched"), "array<string>"), 1, TARGET_FILES)
    base = F.array(
        one("url", meta("url")), one("file", F.coalesce(meta("path"), meta("toPath"))),
        one("folder", F.coalesce(*map(meta, ("directory", "cwd", "projectPath", "workspacePath")))), one("folder", meta("worktree")),
    )
    base = F.filter(base, lambda t: F.coalesce(F.trim(t["target"]) != "", F.lit(False)))
    touched = F.transform(F.filter(files, lambda f: f.isNotNull()), lambda f: F.struct(F.lit("file").alias("kind"), absolute(f, meta("projectPath")).alias("target")))
    return F.concat(base, F.coalesce(touched, F.array().cast("array<struct<kind:string,target:string>>")))


def recency(contexts: DataFrame, keys: list[str], recent_ms: int = 3 * 3_600_000) -> DataFrame:
    """contexts with a column recent: its end lies within recent_ms of its key's latest end. Latest ends are aggregated, not gathered."""
    latest = contexts.groupBy(*keys).agg(F.max("end").alias("_latest"))
    return contexts.join(latest, keys).withColumn("recent", F.col("_latest") - F.col("end") <= recent_ms).drop("_latest")


def highlighted(text: Column, terms: list[str], before: str = "[", after: str = "]") -> Column:
    """The text with every place where a term begins a word marked, longer terms first; case doesn't matter."""
    known = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not known:
        return text
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, known))})"
    return F.regexp_replace(text, pattern, before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))


def next_step_sentence(rule: Column, text: Column) -> Column:
    """A sentence for a step of resume.next_step()."""
    return (
        F.when(rule == "note", text)
        .when(rule == "failing", F.concat(F.lit("Fix the failing command: "), text))
        .when(rule == "dirty", F.concat(F.lit("Commit or stash "), text, F.when(text == "1", F.lit(" file")).otherwise(" files")))
        .when(rule == "agent", F.lit("Review what the agent did"))
    )
