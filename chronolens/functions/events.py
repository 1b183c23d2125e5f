"""Importance of events, display text, titles' keys, reflog actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_importance(ms: Column) -> Column:
    """Of a focus span: under 5 s, under a minute, longer."""
    return F.when(ms < 5_000, 5).when(ms < 60_000, 15).otherwise(30)


#: Importance by type in the two profiles that exist, labelled sessions and collectors.
LABELLED = {"git.commit": 90, "git.branch.checkout": 80, "manual.note": 90, "ide.file.saved": 60, "browser.navigation": 40}
COLLECTED = {"git.commit": 80, "git.branch.checkout": 60, "git.status.summary": 40, "agent.session": 70}


def type_importance(kind: Column, exit_code: Column, profile: dict[str, int] = COLLECTED) -> Column:
    """By type; a command counts more if it failed or has no exit code."""
    failed, passed = (95, 65) if profile is LABELLED else (75, 45)
    out = F.when(kind == "terminal.command", F.when(exit_code.eqNullSafe(F.lit(0)), passed).otherwise(failed))
    for name, n in profile.items():
        out = out.when(kind == name, n)
    return out.otherwise(30)


def is_failure(kind: Column, exit_code: Column) -> Column:
    return ((kind == "terminal.command") & ~exit_code.eqNullSafe(F.lit(0))) | kind.isin("terminal.error_tail", "ide.diagnostic.error")


def title_key(title: Column) -> Column:
    """A title without symbol glyphs and counters, so that a changing badge isn't a change."""
    plain = F.regexp_replace(title, r"[←-⯿\x{1F000}-\x{1FAFF}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\(\d+[^)]*\)", ""), r"\s+", " "))


def reflog_action(line: Column) -> Column:
    """struct(kind, text, from, to) of the action of a reflog line."""
    action = F.regexp_extract(line, r"\t(.*)$", 1)
    commit = F.regexp_extract(action, r"^commit(?: \((?:amend|initial)\))?: (.*)$", 1)
    move = lambda i: F.regexp_extract(action, r"^checkout: moving from (\S+) to (\S+)$", i)
    kind = F.when(commit != "", "commit").when(move(2) != "", "checkout").otherwise("other")
    return F.struct(kind.alias("kind"), F.nullif(commit, F.lit("")).alias("text"), F.nullif(move(1), F.lit("")).alias("from"), F.nullif(move(2), F.lit("")).alias("to"))
