"""Anchors: identifiers that events share, as a long table, and their joins.

event_anchors: session_id, work_day, ord, rank (order within the event), type, value, norm, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEYS = ["session_id", "work_day"]
#: Fixed values.
STRONG, MEDIUM, LOOSE = ["issue", "worktree"], ["branch", "project", "document"], ["keyword", "document", "project"]
IDENTITY = ["issue", "worktree", "branch"]
NO_SUBJECT_TYPE = "git.status.summary"
#: Fixed value: what is cut from the names of files that an agent touched. Its dot stands for any character, so a name without an extension loses its last seven.
TOUCHED_ENDING = r"(?i).[a-z0-9]{1,6}$"


def strength(kind: Column) -> Column:
    return F.when(kind.isin(STRONG), "strong").when(kind.isin(MEDIUM), "medium").otherwise("weak")


def _json(name: str) -> Column:
    """A field of the metadata; parsed only where the text holds the field's name, or a backslash, by which names may be spelt otherwise."""
    held = F.contains("metadata", F.lit(name)) | F.contains("metadata", F.lit("\\"))
    return F.when(held, F.get_json_object("metadata", f"$.{name}"))


def _anchor(kind: str, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"))


def _each(kind: str, values: Column, confidence: float) -> Column:
    return F.coalesce(F.transform(values, lambda v: _anchor(kind, v, confidence)), F.array().cast("array<struct<type:string,value:string,confidence:double>>"))


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[a-z0-9]{1,6}$", "")


def event_anchors(events: DataFrame) -> DataFrame:
    """Anchors of each event (session_id, work_day, ord, title, repository, metadata), first of each (type, norm) only, norms of two characters at least."""
    issue_text = [F.col("title"), *map(_json, ("to", "branch", "messageRedacted", "commandRedacted", "mission", "url"))]
    issues = F.flatten(F.array(*[F.coalesce(T.issue_ids(x), F.array().cast("array<string>")) for x in issue_text]))
    declared = F.coalesce(F.from_json(_json("anchors"), "array<struct<type:string,value:string>>"), F.array().cast("array<struct<type:string,value:string>>"))
    declared = F.transform(declared, lambda a: F.struct(a["type"].alias("type"), a["value"].alias("value"), F.lit(0.98).alias("confidence")))
    branch = F.coalesce(_json("to"), _json("branch"), _json("gitBranch"))
    worktree = F.coalesce(_json("worktree"), _json("projectPath"), _json("workspacePath"))
    parts = F.filter(F.split(worktree, r"[/\\]+"), lambda p: p != "")
    short = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "-")
    files = F.slice(F.from_json(_json("filesTouched"), "array<string>"), 1, 25)
    documents = F.array_compact(F.array(*[_without_extension(T.leaf(_json(k))) for k in ("path", "toPath", "fromPath")]))
    host = F.coalesce(_json("host"), F.try_parse_url(_json("url"), F.lit("HOST")))
    one = lambda kind, value, c: F.when(value.isNotNull(), F.array(_anchor(kind, value, c))).otherwise(F.array().cast("array<struct<type:string,value:string,confidence:double>>"))
    every = F.concat(
        declared, _each("issue", issues, 0.95), one("branch", F.when(branch != "HEAD", branch), 0.85), one("worktree", F.when(F.length(short) > 0, short), 0.9),
        one("repository", F.col("repository"), 0.5), _each("repository", F.array_compact(F.array(T.leaf(_json("cwd")), T.leaf(_json("workspacePath")))), 0.45),
        one("project", _json("project"), 0.9), _each("document", F.transform(files, lambda f: F.regexp_replace(T.leaf(f), TOUCHED_ENDING, "")), 0.8), _each("document", documents, 0.8),
        one("document", T.leaf(_json("directory")), 0.7), one("url", F.when(~host.startswith("localhost"), host), 0.4),
    )
    ranked = F.transform(every, lambda a, i: F.struct(i.alias("rank"), a["type"].alias("type"), a["value"].alias("value"), a["confidence"].alias("confidence"), T.normalize(a["value"]).alias("norm")))
    name = lambda a: F.concat(a["type"], F.lit("\n"), a["norm"])
    first = lambda rows, names: F.filter(rows, lambda a: (F.length(a["norm"]) >= 2) & (F.array_position(names, name(a)) == a["rank"] + 1))
    kept = T.bound(ranked, lambda rows: T.bound(F.transform(rows, name), lambda names: first(rows, names)))
    # a day's events move to one place first: files of few parts don't bound the tasks, and what follows by days finds its rows there
    moved = events.select(*KEYS, "ord", "title", "repository", "metadata").repartition(*KEYS)
    return moved.select(*KEYS, "ord", F.explode(kept).alias("a")).select(*KEYS, "ord", "a.*")


def phrases(events: DataFrame, text: str = "title") -> DataFrame:
    """KEYS, ord, app, pos, phrase, norm of every phrase of a title that may offer a subject."""
    titled = events.where(F.col(text).isNotNull() & (F.col(text) != "") & (F.col("type") != NO_SUBJECT_TYPE))
    each = F.transform(T.title_phrases(F.col("_text")), lambda p, i: F.struct(i.alias("pos"), p.alias("phrase"), T.normalize(p).alias("norm")))
    # a day's events move to one place before they are exploded, and not each of their phrases behind it
    moved = titled.select(*KEYS, "ord", "app", F.col(text).alias("_text")).repartition(*KEYS).withColumn("p", F.explode(F.filter(each, lambda p: F.length(p["norm"]) >= 4)))
    return moved.select(*KEYS, "ord", "app", "p.*")


def distinct(value: Column) -> Column:
    """How many values a group has, kept as a set: groups are parts of one day, and rows aren't doubled for it."""
    return F.size(F.collect_set(value)).cast("bigint")


def _by_norm(events: DataFrame) -> DataFrame:
    """KEYS, norm, apps, value (the first spelling) and where a phrase was seen: (ord, pos), each place of it."""
    apps, value = distinct(F.coalesce("app", F.lit("unknown"))).alias("apps"), F.min_by("phrase", F.struct("ord", "pos")).alias("value")
    return phrases(events).groupBy(*KEYS, "norm").agg(apps, value, F.collect_list(F.struct("ord", "pos")).alias("seen"))


def keyword_anchors(events: DataFrame) -> DataFrame:
    """KEYS, norm, value, confidence, apps, seen: phrases seen in two applications at least; the first spelling stands."""
    return _by_norm(events).where(F.col("apps") >= 2).withColumn("confidence", F.least(F.lit(0.8), 0.4 + 0.12 * F.col("apps")))


def with_keywords(anchors: DataFrame, events: DataFrame) -> DataFrame:
    """Event anchors and, after them, the keywords each event's title holds. Titles are cut into phrases once, and a keyword knows the events it was seen in."""
    hits = keyword_anchors(events).select(*KEYS, "norm", "value", "confidence", F.explode(F.array_distinct("seen.ord")).alias("ord"))
    keywords = hits.select(*KEYS, "ord", (F.lit(1000) + F.row_number().over(Window.partitionBy(*KEYS, "ord").orderBy("norm"))).alias("rank"), F.lit("keyword").alias("type"), "value", "confidence", "norm")
    return anchors.select(*KEYS, "ord", "rank", "type", "value", "confidence", "norm").unionByName(keywords)


def places(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """KEYS, norm: names of applications, repositories, projects and worktrees, and their parts of four characters at least; none names a subject."""
    apps = events.select(*KEYS, F.explode(F.array_compact(F.array("app", "app_display") if "app_display" in events.columns else F.array("app"))).alias("v")).select(*KEYS, T.normalize(F.col("v")).alias("norm"))
    named = anchors.where(F.col("type").isin("repository", "project", "worktree"))
    parts = F.filter(F.split("norm", "-"), lambda p: F.length(p) >= 4)
    return apps.union(named.select(*KEYS, F.explode(F.concat(F.array("norm"), parts)).alias("norm"))).distinct()


def subject_anchors(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """KEYS, norm, value, confidence, titles, seen: phrases that set some titles apart from the rest."""
    titled = events.where(F.col("title").isNotNull() & (F.col("title") != "") & (F.col("type") != NO_SUBJECT_TYPE)).select(*KEYS).groupBy(*KEYS).agg(F.count("*").alias("titled"))
    each = _by_norm(events).withColumn("titles", F.size(F.array_distinct("seen.ord")).cast("bigint"))
    each = each.where(F.col("titles") >= 2).join(titled, KEYS).where(F.col("titles") / F.col("titled") <= 0.5).join(places(events, anchors), [*KEYS, "norm"], "left_anti")
    at_most = lambda x: F.least(F.lit(1.0), x)
    confidence = 0.35 + 0.25 * at_most(F.ln(F.col("titled") / F.col("titles")) / F.ln("titled")) + 0.2 * at_most((F.col("titles") - 1) / 3) + 0.2 * at_most((F.col("apps") - 1) / 2)
    return each.withColumn("confidence", confidence).where(F.col("confidence") >= 0.5).withColumn("confidence", F.least("confidence", F.lit(0.9))).drop("apps", "titled")


def matching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that match any of b within KEYS: equal norm and the same type (or a's is loose), or both loose with a shared part of four characters."""
    b = b.select(*KEYS, F.col("type").alias("b_type"), F.col("norm").alias("b_norm"))
    exact = a.join(b.withColumnRenamed("b_norm", "norm"), [*KEYS, "norm"]).where((F.col("type") == F.col("b_type")) | F.col("type").isin(LOOSE)).select(*a.columns)
    part = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, "-"), lambda p: F.length(p) >= 4)))
    loose_a = a.where(F.col("type").isin(LOOSE)).withColumn("_part", part("norm"))
    loose_b = b.where(F.col("b_type").isin(LOOSE)).select(*KEYS, part("b_norm").alias("_part")).distinct()
    return exact.union(loose_a.join(loose_b, [*KEYS, "_part"], "left_semi").select(*a.columns)).distinct()
