"""Projects: roots found in the data, owners of paths by a prefix join, per-project folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import absolute
from ..functions.text import leaf
from .intervals import merged_spans


def path_key(path: Column) -> Column:
    """Trimmed, without closing separators; a Windows path with backslashes and in lower case."""
    bare = F.regexp_replace(F.trim(path), r"[/\\]+$", "")
    return F.when(F.rlike(bare, F.lit(r"^[A-Za-z]:|\\")), F.lower(F.regexp_replace(bare, "/", r"\\\\"))).otherwise(bare)


def same_place(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; case and kind of separator don't matter."""
    tidy = lambda p: F.concat(F.lower(F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/+$", "")), F.lit("/"))
    return F.startswith(tidy(a), tidy(b)) | F.startswith(tidy(b), tidy(a))


def ancestors(key: Column) -> Column:
    """All prefixes of a path that end before a separator, the path itself included: for equi-joins in place of prefix joins."""
    n = F.size(F.split(key, r"[/\\]"))
    sep = F.when(F.contains(key, F.lit("\\")), "\\").otherwise("/")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", key, sep, i))


def project_roots(roots: DataFrame) -> DataFrame:
    """root: distinct roots that contain no other root."""
    distinct = roots.select("root").where(F.col("root").isNotNull() & (F.col("root") != "")).distinct()
    above = distinct.select(F.explode(ancestors(F.col("root"))).alias("parent"), F.col("root").alias("child")).where("parent <> child").select(F.col("parent").alias("root")).distinct()
    return distinct.join(above, "root", "left_anti")


def owners(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """paths with the deepest root that holds them (null if none). Ancestors make it an equi-join."""
    long = paths.select(path).distinct().withColumn("root", F.explode(ancestors(F.col(path))))
    best = long.join(roots.select("root"), "root").groupBy(path).agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, path, "left")


def project_fold(events: DataFrame, now_day: Column, keys: list[str]) -> DataFrame:
    """keys and, of each, last_ms, last_type, last_important, n_events, days_7 (work days active among the last seven)."""
    at = F.struct("ts_ms", "ord")
    return events.groupBy(*keys).agg(
        F.max("ts_ms").alias("last_ms"), F.max_by("type", at).alias("last_type"), F.max_by(F.when(F.col("importance") >= 80, F.col("ord")), F.when(F.col("importance") >= 80, at)).alias("last_important"),
        F.count("*").alias("n_events"), F.countDistinct(F.when((F.col("work_day") > F.date_sub(now_day, 7)) & (F.col("work_day") <= now_day), F.col("work_day"))).alias("days_7"),
    )


def top_projects(folded: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_ms"), "repository"))
    return folded.withColumn("rank", rank).where(F.col("rank") <= n)


def week_notes(folded: DataFrame, now_ms: int, keys: list[str]) -> DataFrame:
    """keys, note, repository: the main project (three days at least), and those paused for 7 to 30 days with five events at least."""
    idle = (F.lit(now_ms) - F.col("last_ms")) / 86_400_000
    main = folded.where("days_7 >= 3").groupBy(*keys).agg(F.max_by("repository", F.struct("days_7", "last_ms")).alias("repository")).select(*keys, F.lit("main").alias("note"), "repository")
    paused = folded.where((idle >= 7) & (idle <= 30) & (F.col("n_events") >= 5)).select(*keys, F.lit("paused").alias("note"), "repository")
    return main.union(paused)


def today_spans(events: DataFrame, keys: list[str], tolerance_ms: int = 10 * 60_000) -> DataFrame:
    """Spans of activity, merged over gaps up to the tolerance."""
    return merged_spans(events.select(*keys, F.col("ts_ms").alias("start"), F.greatest("end_ms", F.col("ts_ms") + 60_000).alias("end")), keys, tolerance_ms)


#: Events that say which folder is a project.
NAMES_A_PROJECT = ["agent.session", "git.commit", "git.status.summary", "git.branch.checkout"]
#: Titles that agents give by default, of which nothing is learnt; titles of sessions that get back to where a crash left off.
GENERIC_TITLE, RECOVERY = r"(?i)^(claude code|codex)\b", r"(?i)plantage|crash"
FILES, PAUSED_DAYS, PAUSED_SESSIONS, RECOVERIES = 8, (7, 30), 5, 3


def _meta(name: str) -> Column:
    return F.get_json_object("metadata", f"$.{name}")


def is_scratch(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?i)[\\/](temp|tmp)[\\/]|[\\/]scratchpad([\\/]|$)"))


def place_of() -> Column:
    """The folder in which an event happened."""
    return F.coalesce(*map(_meta, ("projectPath", "worktree", "workspacePath", "cwd")))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that has rows for every key: a plan's estimate would have the driver collect it to send it out."""
    return side.hint("merge")


def owned_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events that belong to a project of their key, with columns root (its path_key) and end (not before ts_ms).

    A folder that names itself a project and holds no other one is a project; scratch folders aren't. The owner is an equi-join on the ancestors of an event's folder.
    Roots and owners come from the distinct folders, which are found once; events are read for these and once more for each use of the result."""
    here = events.withColumns({"_place": place_of(), "end": F.greatest(F.coalesce("end_ms", "ts_ms"), "ts_ms")})
    key = F.when(~is_scratch(F.col("_place")), path_key(F.col("_place")))
    # exploded, as a filter on the key would be pushed down to the source and tell the metadata again at each mention
    placed = here.select("*", F.explode(F.array_remove(F.array(F.coalesce(key, F.lit(""))), "")).alias("_key")).drop("_place")
    # a folder may stand twice, by whether an event there names it: as a key of the grouping this is kept wherever the folders are used, so that Spark finds them once
    folders = placed.select(*keys, "_key", F.coalesce(F.col("type").isin(NAMES_A_PROJECT), F.lit(False)).alias("_names")).distinct()
    inside = folders.withColumn("root", F.explode(ancestors(F.col("_key"))))
    itself = F.col("_key") == F.col("root")
    marked = inside.groupBy(*keys, "root").agg(F.bool_or(F.col("_names") & itself).alias("_named"), F.bool_or(F.col("_names") & ~itself).alias("_holds"))
    roots = marked.where("_named and not _holds").select(*keys, "root")
    owner = inside.join(_shuffled(roots), [*keys, "root"]).groupBy(*keys, "_key").agg(F.max_by("root", F.length("root")).alias("root"))
    return placed.join(_shuffled(owner), [*keys, "_key"]).drop("_key")


def project_cards(owned: DataFrame, now_day: Column, keys: list[str], files: bool = True) -> DataFrame:
    """Of owned_events(): keys, root, name, last_at, branch, dirty, last_commit, last_session, sessions, days_7 and, if asked for, files (newest first, FILES at most)."""
    at, kind = F.struct("ts_ms", "ord"), F.col("type")
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), at))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), _meta("title"))
    session = kind == "agent.session"
    branch = F.when(session & (_meta("gitBranch") != "HEAD"), _meta("gitBranch")).when(kind == "git.commit", _meta("branch")).when(kind == "git.branch.checkout", F.coalesce(_meta("to"), _meta("branch")))
    week = (F.col("work_day") > F.date_sub(now_day, 7)) & (F.col("work_day") <= now_day)
    by = [*keys, "root"]
    cards = owned.groupBy(*by).agg(
        F.max("end").alias("last_at"), latest(F.nullif(branch, F.lit(""))).alias("branch"), latest(F.when(kind == "git.status.summary", _meta("dirtyFiles").try_cast("int"))).alias("dirty"),
        latest(F.nullif(F.when(kind == "git.commit", F.coalesce(_meta("messageRedacted"), F.col("title"))), F.lit(""))).alias("last_commit"),
        latest(F.when(session & ~F.rlike(F.trim(title), F.lit(GENERIC_TITLE)), title)).alias("last_session"),
        F.count_if(session).alias("sessions"), F.countDistinct(F.when(week, F.col("work_day"))).alias("days_7"),
    ).withColumn("name", leaf(F.col("root")))
    if not files:
        return cards
    touched = owned.where(session).select(*by, "ts_ms", "ord", F.posexplode(F.from_json(_meta("filesTouched"), "array<string>")).alias("i", "file")).where(F.col("file").isNotNull() & ~is_scratch(F.col("file")))
    newest = touched.groupBy(*by, absolute(F.col("file"), F.col("root")).alias("file")).agg(F.max(F.struct("ts_ms", "ord", "i")).alias("at"))
    newest = newest.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("at")))).where(F.col("n") <= FILES)
    lists = newest.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "file"))), lambda x: x["file"]).alias("files"))
    return cards.join(_shuffled(lists), by, "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def typed_spans(owned: DataFrame, keys: list[str], day: Column, tolerance_ms: int = 10 * 60_000) -> DataFrame:
    """keys, root, start, end, n: what each project did on a work day: sessions, commits (a minute), commands (a minute at least), merged over gaps up to the tolerance."""
    kind = F.col("type")
    length = F.when(kind == "git.commit", F.lit(60_000)).when(kind == "terminal.command", F.greatest(F.coalesce(_meta("durationMs").try_cast("bigint"), F.lit(0)), F.lit(60_000)))
    spans = owned.where((F.col("work_day") == day) & kind.isin("agent.session", "git.commit", "terminal.command"))
    spans = spans.select(*keys, "root", F.col("ts_ms").alias("start"), F.coalesce(F.col("ts_ms") + length, F.col("end")).alias("end"))
    return merged_spans(spans, [*keys, "root"], tolerance_ms).drop("island")


def axis(spans: DataFrame, keys: list[str], now_ms: int, tz_minutes: int, hours: int = 4) -> DataFrame:
    """keys, axis_start, axis_end: whole local hours from the first span to now or the last one, `hours` at least."""
    hour, shift = 3_600_000, tz_minutes * 60_000
    local = spans.groupBy(*keys).agg((F.min("start") + shift).alias("a"), (F.greatest(F.max("end"), F.lit(now_ms)) + shift).alias("b"))
    start = F.col("a") - F.pmod("a", F.lit(hour))
    end = F.col("b") + F.pmod(-F.col("b"), F.lit(hour))
    return local.select(*keys, (start - shift).alias("axis_start"), (F.greatest(end, start + hours * hour) - shift).alias("axis_end"))


def placed(spans: DataFrame, axes: DataFrame, keys: list[str], least: float = 1.5) -> DataFrame:
    """spans with left and width in percent of their axis, widths of `least` at least."""
    percent = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(c) - F.col("axis_start")) / (F.col("axis_end") - F.col("axis_start")) * 100))
    return spans.join(_shuffled(axes), keys).withColumns({"left": percent("start"), "width": F.greatest(F.lit(least), percent("end") - percent("start"))}).drop("axis_start", "axis_end")


def card_notes(cards: DataFrame, events: DataFrame, now_ms: int, now_day: Column, keys: list[str]) -> DataFrame:
    """keys, note, name, n: the project of the most days this week (three at least), the one of most sessions that has been quiet for PAUSED_DAYS, and how many sessions recovered from a crash (RECOVERIES at least)."""
    best = lambda c, kept: F.max_by(F.struct("name", F.col(c).cast("bigint").alias("n"), F.col("idle").cast("bigint").alias("idle")), F.when(kept, F.struct(c, "last_at", "root")))
    cards = cards.withColumn("idle", F.floor((F.lit(now_ms) - F.col("last_at")) / 86_400_000))
    # both notes from one pass: a union would work the cards out twice
    both = cards.groupBy(*keys).agg(best("days_7", F.lit(True)).alias("main"), best("sessions", F.col("idle").between(*PAUSED_DAYS)).alias("paused"))
    note = lambda kind, n, kept: F.when(kept, F.struct(F.lit(kind).alias("note"), F.col(f"{kind}.name").alias("name"), F.col(f"{kind}.{n}").alias("n")))
    notes = F.array_compact(F.array(note("main", "n", F.col("main.n") >= 3), note("paused", "idle", F.col("paused.n") >= PAUSED_SESSIONS)))
    week = (F.col("work_day") > F.date_sub(now_day, 7)) & (F.col("work_day") <= now_day)
    again = events.where((F.col("type") == "agent.session") & week & F.rlike("title", F.lit(RECOVERY))).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= RECOVERIES)
    return both.select(*keys, F.explode(notes).alias("x")).select(*keys, "x.*").union(again.select(*keys, F.lit("recoveries").alias("note"), F.lit(None).cast("string").alias("name"), "n"))


def project_brief(cards: DataFrame) -> DataFrame:
    """cards with a column brief: what somebody new to a project needs, as plain text."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))
    files = F.when(F.size("files") > 0, F.concat(F.lit("Files touched lately:\n- "), F.array_join("files", "\n- ")))
    head = F.concat(F.lit("Project "), "name", F.lit(" ("), "root", F.lit(")"))
    dirty = F.when(F.col("dirty") > 0, F.col("dirty"))
    return cards.withColumn("brief", F.concat_ws("\n", head, part("Branch", F.col("branch")), part("Last session", F.col("last_session")), part("Last commit", F.col("last_commit")), part("Uncommitted files", dirty), files))
