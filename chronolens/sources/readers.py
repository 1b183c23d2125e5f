"""Readers of collectors' files: JSON lines, shell spool files, reflogs, labelled sessions, predictions.

All read with explicit schemas (fields that aren't listed never enter) and cost a torn or unknown line only itself. A line's place in its
file is (offset of its block, number in the block), which orders lines however Spark splits the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.events import reflog_action
from ..functions.text import leaf
from ..operators.intervals import bursts

#: Fields of an agent's session record that may be read.
AGENT_RECORD = "type string, sessionId string, timestamp string, cwd string, gitBranch string, version string, isSidechain boolean, aiTitle string, agentName string, trackingPath string, message struct<content string>"
COMMAND_CHARS = 400
STALE_MS = 6 * 3_600_000


def numbered_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, at (place in the file), value. path: also such rows themselves, where the lines of many small files are kept as a table."""
    if isinstance(path, DataFrame):
        return path.select("file", "at", "value")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def json_lines(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """file, at, ok and the fields of each line that isn't blank; ok: the line is a record. Lines that aren't have null fields."""
    raw = numbered_lines(spark, path).where(F.trim("value") != "")
    r = raw.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    fields = [f for f in r.schema["r"].dataType.fieldNames() if f != "_bad"]
    return r.select("file", "at", (F.col("r").isNotNull() & F.col("r._bad").isNull()).alias("ok"), *[F.when(F.col("r._bad").isNull(), F.col(f"r.{f}")).alias(f) for f in fields])


def read_totals(lines: DataFrame) -> DataFrame:
    """file, records, skipped."""
    return lines.groupBy("file").agg(F.count_if("ok").alias("records"), F.count_if(~F.col("ok")).alias("skipped"))


def _seen(value: Column) -> tuple[Column, Column]:
    return value, F.when(value.isNotNull(), F.col("at"))


def agent_sessions(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row for each file: session_id, cwd, branch and version (first seen), title (last seen), first_ms, last_ms, stamps, only_side (whether all is side work), tools (name, calls; most calls first), files (touched ones, each once, in order)."""
    rows = json_lines(spark, path, AGENT_RECORD).where("ok")
    branch = F.when(~F.col("gitBranch").isin("", "HEAD"), F.col("gitBranch"))
    ms = F.unix_millis(F.try_to_timestamp("timestamp"))
    items = F.from_json("message.content", "array<struct<type:string,name:string>>")
    names = F.transform(F.filter(items, lambda x: (x["type"] == "tool_use") & x["name"].isNotNull()), lambda x: x["name"])
    rows = rows.withColumns({"ms": ms, "names": F.coalesce(names, F.array().cast("array<string>"))})
    used = rows.select("file", F.explode("names").alias("name")).groupBy("file", "name").agg(F.count("*").alias("calls"))
    tools = used.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["n"]).alias("calls"))).alias("tools"))
    changed = rows.where("type = 'file-history-delta' and trackingPath is not null").groupBy("file", F.col("trackingPath").alias("name")).agg(F.min("at").alias("at"))
    files = changed.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("files"))
    out = rows.groupBy("file").agg(
        F.min_by(*_seen(F.col("sessionId"))).alias("session_id"), F.min_by(*_seen(F.col("cwd"))).alias("cwd"), F.min_by(*_seen(branch)).alias("branch"),
        F.min_by(*_seen(F.col("version"))).alias("version"), F.max_by(*_seen(F.col("aiTitle"))).alias("title"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
        F.count("ms").alias("stamps"), F.coalesce(F.bool_and(F.coalesce("isSidechain", F.lit(True))), F.lit(True)).alias("only_side"),
    )
    none = {"tools": "array<struct<name:string,calls:bigint>>", "files": "array<string>"}
    return out.join(tools, "file", "left").join(files, "file", "left").withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})


#: Fields of a rollout's record that may be read.
ROLLOUT_RECORD = (
    "timestamp string, type string, payload struct<type: string, id: string, cwd: string, cli_version: string, source: string, model: string, name: string, "
    "item: struct<type: string, changes: map<string, string>, server: string>>"
)


def rollouts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row for each rollout file (plain or compressed, as Hadoop's codecs read it): session_id, cwd, version and subagent of its first session_meta, models, tools (name, calls), files, tool_calls, first_ms, last_ms, stamps.

    Only the first session_meta describes the thread: a sub-agent's file repeats its parent's. Its cwd, if absent, is a later turn's."""
    rows = json_lines(spark, path, ROLLOUT_RECORD).where("ok").withColumn("ms", F.unix_millis(F.try_to_timestamp("timestamp")))
    meta = F.when(F.col("type") == "session_meta", F.col("at"))
    turn = F.col("type") == "turn_context"
    call = (F.col("type") == "response_item") & F.col("payload.type").isin("function_call", "custom_tool_call")
    done = (F.col("type") == "event_msg") & (F.col("payload.type") == "item_completed")
    name = F.when(call, F.col("payload.name")).when(done & (F.col("payload.item.type") == "McpToolCall"), F.concat(F.lit("mcp:"), F.coalesce("payload.item.server", F.lit(""))))
    used = rows.select("file", name.alias("name")).where("name is not null").groupBy("file", "name").agg(F.count("*").alias("calls"))
    tools = used.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["n"]).alias("calls"))).alias("tools"), F.sum("calls").alias("tool_calls"))
    changed = F.when(done & (F.col("payload.item.type") == "FileChange"), F.map_keys("payload.item.changes"))
    files = rows.select("file", "at", F.explode(changed).alias("name")).groupBy("file", "name").agg(F.min("at").alias("at")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("files"))
    out = rows.groupBy("file").agg(
        F.min_by("payload.id", meta).alias("session_id"), F.coalesce(F.min_by("payload.cwd", meta), F.min_by("payload.cwd", F.when(turn & F.col("payload.cwd").isNotNull(), F.col("at")))).alias("cwd"),
        F.min_by("payload.cli_version", meta).alias("version"), F.coalesce(F.min_by(F.startswith("payload.source", F.lit("{")), meta), F.lit(False)).alias("subagent"),
        F.array_sort(F.collect_set(F.when(turn, F.col("payload.model")))).alias("models"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("ms").alias("stamps"),
    )
    out = out.join(tools, "file", "left").join(files, "file", "left")
    none = {"tools": "array<struct<name:string,calls:bigint>>", "files": "array<string>"}
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()}).withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0)))


def agent_events(sessions: DataFrame, stamps: DataFrame, gap_ms: int, tools: int = 8, files: int = 25) -> DataFrame:
    """Events of agent sessions, one for each burst: file, start, end, title, tool_list, tool_calls and, where sessions have files, files_touched and files_count.

    sessions: file, title, cwd, tools, first_ms, last_ms and, if known, files; stamps: file, ms. A burst ends where no stamp follows within gap_ms; without stamps the whole span is one.
    The totals (the `tools` most used as name×calls, the first `files` touched) stand at the last burst only, so that sums over events count once. Sessions that neither called a tool nor touched a file are left out."""
    calls = F.aggregate("tools", F.lit(0).cast("bigint"), lambda n, t: n + t["calls"])
    known = "files" in sessions.columns
    touched = F.coalesce("files", F.array().cast("array<string>")) if known else F.array().cast("array<string>")
    totals = ["tool_list", "tool_calls", *(["files_touched", "files_count"] if known else [])]
    named = F.transform(F.slice("tools", 1, tools), lambda t: F.concat(t["name"], F.lit("×"), t["calls"].cast("string")))
    kept = sessions.withColumns({"tool_calls": calls, "tool_list": named, "files_touched": F.slice(touched, 1, files), "files_count": F.size(touched)}).where("(tool_calls > 0 or files_count > 0) and first_ms is not null")
    runs = bursts(stamps.where("ms is not null").select("file", F.col("ms").alias("ts_ms")), ["file"], gap_ms).drop("n")
    last = runs.groupBy("file").agg(F.max("start").alias("_last"))
    rows = kept.join(runs.join(last, "file"), "file", "left")
    final = F.col("_last").isNull() | (F.col("start") == F.col("_last"))
    title = F.coalesce("title", F.concat(F.lit("Agent — "), F.coalesce(leaf(F.col("cwd")), F.lit(""))))
    return rows.select(
        "file", F.coalesce("start", "first_ms").alias("start"), F.coalesce("end", "last_ms").alias("end"), title.alias("title"),
        *(F.when(final, F.col(c)).alias(c) for c in totals),
    )


def to_sessions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stored events as sessions: ref (numbered by time within keys), tz of the session's first event, repository lifted from the metadata; metadata that is no JSON object is {}.

    Where events have an app or a pid, they stand in the metadata as bundleId and pid, unless it has these itself."""
    tidy = F.when(F.coalesce(F.rlike(F.trim("metadata"), F.lit(r"(?s)^\{.*\}$")), F.lit(False)) & F.col("metadata").isNotNull() & F.from_json("metadata", "map<string,string>").isNotNull(), F.col("metadata")).otherwise("{}")
    by = Window.partitionBy(*keys).orderBy("ts_ms", "ord")
    own = {"bundleId": "app", "pid": "pid"}
    added = [F.when(F.col(c).isNotNull() & ~F.array_contains(F.json_object_keys(tidy), name), F.regexp_replace(F.to_json(F.struct(F.col(c).alias(name))), r"^\{|\}$", "")) for name, c in own.items() if c in events.columns]
    if added:
        inner = F.nullif(F.trim(F.regexp_replace(F.trim(tidy), r"(?s)^\{(.*)\}$", "$1")), F.lit(""))
        tidy = F.concat(F.lit("{"), F.concat_ws(",", *added, inner), F.lit("}"))
    out = events.withColumn("metadata", tidy).withColumn("ref", F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lpad((F.row_number().over(by) - 1).cast("string"), 5, "0")))
    return out.withColumns({"tz": F.first("tz").over(by), "repository": F.coalesce(F.nullif(F.get_json_object("metadata", "$.repository"), F.lit("")), F.col("repository"))})


def write_snapshot(events: DataFrame, path: str) -> None:
    """A snapshot of events as JSON lines."""
    events.write.mode("overwrite").json(path)


def thread_names(spark: SparkSession, path: str) -> DataFrame:
    """id, thread_name: the last entry of each id that has a name."""
    rows = json_lines(spark, path, "id string, thread_name string").where("ok and id is not null and trim(thread_name) <> ''")
    return rows.groupBy("id").agg(F.max_by("thread_name", "at").alias("thread_name"))


def shell_commands(spark: SparkSession, path: str, now_ms: int | None = None) -> DataFrame:
    """Spool files, one command each: file, ts_ms, exit_code (-1 if unreadable), duration_ms, shell, cwd, command. `cmd=` takes the rest of the file. Other versions, files without time or command and, with now_ms, those over six hours old are dropped."""
    return commands_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), None if now_ms is None else F.lit(now_ms))


def commands_of(files: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """shell_commands() of files (file, value: the whole text)."""
    head = F.regexp_extract("value", r"(?s)^(.*?)(?:^|\n)\s*cmd=", 1)
    get = lambda key: F.trim(F.regexp_extract(F.concat(F.lit("\n"), head), rf"\n\s*{key}\s*=([^\n]*)", 1))
    command = F.regexp_replace(F.regexp_extract("value", r"(?s)(?:^|\n)\s*cmd=(.*)$", 1), r"[\r\n]+$", "")
    short = F.when(F.length("command") > COMMAND_CHARS, F.concat(F.left(F.col("command"), F.lit(COMMAND_CHARS)), F.lit("…"))).otherwise(F.col("command"))
    out = files.select(
        "file", get("v").alias("v"), F.coalesce(get("ts").try_cast("long"), F.lit(0)).alias("ts_ms"), F.coalesce(get("exit").try_cast("int"), F.lit(-1)).alias("exit_code"),
        F.coalesce(get("ms").try_cast("long"), F.lit(0)).alias("duration_ms"), get("shell").alias("shell"), get("cwd").alias("cwd"), command.alias("command"),
    )
    out = out.where((F.col("v") == "1") & (F.col("ts_ms") != 0) & (F.trim("command") != "")).withColumn("command", short).drop("v")
    return out if now_ms is None else out.where(now_ms - F.col("ts_ms") <= STALE_MS)


def reflog(spark: SparkSession, path: str, now_ms: int | None = None, days: int = 7, newest: int = 50) -> DataFrame:
    """Reflog lines: file, at, ts_ms, tz, kind, text, from, to. With now_ms only what a first sight takes in: the last `days` and, of each file, the `newest`."""
    stamp = F.regexp_extract("value", r"> (\d+) ([+-]\d{4})\t", 1).try_cast("long") * 1000
    zone = F.regexp_extract("value", r"> \d+ ([+-]\d{4})\t", 1)
    minutes = F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
    rows = numbered_lines(spark, path).select("file", "at", stamp.alias("ts_ms"), minutes.alias("tz"), reflog_action(F.col("value")).alias("a")).where("ts_ms is not null and a.kind <> 'other'")
    if now_ms is not None:
        rows = rows.where(F.col("ts_ms") >= now_ms - days * 86_400_000)
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts_ms"), F.desc("at")))).where(F.col("_n") <= newest).drop("_n")
    return rows.select("file", "at", "ts_ms", "tz", "a.*")


def labelled_sessions(spark: SparkSession, path: str, events: str, ids: list[str] | None = None) -> DataFrame:
    """Labelled sessions, one JSON object a file: id, name, day, tz, event (exploded, its schema given as `events`), ord."""
    s = spark.read.schema(f"id string, name string, day string, tzOffsetMinutes int, events array<struct<{events}>>").option("multiLine", True).json(path)
    if ids:
        s = s.where(F.col("id").isin(ids))
    return s.select("id", "name", "day", F.col("tzOffsetMinutes").alias("tz"), F.posexplode("events").alias("ord", "event"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A file {session: {event: cluster}} as rows session_id, ref, cluster."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    return text.select(F.explode("m").alias("session_id", "of")).select("session_id", F.explode("of").alias("ref", "cluster"))


def shifted(events: DataFrame, now_ms: int, keys: list[str]) -> DataFrame:
    """Events moved in time so that each key's last one ends at now_ms; gaps stay."""
    last = events.groupBy(*keys).agg(F.max(F.coalesce("end_ms", "ts_ms")).alias("_last"))
    move = F.lit(now_ms) - F.col("_last")
    return events.join(last, keys).withColumns({"ts_ms": F.col("ts_ms") + move, "end_ms": F.col("end_ms") + move}).drop("_last")
