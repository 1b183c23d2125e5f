"""Queries over streams and the stores they write, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import days, sessions
from ..sources.adapters import silver_events
from ..sources.staging import fresh_path
from ..streaming import tail
from ..operators import binned, index, scan
from ..sources import readers
from .catalogue import _CORPUS, _IDF, _LEX, _NOW, _SCORE, DAY, EV, HOUR, TERMS, _search_rows, query


def delivered(spark: SparkSession, rows: DataFrame, name: str, write) -> str:
    """Runs a stream once for each value of rows' column delivery (0, 1, ...), over files that come between the runs; returns the folder it works in. write: (batch, number)."""
    root = fresh_path(spark, name)
    last = rows.agg(F.max("delivery")).first()[0]
    schema = rows.drop("delivery").schema
    for k in range(0 if last is None else last + 1):
        rows.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return root


def _active(rows: DataFrame) -> DataFrame:
    floored = rows.select(*DAY, F.col("ts_ms").alias("start"), F.greatest("end_ms", F.col("ts_ms") + 30_000).alias("end"))
    return I.merged_spans(floored, DAY).groupBy(*DAY).agg(F.sum(F.col("end") - F.col("start")).alias("covered_ms"), F.sum("n").alias("n"))


@query(
    f"""WITH {EV}, s AS (SELECT session_id, work_day, ts_ms AS a, greatest(end_ms, ts_ms + 30000) AS b FROM ev),
r AS (SELECT *, max(b) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r),
m AS (SELECT session_id, work_day, k, max(b) - min(a) AS ms, count(*) AS n FROM g GROUP BY ALL)
SELECT session_id, work_day, CAST(sum(ms) AS BIGINT) AS covered_ms, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL"""
)
def recomputed_days(spark, d):
    """Active time of every day, kept up while events come in three deliveries: the first half of the month, the second, then late ones of all days and some delivered again."""
    root = fresh_path(spark, "recomputed")
    e = silver_events(spark, d).select("session_id", "ord", "ts_ms", "end_ms", "work_day")
    late = F.when(F.col("ord") % 10 == 0, 2).when(F.dayofmonth("work_day") < 16, 0).otherwise(1)
    rows = e.withColumn("delivery", late).unionByName(e.where("ord % 7 = 0").withColumn("delivery", F.lit(2)))
    delivered(spark, rows, "days", days.following(f"{root}/store", f"{root}/days", ["ord"], _active))
    return days.results(spark, f"{root}/days").select(*DAY, "covered_ms", "n")


@query(f"WITH {EV} SELECT session_id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, CAST(sum(importance) AS BIGINT) AS importance FROM ev WHERE session_id % 3 = 0 OR ord % 2 = 0 GROUP BY 1")
def replaced_sessions(spark, d):
    """Sessions as files that grow: first every other event of each, then every third session whole, then these once more; folded into one version at the end."""
    table, path = f"sessions_{uuid.uuid4().hex}", fresh_path(spark, "sessions")
    e = silver_events(spark, d).select("session_id", "ord", "ts_ms", "importance")
    sessions.create(spark, table, path, "session_id BIGINT, ord BIGINT, ts_ms BIGINT, importance INT", ["session_id"], ["ts_ms", "ord"], 16)
    rows = e.where("ord % 2 = 0").withColumn("delivery", F.lit(0)).unionByName(e.where("session_id % 3 = 0").withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))))
    delivered(spark, rows, "growing", sessions.replacing(table, ["session_id"], 16))
    sessions.fold(spark, table, path, ["session_id"], buckets=16)
    held = sessions.current(spark, table, ["session_id"])
    return held.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.sum("importance").alias("importance"))


@query(f"WITH {EV} SELECT kind, text, count(*) AS n, min(ts_ms // 1000 * 1000) AS first_ms, max(ts_ms // 1000 * 1000) AS last_ms FROM (SELECT *, CASE type WHEN 'click' THEN 'checkout' ELSE 'commit' END AS kind, CASE WHEN type <> 'click' THEN type END AS text FROM ev) GROUP BY 1, 2")
def tailed_reflog(spark, d):
    """All events as lines of reflogs that come in two deliveries, read behind the offsets of the stream's checkpoint: clicks are checkouts, the rest commits."""
    root = fresh_path(spark, "reflog")
    action = F.when(F.col("type") == "click", F.concat(F.lit("checkout: moving from main to "), F.col("repository"))).otherwise(F.concat(F.lit("commit: "), F.col("type")))
    line = F.concat(F.lit("0 1 A <a@b> "), F.floor(F.col("ts_ms") / 1000).cast("string"), F.lit(" +0000\t"), action)
    text = silver_events(spark, d).select("session_id", line.alias("value"))
    write = lambda batch, number: tail.reflog_entries(batch, 0, newest=1 << 30).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
    for k in range(2):
        text.where(F.pmod("session_id", F.lit(2)) == k).select("value").write.mode("append").text(f"{root}/log")
        lines = tail.tailed(spark, f"{root}/log", ".txt")
        lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("file string, at long, ts_ms long, kind string, text string, `from` string, to string").parquet(f"{root}/rows")
    return rows.groupBy("kind", "text").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(
    f"""WITH {EV}, a AS (SELECT session_id, ts_ms, ord, k % 5 AS c, k, list_extract(['/work/atlas', '/work/borealis', '/work/tmp/x', '/work/atlas/sub'], CAST(k % 4 + 1 AS INTEGER)) AS place
  FROM (SELECT session_id, ts_ms, ev.ord, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM ev JOIN events ON event_id = ev.ord) WHERE ord % 10 = 8),
t AS (SELECT session_id, place, CAST(coalesce(sum(c) FILTER (place IN ('/work/atlas', '/work/borealis')), 0) AS BIGINT) AS calls FROM a GROUP BY 1, 2),
f0 AS (SELECT session_id, place, 'src/a' || (k % 7) || '.py' AS name, min((ts_ms, ord)) AS met FROM a WHERE k % 4 IN (0, 2) AND k % 3 = 0 GROUP BY 1, 2, 3),
f AS (SELECT session_id, place, list(name ORDER BY met, name) AS files FROM f0 GROUP BY 1, 2),
l AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id, place ORDER BY ts_ms, ord) AS p FROM a),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_ms > p + 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, place ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS b FROM l),
r AS (SELECT session_id, place, b, min(ts_ms) AS start, max(ts_ms) AS "end" FROM g GROUP BY 1, 2, 3),
k AS (SELECT r.*, calls, coalesce(files, []) AS files, start = max(start) OVER (PARTITION BY r.session_id, r.place) AS last FROM r JOIN t USING (session_id, place) LEFT JOIN f USING (session_id, place) WHERE calls > 0 OR len(coalesce(files, [])) > 0)
SELECT session_id || '|' || place AS file, start, "end", 'Agent — ' || split_part(place, '/', -1) AS title, CASE WHEN last AND calls > 0 THEN 'Run×' || calls WHEN last THEN '' END AS tool_list,
  CASE WHEN last THEN calls END AS tool_calls, CASE WHEN last THEN array_to_string(files[1:2], ',') END AS files_touched, CASE WHEN last THEN CAST(len(files) AS INTEGER) END AS files_count FROM k"""
)
def agent_session_events(spark, d):
    """Agent sessions, one for each session and place, as events by bursts: two places have tool calls, two have touched files, one has both and one neither, which gives none."""
    from ..sources.adapters import work_history

    e = work_history(spark, d).where("type = 'agent.session'")
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    place = get("projectPath")
    e = e.select("ts_ms", "ord", place.alias("cwd"), F.concat(F.col("session_id").cast("string"), F.lit("|"), place).alias("file"), get("toolCallCount").cast("bigint").alias("c"), get("filesTouched[0]").alias("name"), get("gitBranch").alias("b"))
    e = e.join(silver_events(spark, d).select("ord", F.coalesce(F.get_json_object("metadata", "$.k").try_cast("int"), F.lit(0)).alias("k")), "ord")
    calls = F.when(F.col("cwd").isin("/work/atlas", "/work/borealis"), F.col("c")).otherwise(0)
    touched = e.where("k % 4 IN (0, 2) AND k % 3 = 0").groupBy("file", "name").agg(F.min(F.struct("ts_ms", "ord")).alias("at"))
    files = touched.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("files"))
    none = F.array().cast("array<struct<name:string,calls:bigint>>")
    own = e.groupBy("file", "cwd").agg(F.sum(calls).alias("calls"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).join(files, "file", "left")
    held = own.select("file", F.lit(None).cast("string").alias("title"), "cwd", F.when(F.col("calls") > 0, F.array(F.struct(F.lit("Run").alias("name"), "calls"))).otherwise(none).alias("tools"), "files", "first_ms", "last_ms")
    out = readers.agent_events(held, e.select("file", F.col("ts_ms").alias("ms")), 86_400_000)
    return out.withColumns({"tool_list": F.array_join("tool_list", ","), "files_touched": F.array_join(F.slice("files_touched", 1, 2), ",")})


_OPEN = "sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING)"


@query(
    f"""WITH {EV}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  last_value(repository IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr FROM ev)
SELECT session_id, ord, CAST({_OPEN.format(cond="reach IS NULL OR ts_ms > reach + 7200000")} AS BIGINT) AS gap_bucket, CAST({_OPEN.format(cond="reach IS NULL OR ts_ms > reach + 7200000 OR coalesce(repository <> lr, false)")} AS BIGINT) AS repo_bucket FROM r"""
)
def segmented_buckets(spark, d):
    """Buckets of gaps of two hours, and of gaps or other repositories, over whole sessions, by scans that no session binds to one task."""
    e = silver_events(spark, d).select("session_id", "ord", "ts_ms", "end_ms", "repository")
    gaps = scan.gap_buckets(e, ["session_id"], 2 * HOUR).select("session_id", "ord", F.col("bucket").alias("gap_bucket"))
    return gaps.join(scan.repo_gap_buckets(e, ["session_id"], 2 * HOUR).select("session_id", "ord", F.col("bucket").alias("repo_bucket")), ["session_id", "ord"])


@query(
    f"""WITH {EV}, l AS (SELECT *, lag(type) OVER (PARTITION BY session_id ORDER BY ts_ms, ord) AS p, lag(ord) OVER (PARTITION BY session_id ORDER BY ts_ms, ord) AS po FROM ev),
g AS (SELECT *, sum(CASE WHEN po IS NULL OR type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT session_id, CAST(run AS BIGINT) AS run, type AS value, min(ts_ms) AS start, max(end_ms) AS "end", count(*) AS n FROM g GROUP BY session_id, run, type"""
)
def segmented_runs(spark, d):
    """Runs of one type over whole sessions, by the same scans."""
    return scan.run_collapse(silver_events(spark, d), ["session_id"], F.col("type"))


@query(
    f"""WITH {EV}, p AS (SELECT session_id, ts_ms AS a, ts_ms + 7200000 AS b FROM ev WHERE type IN ('signup', 'purchase'))
SELECT session_id, ord FROM ev WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session_id = ev.session_id AND ev.ts_ms >= a AND ev.ts_ms < b)"""
)
def segmented_pauses(spark, d):
    """Events outside the two hours behind each signup and purchase of their session, without a join."""
    e = silver_events(spark, d).select("session_id", "ord", "ts_ms", "type")
    pauses = e.where("type in ('signup', 'purchase')").select("session_id", F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + 2 * HOUR).alias("until_ms"))
    return scan.pause_gate(e, pauses, ["session_id"]).select("session_id", "ord")


@query(
    f"""WITH {EV}, p AS (SELECT session_id, ord AS pause, ts_ms AS a, end_ms + 3600000 AS b FROM ev WHERE type = 'error')
SELECT ev.session_id, ord, pause FROM ev JOIN p ON p.session_id = ev.session_id AND ev.ts_ms >= a AND ev.ts_ms < b AND ev.ord <> pause"""
)
def events_after_errors(spark, d):
    """Each event of a session with each error that it falls into, or within the hour behind: a range join on bins of time."""
    e = silver_events(spark, d).select("session_id", "ord", "ts_ms")
    errors = silver_events(spark, d).where("type = 'error'").select("session_id", F.col("ord").alias("pause"), F.col("ts_ms").alias("from_ms"), (F.col("end_ms") + HOUR).alias("until_ms"))
    return binned.within(e, errors, ["session_id"]).where("ord <> pause").select("session_id", "ord", "pause")


@query(
    f"""WITH {EV}, s AS (SELECT * FROM ev WHERE end_ms > ts_ms)
SELECT a.session_id, a.ord AS ord, b.ord AS other FROM s a JOIN s b ON a.session_id = b.session_id AND a.type = 'click' AND b.type = 'view' AND a.ts_ms < b.end_ms AND b.ts_ms < a.end_ms"""
)
def overlapping_spans(spark, d):
    """Clicks and views of a session that overlap in time, by bins."""
    e = silver_events(spark, d)
    clicks = e.where("type = 'click'").select("session_id", "ord", F.col("ts_ms").alias("start"), F.col("end_ms").alias("end"))
    views = e.where("type = 'view'").select("session_id", F.col("ord").alias("other"), F.col("ts_ms").alias("from_ms"), F.col("end_ms").alias("until_ms"))
    return binned.overlapping(clicks, views, ["session_id"]).select("session_id", "ord", "other")


def _indexed(spark: SparkSession, d: str, name: str) -> str:
    path = fresh_path(spark, name)
    rows = _search_rows(spark, d)
    for k in range(2):  # the index grows by batches
        index.add(rows.where(F.pmod("doc_id", F.lit(2)) == k), path, "doc_id", k)
    return path


@query(f"WITH {_CORPUS}, {_IDF}, {_LEX} SELECT doc_id, round(least(1.0, {_SCORE}), 9) AS score FROM scored ORDER BY score DESC, last_ms DESC LIMIT 24")
def indexed_search(spark, d):
    """As ranked_search, from an inverted index of the documents."""
    r = index.ranked(spark, _indexed(spark, d, "index"), TERMS, _NOW).withColumn("score", F.round("score", 9))
    return r.orderBy(F.desc("score"), F.desc("last_ms")).limit(24).select(F.col("id").alias("doc_id"), "score")


@query(
    r"""SELECT token, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+')) AS token FROM documents) WHERE length(token) >= 2 AND starts_with(token, 'th') GROUP BY 1"""
)
def index_terms(spark, d):
    """Words of the index that begin with `th`, and in how many documents each is: a range of its sorted table."""
    return index.terms(spark, _indexed(spark, d, "terms"), "th")
