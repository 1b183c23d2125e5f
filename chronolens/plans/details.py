"""Further queries that call an operator as it stands, with the equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import display as S
from ..functions import events as E
from ..functions import text as T
from ..operators import anchors as A
from ..operators import corpus as Q
from ..operators import engine as G
from ..operators import evaluate as V
from ..operators import redact as D
from ..sources import readers, store
from ..sources.adapters import silver_events, work_history
from . import catalogue as C
from .cards import HIST, NAMES
from .catalogue import CTX, DAY, EV, query

_NAMES = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"


@query(f"WITH {HIST} SELECT ord, session_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, ord) - 1 AS VARCHAR), 5, '0') AS ref, 60 AS tz, repository FROM hist")
def session_refs(spark, d):
    return readers.to_sessions(work_history(spark, d), ["session_id"]).select("ord", "ref", "tz", "repository")


@query("""SELECT event_id, '{"a":"pw password=[REDACTED:env_assignment]","b":["[REDACTED:anthropic_api_key]",{"c":"plain"}],"n":' || event_id || '}' AS meta, 2 AS hits FROM events""")
def redacted_json(spark, d):
    e = C.table(spark, d, "events")
    inner = F.struct(F.lit("plain").alias("c"))
    secret = F.concat(F.lit("sk-ant-"), F.repeat(F.lit("a"), (F.col("event_id") % 5 + 20).cast("int")))
    meta = F.concat(F.lit('{"a": "pw password=hunter'), (F.col("event_id") % 10).cast("string"), F.lit('", "b": ["'), secret, F.lit('", '), F.to_json(inner), F.lit('], "n": '), F.col("event_id").cast("string"), F.lit("}"))
    return D.storable(D.redact_json(e.select("event_id", meta.alias("meta")), "meta")).select("event_id", "meta", F.col("redaction_count").alias("hits"))


@query(
    f"""WITH {HIST} SELECT ord, CASE kind WHEN 'terminal.command' THEN CASE WHEN exit_code = 0 THEN 45 ELSE 75 END WHEN 'git.commit' THEN 80 WHEN 'git.branch.checkout' THEN 60 WHEN 'git.status.summary' THEN 40 WHEN 'agent.session' THEN 70 ELSE 30 END AS importance,
  kind = 'terminal.error_tail' OR kind = 'terminal.command' AND coalesce(exit_code, 1) <> 0 AS failed FROM hist"""
)
def event_importance(spark, d):
    code = F.get_json_object("metadata", "$.exitCode").try_cast("int")
    return work_history(spark, d).select("ord", E.type_importance(F.col("type"), code).alias("importance"), E.is_failure(F.col("type"), code).alias("failed"))


@query(
    f"""WITH {CTX}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, work_day ORDER BY start, ord) AS context FROM ctx)
SELECT session_id, work_day, context, CAST(row_number() OVER (PARTITION BY session_id, work_day ORDER BY active_ms DESC, context) AS INTEGER) AS place FROM n"""
)
def context_order(spark, d):
    number = F.row_number().over(Window.partitionBy(*DAY).orderBy("start", "ord"))
    return G.ordered(C.contexts(spark, d).withColumn("context", number.cast("bigint"))).select(*DAY, "context", "place")


@query(f"""WITH {CTX} SELECT session_id, ord, max("end") OVER (PARTITION BY session_id) - "end" <= 10800000 AS recent FROM ctx""")
def recent_contexts(spark, d):
    return S.recency(C.contexts(spark, d), ["session_id"]).select("session_id", "ord", "recent")


@query(
    f"""WITH {EV}, b AS (SELECT session_id, work_day, type, hour, string_agg(ord, ',' ORDER BY ts_ms DESC, ord DESC) AS ords, max((ts_ms, ord)) AS last FROM ev GROUP BY 1, 2, 3, 4)
SELECT session_id, work_day, type AS context, CAST(row_number() OVER (PARTITION BY session_id, work_day, type ORDER BY last DESC) AS INTEGER) AS block, CAST(hour AS BIGINT) AS activity, ords FROM b"""
)
def timeline_blocks(spark, d):
    """Hours stand as activities, event types as contexts."""
    e = silver_events(spark, d)
    assigned = e.select(*DAY, "ord", C.C.hour_of(F.col("ts_ms"), F.col("tz")).cast("bigint").alias("activity"), F.col("type").alias("context"))
    return G.timeline_blocks(e.select(*DAY, "ord", "ts_ms"), assigned).withColumn("ords", F.concat_ws(",", F.col("ords").cast("array<string>")))


@query(f"SELECT session_id, work_day, CASE rule WHEN 'note' THEN ref || '' WHEN 'failing' THEN 'Fix the failing command: ' || ref ELSE 'Review what the agent did' END AS sentence FROM ({C.SQL['resume_next_step']})")
def next_step_sentences(spark, d):
    steps = C.resume_next_step(spark, d)
    return steps.select(*DAY, S.next_step_sentence(F.col("rule"), F.col("ref").cast("string")).alias("sentence"))


_CLOCK = "lpad(CAST(({0} + 3600000) // 60000 % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0} + 3600000) // 60000 % 60 AS VARCHAR), 2, '0')"


@query(
    f"""WITH {CTX} SELECT session_id, work_day, string_agg({_CLOCK.format('start')} || '-' || {_CLOCK.format('"end"')} || '  ' || key || '  ' || CASE WHEN m < 60 THEN m || 'm' ELSE (m // 60) || 'h' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') END, chr(10) ORDER BY start, ord) AS text
FROM (SELECT *, CAST(floor(active_ms / 60000.0 + 0.5) AS BIGINT) AS m FROM ctx) GROUP BY 1, 2"""
)
def worklog_texts(spark, d):
    from .export import worklog

    return worklog(C.contexts(spark, d))


@query(
    f"""WITH {C._CORPUS}, {C._IDF}, {C._LEX}, p AS (SELECT *, h0 AND h1 AND h2 AS complete FROM scored)
SELECT doc_id, round(least(1.0, ({C._SCORE}) * CASE WHEN doc_id % 3 = 1 AND NOT complete THEN 0.6 ELSE 1.0 END), 9) AS score FROM p WHERE doc_id % 3 <> 0 OR complete ORDER BY score DESC, last_ms DESC LIMIT 24"""
)
def private_search(spark, d):
    """Private facts are found only by all terms, sensitive ones count less without all."""
    rows = Q.narrowed(C._search_rows(spark, d), C.TERMS).withColumn("privacy", F.get(F.array(F.lit("private"), F.lit("sensitive"), F.lit("normal")), (F.col("doc_id") % 3).cast("int")))
    r = Q.rank(rows, C.TERMS, C._NOW).withColumn("score", F.round("score", 9))
    return r.orderBy(F.desc("score"), F.desc("last_ms")).limit(24).select("doc_id", "score")


@query(
    f"""WITH {EV}, n AS (SELECT ev.*, ({_NAMES})[TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 + 1] AS name, ({_NAMES})[ord % 5 + 1] AS other FROM ev JOIN events ON event_id = ord)
SELECT session_id, work_day, ord FROM n WHERE type = 'view' AND EXISTS (SELECT 1 FROM n e WHERE e.type = 'error' AND e.session_id = n.session_id AND e.work_day = n.work_day AND e.other = n.name)"""
)
def loose_anchor_match(spark, d):
    """Documents and keywords match by a shared part."""
    e = silver_events(spark, d)
    name = lambda i: F.get(F.array(*map(F.lit, NAMES)), i.cast("int"))
    documents = e.where("type = 'view'").select(*DAY, "ord", F.lit("document").alias("type"), F.concat(name(F.get_json_object("metadata", "$.k").try_cast("int") % 7), F.lit("-abc")).alias("norm"))
    keywords = e.where("type = 'error'").select(*DAY, "ord", F.lit("keyword").alias("type"), F.concat(F.lit("the-"), name(F.col("ord") % 5)).alias("norm"))
    return A.matching(documents, keywords).select(*DAY, "ord")


@query(
    f"""WITH t AS (SELECT event_id, event_type || 'Flow ' || ({_NAMES})[event_id % 7 + 1] || 'Id' || event_id || 'Go É caféBar' AS t FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(t)), '[^a-z0-9]+'), lambda x: length(x) >= 2)
  || list_filter(regexp_split_to_array(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9é]+'), lambda x: length(x) >= 2 AND x <> 'cafébar'))), ',') AS tokens FROM t"""
)
def camel_tokens(spark, d):
    e = C.table(spark, d, "events")
    t = F.concat("event_type", F.lit("Flow "), F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 7).cast("int")), F.lit("Id"), F.col("event_id").cast("string"), F.lit("Go É caféBar"))
    return e.select("event_id", F.array_join(F.array_sort(T.tokens(t, T.fold(t))), ",").alias("tokens"))


_PAIRS = C.SQL["eval_pairwise"]
_MEANS = "SELECT '{0}' AS predictor, count(*) AS sessions, avg(f1) AS f1, avg(false_merge) AS false_merge, avg(false_split) AS false_split, avg(ari) AS ari FROM ({1})"


@query(_MEANS.format("oracle", _PAIRS.replace("repository AS cluster", "type AS cluster")) + " UNION ALL " + _MEANS.format("per-repository", _PAIRS))
def eval_summary(spark, d):
    e = silver_events(spark, d).withColumn("ref", F.col("ord"))
    truth = e.select("session_id", "ref", F.col("type").alias("tag"))
    return V.summary(truth, {"oracle": V.oracle(truth), "per-repository": V.PREDICTORS["per-repository"](e)})


@query(
    f"""WITH {EV}, c AS (SELECT *, lag(type) OVER (PARTITION BY session_id ORDER BY ts_ms, ord) AS was FROM ev), f AS (SELECT * FROM c WHERE was IS NULL OR was <> type)
SELECT session_id, ord, type AS key, lead(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, ord) AS end_ms FROM f"""
)
def closed_spans(spark, d):
    samples = silver_events(spark, d).select("session_id", "ord", "ts_ms", F.col("type").alias("key"))
    return store.close_spans(samples, ["session_id"]).select("session_id", "ord", "key", "end_ms")


@query(f"WITH {HIST} SELECT CASE kind WHEN 'agent.session' THEN place WHEN 'terminal.command' THEN cwd ELSE path END AS path, count(*) AS n FROM hist WHERE ts_ms >= 1704844800000 AND kind IN ('agent.session', 'terminal.command', 'ide.file.saved') GROUP BY 1 ORDER BY n DESC, path LIMIT 5")
def work_path_ranking(spark, d):
    return store.work_paths(work_history(spark, d), 1_704_844_800_000, 5)


@query(
    f"""WITH {HIST}, f AS (SELECT CASE WHEN kind = 'browser.navigation' THEN 'url' WHEN kind = 'ide.file.saved' THEN 'file' WHEN kind = 'terminal.command' THEN CASE WHEN exit_code = 0 THEN 'command' ELSE 'error' END WHEN kind IN ('git.commit', 'git.branch.checkout') THEN 'commit'
    WHEN kind = 'manual.note' THEN 'note' WHEN kind = 'agent.session' THEN 'agent' WHEN kind = 'terminal.error_tail' THEN 'error' END AS fact,
  CASE kind WHEN 'browser.navigation' THEN title WHEN 'ide.file.saved' THEN 'file' || k % 9 || '.py' WHEN 'terminal.command' THEN cmd WHEN 'git.commit' THEN 'msg ' || k % 13 WHEN 'git.branch.checkout' THEN branch WHEN 'manual.note' THEN 'note ' || k % 17 WHEN 'agent.session' THEN title WHEN 'terminal.error_tail' THEN 'E' || k % 8 END AS label,
  coalesce(url, path) AS place, cwd FROM hist)
SELECT fact AS kind, label, coalesce(place, label) AS target, cwd AS detail, count(*) AS n FROM f WHERE fact IS NOT NULL GROUP BY ALL"""
)
def fact_counts(spark, d):
    return Q.facets(work_history(spark, d)).groupBy("kind", "label", "target", "detail").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT CASE WHEN session_id % 5 = 0 THEN 'replaced' ELSE type END AS type, count(*) AS n FROM ev GROUP BY 1")
def replaced_sessions(spark, d):
    """Every fifth session comes again, told anew: its stored rows go, the others stay."""
    e = silver_events(spark, d).select("session_id", "ord", "type")
    fresh = e.where("session_id % 5 = 0").withColumn("type", F.lit("replaced"))
    return store.replace_sessions(e, fresh, ["session_id"]).groupBy("type").agg(F.count("*").alias("n"))
