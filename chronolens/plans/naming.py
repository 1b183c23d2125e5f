"""Queries of names, typed metadata, stand-up lines with what was produced, and search by context, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import corpus as Q
from ..operators import engine
from ..operators import resume as R
from ..sources import readers
from ..sources.adapters import silver_events, table, work_history
from . import export
from .cards import HIST
from .catalogue import _CORPUS, _IDF, _LEX, _NOW, _SCORE, DAY, EV, SQL, TERMS, _search_rows, query

_APPS = ["com.apple.Safari", "Code.exe", "olk.exe", "unknown.app", ""]
_SOURCES = ["app", "agent", "external", "terminal", "git"]
_MAP = "CASE app " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in engine.APP_NAMES.items()) + " END"


@query(
    f"""WITH {EV}, a AS (SELECT ord, ({_APPS})[ord % 5 + 1] AS app, ({_SOURCES})[ord // 5 % 5 + 1] AS source, CASE WHEN ord % 3 > 0 THEN 'Shown ' || ord % 3 END AS shown FROM ev)
SELECT ord, CASE source WHEN 'agent' THEN coalesce(shown, 'Claude Code') WHEN 'external' THEN 'Cockpit' WHEN 'terminal' THEN 'Terminal' WHEN 'git' THEN 'Git' ELSE CASE WHEN app = '' THEN coalesce(shown, 'System') ELSE coalesce({_MAP}, shown, app) END END AS name FROM a"""
)
def app_names(spark, d):
    """The name of every event's application, by source, id, and what is displayed."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    n = F.col("ord")
    e = silver_events(spark, d).select("ord", pick(_APPS, n % 5).alias("app"), pick(_SOURCES, F.floor(n / 5) % 5).alias("source"), F.when(n % 3 > 0, F.concat(F.lit("Shown "), (n % 3).cast("string"))).alias("app_display"))
    return e.select("ord", engine.app_name(e).alias("name"))


@query(
    f"""WITH {EV}, m AS (SELECT session_id, work_day, ord, ts_ms, ord % 6 AS v FROM ev),
l AS (SELECT *, CASE WHEN v IN (0, 1, 2, 3) THEN 'make ' || v END AS cmd, CASE v WHEN 0 THEN 0 WHEN 2 THEN 2 END AS code FROM m)
SELECT session_id, work_day, ord, cmd AS label, 'exit ' || coalesce(CAST(code AS VARCHAR), '?') AS detail, CASE WHEN code = 0 THEN 'success' ELSE 'failure' END AS tone FROM l WHERE cmd IS NOT NULL"""
)
def typed_commands(spark, d):
    """Commands whose exit code is 0, `"0"`, 2, nothing, whose text is a number, and whose metadata is torn: only what is of its type counts."""
    n = F.col("ord") % 6
    made = ['{"commandRedacted":"make 0","exitCode":0}', '{"commandRedacted":"make 1","exitCode":"0"}', '{"commandRedacted":"make 2","exitCode":2}', '{"commandRedacted":"make 3"}', '{"commandRedacted":7,"exitCode":0}', '{"commandRedacted":"torn']
    e = silver_events(spark, d).withColumns({"type": F.lit("terminal.command"), "metadata": F.get(F.array(*map(F.lit, made)), n.cast("int")), "title": F.lit(None).cast("string"), "context": F.lit(1)})
    return R.lines(e).where("bucket = 'ran'").select(*DAY, "ord", "label", "detail", "tone")


_DETAILED = f"""WITH lines AS ({SQL['resume_lines']}), {EV},
c AS (SELECT session_id, work_day, count(*) * 90000 AS active_ms, max(repository) AS repository FROM ev GROUP BY 1, 2),
p AS (SELECT session_id, work_day, array_to_string((list(label ORDER BY ord))[1:2], ' · ') AS made FROM lines WHERE bucket = 'produced' GROUP BY 1, 2),
f AS (SELECT DISTINCT session_id, work_day FROM lines WHERE bucket = 'failure')
SELECT session_id, work_day, '- day (' || coalesce(nullif(repository, '') || ' · ', '') || 'main) — ' || CASE WHEN t < 60 THEN t || 'm' ELSE (t // 60) || 'h' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END
  || CASE WHEN made IS NULL AND f.session_id IS NULL THEN '' ELSE ' — ' || concat_ws(' · ', made, CASE WHEN f.session_id IS NOT NULL THEN 'blocked' END) END AS text
FROM (SELECT *, CAST(floor(active_ms / 60000.0 + 0.5) AS BIGINT) AS t FROM c) LEFT JOIN p USING (session_id, work_day) LEFT JOIN f USING (session_id, work_day)"""


@query(_DETAILED)
def detailed_standup(spark, d):
    """Each day as one context: where it was, how long, the first two things produced, and whether something failed."""
    card = R.capped(R.lines(work_history(spark, d, DAY).withColumn("context", F.lit(1))))
    e = silver_events(spark, d)
    c = e.groupBy(*DAY).agg(F.min("ts_ms").alias("start"), F.min("ord").alias("ord"), (F.count("*") * 90_000).alias("active_ms"), F.max("repository").alias("repository"))
    named = c.withColumns({"context": F.lit(1), "label": F.lit("day"), "branch": F.lit("main"), "project": F.lit(None).cast("string")})
    return export.standup_detailed(named, card)


_CTX_TOKENS = """ct AS (SELECT source AS context, list_distinct(list_filter(regexp_split_to_array(lower('The ' || source || ' licenseBook' || CASE WHEN ends_with(source, '1') THEN ' thsh-main' ELSE '' END), '[^a-z0-9]+') || CASE WHEN ends_with(source, '2') THEN ['license', 'book'] ELSE [] END, lambda x: length(x) >= 2)) AS ctokens
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"""
_HIT = lambda t: f"len(list_filter(ctokens, lambda x: starts_with(x, '{t}'))) > 0"
_CONTEXT = "(" + " + ".join(f"(CASE WHEN {_HIT(t)} THEN w{i} ELSE 0 END)" for i, t in enumerate(TERMS)) + ") / (w0 + w1 + w2)"


@query(
    f"""WITH {_CORPUS}, {_IDF}, {_LEX}, {_CTX_TOKENS}, s AS (SELECT doc_id, source, last_ms, round({_CONTEXT}, 9) AS context_score, round(least(1.0, {_SCORE} + 0.20 * {_CONTEXT}), 9) AS score FROM scored JOIN documents USING (doc_id) JOIN ct ON ct.context = source)
SELECT doc_id, context_score, score FROM s ORDER BY score DESC, last_ms DESC LIMIT 24"""
)
def context_search(spark, d):
    """As ranked_search, each document in the context of its source, whose name, branch and anchors match terms too."""
    docs = table(spark, d, "documents").where("source is not null")
    sources = docs.select(F.col("source").alias("context")).distinct()
    contexts = sources.select("context", F.lit("The").alias("label"), F.col("context").alias("repository"), F.when(F.endswith("context", F.lit("1")), "thsh-main").alias("branch"), F.lit("licensebook").alias("project"))
    anchors = sources.where(F.endswith("context", F.lit("2"))).select("context", F.lit("licenseBook").alias("value"))
    rows = Q.narrowed(_search_rows(spark, d), TERMS).drop("context").join(docs.select("doc_id", F.col("source").alias("context")), "doc_id")
    ranked = Q.rank(rows, TERMS, _NOW, context_tokens=Q.context_tokens(contexts, anchors))
    out = ranked.withColumns({"score": F.round("score", 9), "context_score": F.round("context_score", 9)})
    return out.orderBy(F.desc("score"), F.desc("last_ms")).limit(24).select("doc_id", "context_score", "score")


@query(
    f"""WITH {EV}, h AS (SELECT ev.ord, repository, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM ev JOIN events ON event_id = ev.ord),
a AS (
  SELECT ord, 0 AS rank, 'custom' AS type, 'alpha-' || k AS norm, 0.98 AS confidence FROM h UNION ALL SELECT ord, 1, 'issue', 'ef-' || k, 0.98 FROM h WHERE ord % 2 = 0
  UNION ALL SELECT ord, 2, 'issue', 'ef-' || k, 0.95 FROM h UNION ALL SELECT ord, 3, 'issue', 'ab-' || k, 0.95 FROM h UNION ALL SELECT ord, 4, 'issue', 'cd-' || k, 0.95 FROM h
  UNION ALL SELECT ord, 5, 'branch', 'fix-ab-' || k, 0.85 FROM h UNION ALL SELECT ord, 6, 'repository', repository, 0.5 FROM h WHERE repository IS NOT NULL UNION ALL SELECT ord, 7, 'project', 'proj-' || k, 0.9 FROM h
  UNION ALL SELECT ord, 8, 'document', 'b-test', 0.8 FROM h UNION ALL SELECT ord, 9, 'document', 'dir' || k, 0.7 FROM h)
SELECT ord, type, norm, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN type IN ('issue', 'worktree') THEN 'strong' WHEN type IN ('branch', 'project', 'document') THEN 'medium' ELSE 'weak' END AS strength
FROM a QUALIFY row_number() OVER (PARTITION BY ord, type, norm ORDER BY rank) = 1"""
)
def declared_anchors(spark, d):
    """Anchors that an event declares, issues in its title and texts, its project, branch, and documents by paths and folders; with their strength."""
    e = silver_events(spark, d)
    k = F.coalesce(F.get_json_object("metadata", "$.k").try_cast("int"), F.lit(0)).cast("string")
    said = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    declared = F.array(said("custom", F.concat(F.lit("Alpha "), k)), said("issue", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("EF-"), k))))
    made = F.struct(
        declared.alias("anchors"), F.concat(F.lit("fix/AB-"), k).alias("to"), F.concat(F.lit("see CD-"), k, F.lit(" in UTF-8")).alias("messageRedacted"), F.concat(F.lit("Proj "), k).alias("project"),
        F.lit("/a/b.test.md").alias("toPath"), F.lit("/a/c.rs").alias("fromPath"), F.concat(F.lit("/w/dir"), k).alias("directory"),
    )
    rows = A.event_anchors(e.withColumns({"title": F.concat(F.lit("EF-"), k), "metadata": F.to_json(made)}))
    return rows.select("ord", "type", "norm", "confidence", A.strength(F.col("type")).alias("strength"))


_STEP = """st AS (SELECT session_id, work_day, arg_max('note ' || k % 17, (ts_ms, ord)) FILTER (kind = 'manual.note') AS note, arg_max(cmd, (ts_ms, ord)) FILTER (kind = 'terminal.command' AND coalesce(exit_code, 1) <> 0) AS failing,
  arg_max(CAST(k % 4 AS VARCHAR), (ts_ms, ord)) FILTER (kind = 'git.status.summary' AND k % 4 > 0) AS dirty FROM hist GROUP BY 1, 2)"""
_SECTION = "string_agg('- ' || label || CASE WHEN bucket = 'ran' THEN ' (' || detail || ')' ELSE '' END, chr(10) ORDER BY ord) FILTER (bucket = '{0}')"


@query(
    f"""WITH lines AS ({SQL['resume_lines']}), res AS ({SQL['resume_resources']}), {HIST}, {_STEP},
c AS (SELECT session_id, work_day, max(end_ms) AS e, count(*) * 90000 AS active_ms FROM ev GROUP BY 1, 2),
l AS (SELECT session_id, work_day, {", ".join(f"'{title} :' || chr(10) || " + _SECTION.format(b) + f" AS {b}" for b, title in export.SECTIONS.items())} FROM lines GROUP BY 1, 2),
o AS (SELECT session_id, work_day, 'Open again :' || chr(10) || string_agg('- ' || kind || ' ' || target, chr(10) ORDER BY nth) AS again FROM res GROUP BY 1, 2),
t AS (SELECT *, CAST(floor(active_ms / 60000.0 + 0.5) AS BIGINT) AS m FROM c)
SELECT session_id, work_day, concat_ws(chr(10) || chr(10), 'Context : day' || chr(10) || 'Place : main' || chr(10) || 'Last activity : ' || strftime(make_timestamp((e + 3600000) * 1000), '%H:%M') || ' · '
  || CASE WHEN m < 60 THEN m || 'm' ELSE (m // 60) || 'h' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') END || ' active' || chr(10) || 'Apps : A → B', working, reading, ran, failure, produced,
  'Next : ' || coalesce(note, 'Fix the failing command: ' || failing, 'Commit or stash ' || dirty || CASE WHEN dirty = '1' THEN ' file' ELSE ' files' END), again) AS text
FROM t LEFT JOIN l USING (session_id, work_day) LEFT JOIN o USING (session_id, work_day) LEFT JOIN st USING (session_id, work_day)"""
)
def agent_briefs(spark, d):
    """The hand-over of every day, taken as one context."""
    h = work_history(spark, d, DAY).withColumn("context", F.lit(1))
    c = silver_events(spark, d).groupBy(*DAY).agg(F.max("end_ms").alias("end"), (F.count("*") * 90_000).alias("active_ms"), F.first("tz").alias("tz"))
    none = F.lit(None).cast("string")
    c = c.withColumns({"context": F.lit(1), "label": F.lit("day"), "project": none, "repository": none, "branch": F.lit("main"), "apps": F.array(F.lit("A"), F.lit("B"))})
    return export.agent_brief(c, R.capped(R.lines(h)), R.next_step(h), R.resources(h)).select(*DAY, "text")


@query(
    f"""WITH {EV} SELECT ord, CASE WHEN ord % 4 = 0 THEN 'own' ELSE type END AS bundle, CASE WHEN ord % 3 > 0 THEN CAST(ord AS VARCHAR) END AS pid, CASE WHEN ord % 4 < 3 THEN CAST(ord % 7 AS VARCHAR) END AS k FROM ev"""
)
def session_metadata(spark, d):
    """Application and process of every event inside its metadata, which keeps its own where it has them; torn metadata has nothing else."""
    n = F.col("ord")
    own = F.when(n % 4 == 0, F.concat(F.lit('{"bundleId": "own", "k": '), (n % 7).cast("string"), F.lit("}"))).when(n % 4 < 3, F.concat(F.lit('{"k": '), (n % 7).cast("string"), F.lit("}"))).otherwise("torn {")
    e = silver_events(spark, d).withColumns({"metadata": own, "pid": F.when(n % 3 > 0, n)})
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return readers.to_sessions(e, ["session_id"]).select("ord", get("bundleId").alias("bundle"), get("pid").alias("pid"), get("k").alias("k"))
