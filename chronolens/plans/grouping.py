"""The grouping engine and what follows it, on events that name one issue each: contexts are then what SQL can tell by hand, and everything behind them is held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answer, engine
from ..operators import evaluate as V
from ..operators import rhythm as P
from ..sources.adapters import silver_events
from ..sources.staging import staged
from . import export
from .catalogue import EV, HOUR, query

#: Activities end only where the issue changes.
CONFIG = engine.with_config(activity_gap=48 * HOUR, activity_longest=96 * HOUR)


def issue_events(spark: SparkSession, d: str) -> DataFrame:
    """All events, each titled by one of three issues, without a repository."""
    k = F.coalesce(F.get_json_object("metadata", "$.k").try_cast("int"), F.lit(0))
    e = silver_events(spark, d)
    return e.withColumns({"title": F.concat(F.lit("AB-"), (k % 3).cast("string")), "repository": F.lit(None).cast("string"), "metadata": F.lit("{}")})


def grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events, assignments and anchors."""
    e = issue_events(spark, d)
    anchors = staged(engine.all_anchors(e), "anchors")
    return e, staged(engine.assignments(e, CONFIG, anchors), "assigned"), anchors


def issue_contexts(spark: SparkSession, d: str) -> DataFrame:
    e, assigned, anchors = grouped(spark, d)
    return engine.contexts_frame(e, assigned, anchors)


#: g: events with their issue and activity (the number of the run of one issue in a day); acts; ctx: contexts as the engine numbers them, of two events at least.
GROUPED = f"""{EV},
i0 AS (SELECT ev.*, 'AB-' || (coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 3) AS issue FROM ev JOIN events ON event_id = ev.ord),
i1 AS (SELECT *, lag(issue) OVER (PARTITION BY session_id, work_day ORDER BY ts_ms, ord) AS p FROM i0),
g AS (SELECT *, sum(CASE WHEN issue IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, work_day ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS activity FROM i1),
acts AS (SELECT session_id, work_day, issue, activity, min(ts_ms) AS a, greatest(max(end_ms), min(ts_ms) + 30000) AS b, arg_min(type, (ts_ms, ord)) AS first_app FROM g GROUP BY 1, 2, 3, 4),
r AS (SELECT *, max(b) OVER (PARTITION BY session_id, work_day, issue ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM acts),
m AS (SELECT session_id, work_day, issue, sum(CASE WHEN reach IS NULL OR a > reach THEN b - a ELSE greatest(b - reach, 0) END) AS active_ms FROM r GROUP BY 1, 2, 3),
n AS (SELECT session_id, work_day, issue, min((ts_ms, ord)) AS seen, min(ts_ms) AS start, max(end_ms) AS "end", count(*) AS n_events, count(DISTINCT type) AS apps FROM g GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY session_id, work_day ORDER BY seen) AS context FROM n),
ctx AS (SELECT session_id, work_day, context, c.start, c."end", n_events, CAST(active_ms AS BIGINT) AS active_ms, issue, apps, lower(issue) AS key, context AS ord, false AS fallback FROM c JOIN m USING (session_id, work_day, issue) WHERE n_events >= 2)"""


@query(f'WITH {GROUPED} SELECT session_id, work_day, context, start, "end", n_events, active_ms, issue AS label, fallback, issue, round(least(1.0, 0.3 + 0.25 + 0.1 * least(apps, 4)), 6) AS confidence, key FROM ctx')
def grouped_contexts(spark, d):
    """Contexts of every day: spans, union of activities, name, confidence."""
    return issue_contexts(spark, d).select("session_id", "work_day", "context", "start", "end", "n_events", "active_ms", "label", "fallback", "issue", F.round("confidence", 6).alias("confidence"), "key")


@query(f"WITH {GROUPED} SELECT session_id, work_day, CAST(activity AS BIGINT) AS activity, issue || ' — ' || first_app AS label FROM acts")
def grouped_activities(spark, d):
    """Activities of every day by name."""
    return engine.label_activities(*grouped(spark, d))


@query(f"WITH {GROUPED} SELECT g.session_id, g.work_day, g.ord, CAST(activity AS BIGINT) AS activity, ctx.context FROM g LEFT JOIN ctx USING (session_id, work_day, issue)")
def grouped_events(spark, d):
    """The activity and context of every event; a context of a single event is none."""
    return grouped(spark, d)[1].select("session_id", "work_day", "ord", "activity", "context")


@query(f"""WITH {GROUPED}, l AS (SELECT g.* FROM g LEFT JOIN ctx USING (session_id, work_day, issue) WHERE ctx.context IS NULL)
SELECT session_id, work_day, ord, CAST(row_number() OVER (PARTITION BY session_id, work_day ORDER BY ts_ms DESC, ord DESC) AS INTEGER) AS nth FROM l""")
def grouped_loose(spark, d):
    """Events in no context, the newest first."""
    e, assigned, _ = grouped(spark, d)
    return answer.loose_events(e, assigned).select("session_id", "work_day", "ord", "nth")


@query(f"""WITH {GROUPED} SELECT session_id, work_day, context, CAST(row_number() OVER (PARTITION BY session_id, work_day ORDER BY active_ms DESC, context) AS INTEGER) AS place FROM ctx""")
def grouped_order(spark, d):
    return engine.ordered(issue_contexts(spark, d)).select("session_id", "work_day", "context", "place")


_S, _E = 'CAST((start + 3600000) // 3600000 % 24 AS INTEGER)', 'CAST(("end" + 3600000) // 3600000 % 24 AS INTEGER)'


@query(
    f"""WITH {GROUPED} SELECT session_id, work_day, CAST(sum(active_ms) AS BIGINT) AS active_ms, count(*) AS n_contexts, CAST(round(quantile_cont(active_ms, 0.5)) AS BIGINT) AS median_ms,
  count(*) FILTER (active_ms >= 1500000) AS deep_n, CAST(coalesce(sum(active_ms) FILTER (active_ms >= 1500000), 0) AS BIGINT) AS deep_ms, count(*) - 1 AS switches,
  arg_min({_S}, (start, ord)) AS first_hour, arg_max({_E}, (start, ord)) AS last_hour, 1.0 AS named_share FROM ctx GROUP BY 1, 2"""
)
def grouped_rhythm(spark, d):
    """The rhythm of every day, on the engine's contexts."""
    return P.day_rhythm(issue_contexts(spark, d))


@query(
    f"""WITH {GROUPED}, moves AS (SELECT session_id, key, nk AS next_key, count(*) AS n FROM (SELECT *, lead(key) OVER (PARTITION BY session_id, work_day ORDER BY start, ord) AS nk FROM ctx) WHERE nk <> key GROUP BY 1, 2, 3) SELECT * FROM moves"""
)
def grouped_transitions(spark, d):
    return P.transitions(issue_contexts(spark, d))


@query(
    f"""WITH {GROUPED}, mv AS (SELECT session_id, count(*) AS n FROM (SELECT *, lead(key) OVER (PARTITION BY session_id, work_day ORDER BY start, ord) AS nk FROM ctx) WHERE nk <> key GROUP BY 1 HAVING count(*) >= 4),
h AS (SELECT session_id, key, count(*) AS starts, count(*) FILTER ({_S} IN (13, 14, 15)) AS hour_n, max("end") AS last_active FROM ctx GROUP BY 1, 2)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY 0.15 * greatest(hour_n / starts, 0.15) DESC, last_active DESC, key) AS INTEGER) AS rank, key, 0.15 * greatest(hour_n / starts, 0.15) AS score, CAST(0 AS BIGINT) AS transition_n, CAST(hour_n AS BIGINT) AS hour_n
FROM h JOIN mv USING (session_id) WHERE hour_n > 0 QUALIFY rank <= 3"""
)
def grouped_prediction(spark, d):
    """What the engine's contexts suggest at two in the afternoon, by the hour alone."""
    return P.predicted(issue_contexts(spark, d), 1_706_745_600_000, 14)["suggestions"]


@query(
    f"""WITH {GROUPED} SELECT session_id, work_day, string_agg(key || ' (' || CASE WHEN t < 60 THEN t || 'm' ELSE (t // 60) || 'h' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END || ')', '; ' ORDER BY start, ord) AS line
FROM (SELECT *, CAST(floor(active_ms / 60000.0 + 0.5) AS BIGINT) AS t FROM ctx WHERE active_ms > 0) GROUP BY 1, 2"""
)
def grouped_standup(spark, d):
    """Stand-up lines of the engine's contexts."""
    return export.standup(issue_contexts(spark, d))


@query(
    f"""WITH {GROUPED}, busy AS (SELECT session_id FROM ev WHERE work_day = DATE '2024-01-20' GROUP BY 1 HAVING count(*) > 40),
e AS (SELECT * FROM ctx WHERE work_day < DATE '2024-01-20' AND session_id NOT IN (SELECT session_id FROM busy))
SELECT session_id, work_day, key, active_ms FROM (SELECT *, max(work_day) OVER (PARTITION BY session_id) AS last FROM e) WHERE work_day = last AND active_ms > 0
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY "end" DESC, start DESC, ord DESC) = 1"""
)
def grouped_brief(spark, d):
    """Where each session left off before the 20th, by the engine's contexts."""
    return answer.morning_brief(issue_contexts(spark, d), issue_events(spark, d), "2024-01-20").select("session_id", "work_day", "key", "active_ms")


@query(
    f"""WITH {GROUPED}, k AS (SELECT g.session_id, CAST(g.ord AS VARCHAR) AS ref, issue AS tag, CASE WHEN ctx.context IS NOT NULL THEN CAST(work_day AS VARCHAR) || '.' || ctx.context ELSE '?' || g.ord END AS cluster FROM g LEFT JOIN ctx USING (session_id, work_day, issue)),
cells AS (SELECT session_id, tag, cluster, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT session_id, tag, count(*) AS clusters, sum(n) AS size, max(n) AS most FROM cells GROUP BY 1, 2)
SELECT session_id, CAST(0 AS BIGINT) AS merged, count(*) FILTER (clusters > 1) AS split, CAST(sum(clusters) - count(*) AS BIGINT) AS delta, avg(most / size) AS coverage, 1.0 AS purity FROM t GROUP BY 1"""
)
def grouped_evaluation(spark, d):
    """The engine as a predictor of the issues over whole sessions: it never merges two, and splits each by days."""
    e, assigned, _ = grouped(spark, d)
    e = e.withColumn("ref", F.col("ord").cast("string"))
    truth = e.select("session_id", "ref", F.col("title").alias("tag"))
    return V.split_merge(V.contingency(truth, V.from_assignments(e, assigned)))


def _rounds(n: int) -> str:
    """Greedy rounds: of what is left, pairs that are the first both of their tag and of their cluster."""
    out, left = [], "k"
    order = "n DESC, tag, cluster"
    for i in range(n):
        out.append(
            f"p{i} AS (SELECT session_id, tag, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tag ORDER BY {order}) AS a, row_number() OVER (PARTITION BY session_id, cluster ORDER BY {order}) AS b FROM {left}) WHERE a = 1 AND b = 1), "
            f"l{i} AS (SELECT * FROM {left} x WHERE NOT EXISTS (SELECT 1 FROM p{i} p WHERE p.session_id = x.session_id AND (p.tag = x.tag OR p.cluster = x.cluster)))"
        )
        left = f"l{i}"
    return ", ".join(out)


@query(
    f"""WITH {EV}, k AS (SELECT session_id, type AS tag, repository AS cluster, count(*) AS n FROM ev GROUP BY ALL), {_rounds(5)}
SELECT session_id, tag, cluster, n FROM ({" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(5))})"""
)
def eval_matches(spark, d):
    """Types of events and repositories of each session matched one to one by how many events they share."""
    e = silver_events(spark, d).withColumn("ref", F.col("ord"))
    return V.matches(V.contingency(e.select("session_id", "ref", F.col("type").alias("tag")), V.PREDICTORS["per-repository"](e)))
