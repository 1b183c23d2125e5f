"""The query catalogue: each operator over the driver's tables, with the equal DuckDB SQL.

Thresholds are scaled to the tables' gaps of hours; they are parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as C
from ..operators import corpus as Q
from ..operators import evaluate as V
from ..operators import intervals as I
from ..operators import projects as H
from ..operators import redact as D
from ..operators import rhythm as P
from ..sources.adapters import silver_events, table

HOUR = C.HOUR_MS
DAY = ["session_id", "work_day"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = """
ev0 AS (SELECT user_id AS session_id, event_id AS ord, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 + CAST(floor(coalesce(value, 0) * 60000) AS BIGINT) AS end_ms, event_type AS type,
  'repo-' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS repository,
  CASE event_type WHEN 'error' THEN 85 WHEN 'purchase' THEN 90 WHEN 'signup' THEN 70 WHEN 'click' THEN 45 WHEN 'view' THEN 30 END AS importance FROM events),
ev AS (SELECT *, CAST(DATE '1970-01-01' + CAST(floor((ts_ms + 3600000 - 14400000) / 86400000.0) AS INTEGER) AS DATE) AS work_day, CAST((ts_ms + 3600000) // 3600000 % 24 AS INTEGER) AS hour FROM ev0)"""
CTX = (
    EV
    + """,
c1 AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, work_day, type ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
c2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts_ms > reach + 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, work_day, type ORDER BY ts_ms, ord) AS island FROM c1),
ctx AS (SELECT session_id, work_day, type AS key, min(ts_ms) AS start, max(end_ms) AS "end", max(end_ms) - min(ts_ms) AS active_ms, min(ord) AS ord, type = 'view' AS fallback FROM c2 GROUP BY session_id, work_day, type, island)"""
)
H_START, H_END = 'CAST((start + 3600000) // 3600000 % 24 AS INTEGER)', 'CAST(("end" + 3600000) // 3600000 % 24 AS INTEGER)'


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type as contexts: what the grouping engine gives, in a form SQL has too."""
    e = I.islands(silver_events(spark, d), [*DAY, "type"], "ts_ms", "end_ms", ["ord"], HOUR)
    c = e.groupBy(*DAY, F.col("type").alias("key"), "island").agg(F.min("ts_ms").alias("start"), F.max("end_ms").alias("end"), F.min("ord").alias("ord"), F.first("tz").alias("tz"))
    return c.withColumns({"active_ms": F.col("end") - F.col("start"), "fallback": F.col("key") == "view"}).drop("island")


@query(
    f"""WITH {EV}, s AS (SELECT session_id, work_day, ts_ms AS a, greatest(end_ms, ts_ms + 30000) AS b FROM ev),
r AS (SELECT *, max(b) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r),
m AS (SELECT session_id, work_day, k, max(b) - min(a) AS ms FROM g GROUP BY ALL)
SELECT session_id, work_day, CAST(sum(ms) AS BIGINT) AS covered_ms FROM m GROUP BY ALL"""
)
def active_time_by_day(spark, d):
    e = silver_events(spark, d)
    return I.covered_ms(e.select(*DAY, F.col("ts_ms").alias("start"), F.col("end_ms").alias("end")), DAY)


@query(f"WITH {EV} SELECT work_day, count(*) AS events, min(ts_ms) AS first_ms, max(coalesce(end_ms, ts_ms)) AS last_ms FROM ev GROUP BY work_day ORDER BY work_day DESC LIMIT 400")
def day_summary(spark, d):
    from ..sources.store import days

    return days(silver_events(spark, d), 400)


@query(f"WITH {EV} SELECT ord, session_id, ts_ms, type FROM ev ORDER BY ts_ms DESC, ord DESC LIMIT 500")
def recent_events_topk(spark, d):
    from ..sources.store import recent

    return recent(silver_events(spark, d), 500).select("ord", "session_id", "ts_ms", "type")


@query(f"WITH {EV} SELECT ord, ts_ms, type FROM ev WHERE work_day = DATE '2024-01-15' ORDER BY ts_ms, ord LIMIT 20000")
def events_for_day(spark, d):
    from ..sources.store import for_day

    return for_day(silver_events(spark, d), "2024-01-15", 20_000).select("ord", "ts_ms", "type")


@query(f"WITH {EV} SELECT repository AS path, count(*) AS n FROM ev WHERE ts_ms >= 1704844800000 AND type IN ('click', 'view', 'purchase') AND repository IS NOT NULL GROUP BY 1 ORDER BY n DESC, path LIMIT 5")
def work_paths_topk(spark, d):
    from ..sources.store import work_paths

    e = silver_events(spark, d).where(F.col("type").isin("click", "view", "purchase"))
    return work_paths(e, 1_704_844_800_000, 5, [F.col("repository")])


@query(f"WITH {EV} SELECT work_day, count(*) AS n FROM ev GROUP BY 1")
def count_for_day(spark, d):
    return silver_events(spark, d).groupBy("work_day").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT CASE WHEN end_ms - ts_ms < 5000 THEN 5 WHEN end_ms - ts_ms < 60000 THEN 15 ELSE 30 END AS span_importance, importance, count(*) AS n FROM ev GROUP BY 1, 2")
def importance_profile(spark, d):
    from ..functions.events import span_importance

    e = silver_events(spark, d)
    return e.groupBy(span_importance(F.col("end_ms") - F.col("ts_ms")).alias("span_importance"), "importance").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT type, hour, count(*) AS n FROM ev GROUP BY 1, 2")
def hour_histogram(spark, d):
    e = silver_events(spark, d)
    return e.groupBy("type", C.hour_of(F.col("ts_ms"), F.col("tz")).alias("hour")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {CTX}, s AS (SELECT *, unnest(range(start, "end", 3600000)) AS t FROM ctx WHERE "end" > start)
SELECT session_id, CAST((t + 3600000) // 3600000 % 24 AS INTEGER) AS hour, CAST(round(sum(least(3600000, "end" - t) * (active_ms / ("end" - start)))) AS BIGINT) AS active_ms FROM s GROUP BY 1, 2"""
)
def active_by_hour(spark, d):
    return P.active_by_hour(contexts(spark, d), ["session_id"])


_RHYTHM = f"""days AS (SELECT session_id, work_day, CAST(sum(active_ms) AS BIGINT) AS active_ms, count(*) AS n_contexts, CAST(round(quantile_cont(active_ms, 0.5)) AS BIGINT) AS median_ms,
  count(*) FILTER (active_ms >= 1500000) AS deep_n, CAST(coalesce(sum(active_ms) FILTER (active_ms >= 1500000), 0) AS BIGINT) AS deep_ms, count(*) - 1 AS switches,
  arg_min({H_START}, (start, ord)) AS first_hour, arg_max({H_END}, (start, ord)) AS last_hour,
  CASE WHEN sum(active_ms) > 0 THEN coalesce(sum(active_ms) FILTER (NOT fallback), 0) / sum(active_ms) ELSE 0.0 END AS named_share FROM ctx GROUP BY 1, 2)"""


@query(f"WITH {CTX}, {_RHYTHM} SELECT * FROM days")
def day_rhythm(spark, d):
    return P.day_rhythm(contexts(spark, d))


@query(
    f"""WITH {CTX}, {_RHYTHM} SELECT session_id, count(*) AS n_days, """
    + ", ".join(f"CAST(round(quantile_cont({c}, 0.5)) AS BIGINT) AS typical_{c}" for c in ("active_ms", "n_contexts", "deep_ms", "switches", "first_hour", "last_hour"))
    + " FROM days GROUP BY 1"
)
def typical_day(spark, d):
    return P.typical_day(P.day_rhythm(contexts(spark, d)))


@query(
    f"""WITH {CTX}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, work_day ORDER BY start, ord) AS nth, {H_START} AS h FROM ctx),
k AS (SELECT session_id, work_day, h AS hour, count(*) AS n, min(nth) AS seen FROM n WHERE nth > 1 GROUP BY ALL)
SELECT session_id, work_day, hour, n FROM k QUALIFY row_number() OVER (PARTITION BY session_id, work_day ORDER BY n DESC, seen) = 1"""
)
def busiest_switch_hour(spark, d):
    return P.busiest_switch_hour(contexts(spark, d))


_OPEN = "sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING)"
_REACH = "max(end_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach"


@query(f"WITH {EV}, r AS (SELECT *, {_REACH} FROM ev) SELECT session_id, ord, CAST({_OPEN.format(cond='reach IS NULL OR ts_ms > reach + 21600000')} AS BIGINT) AS bucket FROM r")
def time_gap_buckets(spark, d):
    return I.gap_buckets(silver_events(spark, d), ["session_id"], 6 * HOUR).select("session_id", "ord", "bucket")


@query(
    f"""WITH {EV}, r AS (SELECT *, {_REACH}, last_value(repository IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lr FROM ev)
SELECT session_id, ord, CAST({_OPEN.format(cond='reach IS NULL OR ts_ms > reach + 21600000 OR coalesce(repository <> lr, false)')} AS BIGINT) AS bucket FROM r"""
)
def repo_gap_buckets(spark, d):
    return I.repo_gap_buckets(silver_events(spark, d), ["session_id"], 6 * HOUR).select("session_id", "ord", "bucket")


@query(
    f"""WITH {EV}, l AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, ord) AS p FROM ev),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_ms > p + 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT session_id, min(ts_ms) AS start, max(ts_ms) AS "end", count(*) AS n FROM g GROUP BY session_id, k"""
)
def bursts(spark, d):
    return I.bursts(silver_events(spark, d), ["session_id"], 4 * HOUR)


@query(
    f"""WITH {EV}, s AS (SELECT session_id, work_day, ts_ms AS a, greatest(end_ms, ts_ms + 60000) AS b FROM ev),
r AS (SELECT *, max(b) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, work_day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT session_id, work_day, CAST(island AS BIGINT) AS island, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY session_id, work_day, island"""
)
def merged_spans_tolerance(spark, d):
    return H.today_spans(silver_events(spark, d), DAY, 2 * HOUR)


_RUN = "lag({c}) OVER (PARTITION BY session_id ORDER BY ts_ms, ord)"


@query(
    f"""WITH {EV}, l AS (SELECT *, {_RUN.format(c='type')} AS p, {_RUN.format(c='ord')} AS po FROM ev),
g AS (SELECT *, sum(CASE WHEN po IS NULL OR type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms, ord ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT session_id, CAST(run AS BIGINT) AS run, type AS value, min(ts_ms) AS start, max(end_ms) AS "end", count(*) AS n FROM g GROUP BY session_id, run, type"""
)
def run_collapse(spark, d):
    return I.run_collapse(silver_events(spark, d), ["session_id"], F.col("type"))


@query(f"WITH {EV}, l AS (SELECT *, {_RUN.format(c='repository')} AS p, {_RUN.format(c='ord')} AS po FROM ev) SELECT session_id, ord, repository FROM l WHERE po IS NULL OR repository IS DISTINCT FROM p")
def status_change_only(spark, d):
    return I.changes_only(silver_events(spark, d), ["session_id"], F.col("repository")).select("session_id", "ord", "repository")


_INT = """obs AS (SELECT session_id, work_day, key, p AS left_at, start AS returned_at, start - p AS away_ms, active_ms AS resumed_ms
  FROM (SELECT *, lag("end") OVER (PARTITION BY session_id, work_day, key ORDER BY start, ord) AS p FROM ctx) WHERE start > p)"""


@query(f"WITH {CTX}, {_INT} SELECT * FROM obs")
def interruptions(spark, d):
    return P.interruptions(contexts(spark, d))


@query(
    f"""WITH {CTX}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id, work_day ORDER BY start DESC, ord DESC) = 1 AS last, count(*) OVER (PARTITION BY session_id, work_day, key) AS times FROM ctx),
s AS (SELECT session_id, count(DISTINCT key) FILTER (NOT last) AS left_n, count(DISTINCT key) FILTER (times > 1 AND NOT last) AS returned_n FROM m GROUP BY 1)
SELECT *, CASE WHEN left_n > 0 THEN returned_n / left_n ELSE 0.0 END AS rate FROM s"""
)
def return_rate(spark, d):
    return P.return_rate(contexts(spark, d))


@query(f"WITH {CTX}, {_INT} SELECT session_id, key, count(*) AS n, CAST(round(quantile_cont(away_ms, 0.5)) AS BIGINT) AS median_away_ms FROM obs GROUP BY 1, 2 HAVING count(*) >= 3")
def per_key_median(spark, d):
    return P.return_medians(P.interruptions(contexts(spark, d)))


_MOVES = """moves AS (SELECT session_id, key, nk AS next_key, count(*) AS n FROM (SELECT *, lead(key) OVER (PARTITION BY session_id, work_day ORDER BY start, ord) AS nk FROM ctx) WHERE nk <> key GROUP BY 1, 2, 3)"""


@query(f"WITH {CTX}, {_MOVES} SELECT * FROM moves")
def transitions(spark, d):
    return P.transitions(contexts(spark, d))


@query(
    f"""WITH {CTX}, {_MOVES}, ok AS (SELECT session_id FROM moves GROUP BY 1 HAVING sum(n) >= 4), cur AS (SELECT session_id, arg_max(key, (start, ord)) AS from_key FROM ctx GROUP BY 1),
fn AS (SELECT session_id, key AS from_key, sum(n) AS from_n FROM moves GROUP BY 1, 2),
h AS (SELECT session_id, key, count(*) AS starts, count(*) FILTER ({H_START} IN (9, 10, 11)) AS hour_n, max("end") AS last_active FROM ctx GROUP BY 1, 2),
f AS (SELECT h.*, from_key, coalesce(m.n, 0) AS transition_n, greatest(coalesce(m.n / from_n, 0), 0.15) * greatest(hour_n / starts, 0.15) AS score
  FROM h JOIN ok USING (session_id) JOIN cur USING (session_id) LEFT JOIN moves m ON m.session_id = h.session_id AND m.key = from_key AND m.next_key = h.key LEFT JOIN fn USING (session_id, from_key)
  WHERE h.key <> from_key AND (coalesce(m.n, 0) > 0 OR hour_n > 0))
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC, last_active DESC, key) AS INTEGER) AS rank, key, score, transition_n, hour_n FROM f
QUALIFY rank <= 3"""
)
def suggest_next(spark, d):
    c = contexts(spark, d)
    current = c.groupBy("session_id").agg(F.max_by("key", F.struct("start", "ord")).alias("from_key"))
    return P.suggest_next(c, current, 10)


@query(
    f"""WITH {CTX}, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "end" DESC, ord) = 1 AS latest FROM ctx),
cur AS (SELECT session_id, key AS current, active_ms AS cur_ms FROM m WHERE latest), rest AS (SELECT * FROM m WHERE NOT latest QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY active_ms DESC, ord) = 1)
SELECT session_id, current, key AS established, 1706745600000 - "end" AS away_ms FROM cur JOIN rest USING (session_id) WHERE active_ms > cur_ms AND 1706745600000 - "end" >= 900000"""
)
def drift(spark, d):
    return P.detect_drift(contexts(spark, d), 1_706_745_600_000)


@query(
    f"""WITH {EV}, g AS (SELECT *, lead(ts_ms) OVER (PARTITION BY session_id, work_day ORDER BY ts_ms, ord) - ts_ms AS gap FROM ev),
f AS (SELECT session_id, work_day, hour FROM g WHERE hour BETWEEN 11 AND 14 AND gap >= 1200000 QUALIFY row_number() OVER (PARTITION BY session_id, work_day ORDER BY gap DESC, ts_ms) = 1),
h AS (SELECT session_id, CASE WHEN count(*) >= 3 THEN list_sort(list(hour))[count(*) // 2 + 1] ELSE 12 END AS hour FROM f GROUP BY 1)
SELECT session_id, CAST(coalesce(hour, 12) AS INTEGER) AS hour FROM (SELECT DISTINCT session_id FROM ev) LEFT JOIN h USING (session_id)"""
)
def lunch_hour(spark, d):
    return P.lunch_hour(silver_events(spark, d))


@query(
    f"""WITH {EV}, r AS (SELECT session_id AS s, ord, type AS tag, repository AS cluster FROM ev), k AS (SELECT s, tag, cluster, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT s, sum(n * (n - 1) / 2) AS truth_pairs FROM (SELECT s, tag, sum(n) AS n FROM k GROUP BY ALL) GROUP BY 1), p AS (SELECT s, sum(n * (n - 1) / 2) AS pred_pairs FROM (SELECT s, cluster, sum(n) AS n FROM k GROUP BY ALL) GROUP BY 1),
c AS (SELECT s, sum(n * (n - 1) / 2) AS tp, sum(n) AS events FROM k GROUP BY 1),
m AS (SELECT s AS session_id, CAST(tp AS DOUBLE) AS tp, CAST(events AS BIGINT) AS events, CAST(truth_pairs AS DOUBLE) AS truth_pairs, CAST(pred_pairs AS DOUBLE) AS pred_pairs,
  CASE WHEN pred_pairs > 0 THEN tp / pred_pairs ELSE 0.0 END AS precision, CASE WHEN truth_pairs > 0 THEN tp / truth_pairs ELSE 0.0 END AS recall FROM c JOIN t USING (s) JOIN p USING (s))
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, CASE WHEN pred_pairs > 0 THEN 1 - precision ELSE 0.0 END AS false_merge, 1 - recall AS false_split,
  CASE WHEN events > 1 AND (truth_pairs + pred_pairs) / 2 <> truth_pairs * pred_pairs / (events * (events - 1) / 2) THEN (tp - truth_pairs * pred_pairs / (events * (events - 1) / 2)) / ((truth_pairs + pred_pairs) / 2 - truth_pairs * pred_pairs / (events * (events - 1) / 2)) ELSE 1.0 END AS ari FROM m"""
)
def eval_pairwise(spark, d):
    e = silver_events(spark, d).withColumn("ref", F.col("ord"))
    return V.pairwise(V.contingency(e.select("session_id", "ref", F.col("type").alias("tag")), V.PREDICTORS["per-repository"](e)))


@query(
    f"""WITH {EV}, k AS (SELECT session_id, type AS tag, repository AS cluster, count(*) AS n FROM ev GROUP BY ALL),
b AS (SELECT session_id, tag, count(*) AS clusters, sum(n) AS size, arg_max(cluster, (n, cluster)) AS bc, max(n) AS bn FROM k GROUP BY 1, 2), c AS (SELECT session_id, cluster, count(*) AS tags, sum(n) AS csize FROM k GROUP BY 1, 2),
t AS (SELECT b.session_id, count(*) FILTER (clusters > 1) AS split, count(*) AS n_tags, avg(bn / size) AS coverage, avg(bn / csize) AS purity FROM b JOIN c ON b.session_id = c.session_id AND bc = c.cluster GROUP BY 1)
SELECT session_id, count(*) FILTER (tags > 1) AS merged, any_value(split) AS split, count(*) - any_value(n_tags) AS delta, any_value(coverage) AS coverage, any_value(purity) AS purity FROM c JOIN t USING (session_id) GROUP BY 1"""
)
def eval_split_merge(spark, d):
    e = silver_events(spark, d).withColumn("ref", F.col("ord"))
    return V.split_merge(V.contingency(e.select("session_id", "ref", F.col("type").alias("tag")), V.PREDICTORS["per-repository"](e)))


@query(f"WITH {EV} SELECT session_id, ts_ms, type, count(*) AS n FROM (SELECT DISTINCT session_id, ts_ms, type, ord FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev)) GROUP BY ALL")
def dedupe_ingest(spark, d):
    e = silver_events(spark, d)
    return e.union(e).dropDuplicates(["ord"]).groupBy("session_id", "ts_ms", "type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EV}, p AS (SELECT session_id, ts_ms AS a, ts_ms + 7200000 AS b FROM ev WHERE type = 'signup')
SELECT session_id, ord FROM ev WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session_id = ev.session_id AND ev.ts_ms >= a AND ev.ts_ms < b)"""
)
def pause_gate(spark, d):
    e = silver_events(spark, d)
    pauses = e.where("type = 'signup'").select("session_id", F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + 2 * HOUR).alias("until_ms"))
    return I.pause_gate(e, pauses, ["session_id"]).select("session_id", "ord")


@query(
    f"""WITH {CTX} SELECT session_id, work_day, string_agg(key || ' (' || CASE WHEN m < 60 THEN m || 'm' ELSE (m // 60) || 'h' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') END || ')', '; ' ORDER BY start, ord) AS line
FROM (SELECT *, CAST(floor(active_ms / 60000.0 + 0.5) AS BIGINT) AS m FROM ctx WHERE active_ms > 0) GROUP BY 1, 2"""
)
def standup_lines(spark, d):
    from .export import standup

    return standup(contexts(spark, d))


@query(
    f"""WITH {CTX} SELECT session_id, key, count(*) AS n, CAST(sum(active_ms) AS BIGINT) AS active_ms FROM ctx WHERE start < 1705363200000 AND "end" >= 1705276800000 GROUP BY 1, 2"""
)
def window_overlap_rollup(spark, d):
    c = contexts(spark, d).where((F.col("start") < 1_705_363_200_000) & (F.col("end") >= 1_705_276_800_000))
    return c.groupBy("session_id", "key").agg(F.count("*").alias("n"), F.sum("active_ms").alias("active_ms"))


@query(
    f"""WITH {EV} SELECT session_id, repository, max(ts_ms) AS last_ms, arg_max(type, (ts_ms, ord)) AS last_type, arg_max(ord, (ts_ms, ord)) FILTER (importance >= 80) AS last_important, count(*) AS n_events,
  count(DISTINCT work_day) FILTER (work_day > DATE '2024-01-23' AND work_day <= DATE '2024-01-30') AS days_7, CAST(row_number() OVER (PARTITION BY session_id ORDER BY max(ts_ms) DESC, repository) AS INTEGER) AS rank
FROM ev GROUP BY session_id, repository QUALIFY rank <= 6"""
)
def home_projects(spark, d):
    folded = H.project_fold(silver_events(spark, d), F.lit("2024-01-30").cast("date"), ["session_id", "repository"])
    return H.top_projects(folded, ["session_id"])


@query(
    f"""WITH {EV}, f AS (SELECT session_id, repository, max(ts_ms) AS last_ms, count(*) AS n_events, count(DISTINCT work_day) FILTER (work_day > DATE '2024-01-23' AND work_day <= DATE '2024-01-30') AS days_7 FROM ev GROUP BY 1, 2)
SELECT session_id, 'main' AS note, arg_max(repository, (days_7, last_ms)) AS repository FROM f WHERE days_7 >= 3 GROUP BY 1
UNION ALL SELECT session_id, 'paused', repository FROM f WHERE (1706745600000 - last_ms) / 86400000.0 BETWEEN 7 AND 30 AND n_events >= 5"""
)
def week_notes(spark, d):
    folded = H.project_fold(silver_events(spark, d), F.lit("2024-01-30").cast("date"), ["session_id", "repository"])
    return H.week_notes(folded, 1_706_745_600_000, ["session_id"])


_PATHS = r"paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "").alias("path"))


@query(
    f"""WITH {_PATHS}, roots AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM paths)
SELECT root FROM roots r WHERE root <> '' AND NOT EXISTS (SELECT 1 FROM roots o WHERE starts_with(o.root, r.root || '/'))"""
)
def project_roots(spark, d):
    return H.project_roots(_paths(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")))


@query(
    f"""WITH {_PATHS}, roots AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM paths)
SELECT page_id, path, (SELECT arg_max(root, length(root)) FROM roots WHERE path = root OR starts_with(path, root || '/')) AS root FROM paths"""
)
def path_owner(spark, d):
    roots = _paths(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()
    return H.owners(_paths(spark, d), roots).select("page_id", "path", "root")


@query(r"SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) NOT LIKE 'localhost%' GROUP BY 1")
def host_anchor(spark, d):
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return table(spark, d, "pages").select(host.alias("host")).where(~F.col("host").startswith("localhost")).groupBy("host").agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, id AS issue FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(text), '\b([A-Z][A-Z0-9]{1,9}-\d{1,6})\b', 1))) AS id FROM documents)
WHERE id NOT IN ('UTF-8', 'UTF-16', 'HTTP-2', 'SHA-1', 'SHA-256', 'ISO-8601', 'RFC-3339')"""
)
def issue_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.issue_ids(F.upper("text"))).alias("issue"))


_WORDS = r"words AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM documents)"


def _words(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.explode(F.filter(F.split(T.fold(F.col("text")), "[^a-z0-9]+"), lambda x: F.length(x) >= 4)).alias("w"))


@query(f"WITH {_WORDS} SELECT w AS norm, count(DISTINCT source) AS apps, CAST(least(0.8, 0.4 + 0.12 * count(DISTINCT source)) AS DOUBLE) AS confidence FROM words GROUP BY w HAVING count(DISTINCT source) >= 2")
def keyword_crossing(spark, d):
    g = _words(spark, d).groupBy(F.col("w").alias("norm")).agg(F.countDistinct("source").alias("apps")).where("apps >= 2")
    return g.withColumn("confidence", F.least(F.lit(0.8), 0.4 + 0.12 * F.col("apps")))


@query(
    f"""WITH {_WORDS}, n AS (SELECT count(*) AS total FROM documents), g AS (SELECT w AS norm, count(DISTINCT doc_id) AS titles, count(DISTINCT source) AS apps FROM words GROUP BY 1)
SELECT norm, titles, least(0.9, c) AS confidence FROM (SELECT *, 0.35 + 0.25 * least(1, ln(total / titles) / ln(total)) + 0.2 * least(1, (titles - 1) / 3) + 0.2 * least(1, (apps - 1) / 2) AS c FROM g, n WHERE titles >= 2 AND titles / total <= 0.5) WHERE c >= 0.5"""
)
def subject_distinctiveness(spark, d):
    total = table(spark, d, "documents").count()
    g = _words(spark, d).groupBy(F.col("w").alias("norm")).agg(F.countDistinct("doc_id").alias("titles"), F.countDistinct("source").alias("apps"))
    g = g.where((F.col("titles") >= 2) & (F.col("titles") / total <= 0.5))
    most = lambda x: F.least(F.lit(1.0), x)
    c = 0.35 + 0.25 * most(F.ln(F.lit(total) / F.col("titles")) / F.ln(F.lit(float(total)))) + 0.2 * most((F.col("titles") - 1) / 3) + 0.2 * most((F.col("apps") - 1) / 2)
    return g.withColumn("c", c).where("c >= 0.5").select("norm", "titles", F.least(F.lit(0.9), F.col("c")).alias("confidence"))


@query(f"WITH {_WORDS}, p AS (SELECT DISTINCT w FROM words WHERE source = 'src0') SELECT w, count(*) AS n FROM words WHERE w NOT IN (SELECT w FROM p) GROUP BY 1")
def place_anti_join(spark, d):
    words = _words(spark, d)
    return words.join(words.where("source = 'src0'").select("w").distinct(), "w", "left_anti").groupBy("w").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EV}, a AS (SELECT DISTINCT session_id, work_day, repository FROM ev WHERE type = 'error')
SELECT session_id, work_day, ord FROM ev WHERE type <> 'error' AND (session_id, work_day, repository) IN (SELECT (session_id, work_day, repository) FROM a)"""
)
def anchor_semi_join(spark, d):
    from ..operators.anchors import matching

    e = silver_events(spark, d)
    side = lambda x: x.select(*DAY, "ord", F.lit("repository").alias("type"), F.col("repository").alias("norm"))
    return matching(side(e.where("type <> 'error'")), side(e.where("type = 'error'"))).select(*DAY, "ord")


_SECRET = r"(?i)(\b[A-Za-z0-9_]{0,64}(?:secret|token|password|passwd|apikey|api_key|access_key|private_key|credential)[A-Za-z0-9_]{0,64}\s*[:=]\s*)[\"'']?[^\s\"''\[][^\s\"'']{3,512}"


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----[A-Za-z0-9+/=\s]{{0,1000}}', '[REDACTED:private_key_fragment]', 'g') AS t, coalesce(text, '') AS o FROM documents),
b AS (SELECT doc_id, o, regexp_replace(regexp_replace(regexp_replace(t, '\b(?:AKIA|ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{{16}}\b', '[REDACTED:aws_access_key_id]', 'g'), '\bgh[pousr]_[A-Za-z0-9]{{36,255}}', '[REDACTED:github_token]', 'g'),
  '\bsk-(?:proj-)?[A-Za-z0-9_\-]{{20,200}}', '[REDACTED:openai_api_key]', 'g') AS t FROM a),
c AS (SELECT doc_id, o, regexp_replace(regexp_replace(t, '([a-zA-Z][a-zA-Z0-9+.\-]{{0,32}}://)[^\s/:@]{{1,128}}:[^\s/@]{{1,128}}@', '\1[REDACTED:url_credentials]@', 'g'), '{_SECRET}', '\1[REDACTED:env_assignment]', 'g') AS t FROM b)
SELECT doc_id, md5(t) AS digest, t <> o AS changed FROM c"""
)
def redact_documents(spark, d):
    """The detectors without DuckDB's equal (repeats over 1000) find nothing in these tables."""
    r = D.storable(D.redact(table(spark, d, "documents").select("doc_id", "text", F.col("text").alias("o")), "text"))
    return r.select("doc_id", F.md5("text").alias("digest"), (F.col("text") != F.coalesce("o", F.lit(""))).alias("changed"))


#: id and pattern of the detectors that find something in these tables, and what they put, in the order in which they apply.
_FOUND = [
    ("private_key_fragment", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,1000}", "[REDACTED:private_key_fragment]"), ("openai_api_key", r"\bsk-(?:proj-)?[A-Za-z0-9_\-]{20,200}", "[REDACTED:openai_api_key]"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,255}", "[REDACTED:github_token]"), ("aws_access_key_id", r"\b(?:AKIA|ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{16}\b", "[REDACTED:aws_access_key_id]"),
    ("url_credentials", r"([a-zA-Z][a-zA-Z0-9+.\-]{0,32}://)[^\s/:@]{1,128}:[^\s/@]{1,128}@", r"\1[REDACTED:url_credentials]@"), ("env_assignment", _SECRET, r"\1[REDACTED:env_assignment]"),
]
_STEPS = ", ".join(
    f"s{i + 1} AS (SELECT *, len(regexp_extract_all(t{i}, '{pattern}')) AS n{i}, regexp_replace(t{i}, '{pattern}', '{put}', 'g') AS t{i + 1} FROM s{i})" for i, (_, pattern, put) in enumerate(_FOUND)
)


@query(
    f"""WITH s0 AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents), {_STEPS},
e AS (SELECT unnest([{", ".join(f"CASE WHEN n{i} > 0 THEN '{name}' END" for i, (name, _, _) in enumerate(_FOUND))}]) AS detector, {" + ".join(f"n{i}" for i in range(len(_FOUND)))} AS hits FROM s{len(_FOUND)})
SELECT detector, count(*) AS documents, CAST(sum(hits) AS BIGINT) AS hits FROM e WHERE detector IS NOT NULL GROUP BY 1"""
)
def redact_stats(spark, d):
    r = D.redact(table(spark, d, "documents").select("doc_id", "text"), "text")
    return r.select(F.explode("redaction_applied").alias("detector"), "redaction_count").groupBy("detector").agg(F.count("*").alias("documents"), F.sum("redaction_count").alias("hits"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+')) AS token FROM documents),
k AS (SELECT * FROM t WHERE length(token) BETWEEN 20 AND 200 AND NOT regexp_matches(token, '[/\\]') AND NOT regexp_matches(token, '^[0-9a-f]{7,40}$') AND NOT regexp_matches(token, '^[0-9a-f]{64}$')
  AND NOT regexp_matches(token, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(token, '^\d{4}-\d{2}-\d{2}[T ][0-9:.]+Z?$')
  AND NOT regexp_matches(token, '^v?\d+\.\d+\.\d+[A-Za-z0-9.\-+]*$') AND NOT regexp_matches(token, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') AND NOT regexp_matches(token, '^\[REDACTED:[a-z_]+\]$')),
u AS (SELECT DISTINCT token FROM k), c AS (SELECT token, c, count(*) AS n FROM (SELECT token, unnest(string_split(token, '')) AS c FROM u) GROUP BY ALL),
e AS (SELECT token, -sum(n / length(token) * log2(n / length(token))) AS entropy FROM c GROUP BY token)
SELECT doc_id, token, round(entropy, 6) AS entropy FROM k JOIN e USING (token) WHERE entropy >= 4.0"""
)
def entropy_tokens(spark, d):
    return D.random_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "token", F.round("entropy", 6).alias("entropy"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS token FROM documents)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1"""
)
def tokenize_counts(spark, d):
    words = F.filter(F.split(T.fold(F.col("text")), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)
    t = table(spark, d, "documents").select("doc_id", F.explode(words).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


TERMS = ["license", "the", "thsh"]
_CORPUS = r"""rows AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS tokens, doc_id * 3600000 AS last_ms, doc_id % 100 AS importance FROM documents),
hit AS (SELECT *, """ + ", ".join(f"len(list_filter(tokens, lambda x: starts_with(x, '{t}'))) > 0 AS h{i}" for i, t in enumerate(TERMS)) + " FROM rows)"
_IDF = "w AS (SELECT " + ", ".join(f"ln(1 + count(*) / (1 + count(*) FILTER (h{i}))) AS w{i}" for i in range(len(TERMS))) + " FROM hit)"
_NOW = 3_600_000 * 2_000


def _search_rows(spark, d):
    docs = table(spark, d, "documents")
    tokens = F.array_distinct(F.filter(F.split(T.fold(F.col("text")), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))
    at = F.col("doc_id") * HOUR
    return docs.select("doc_id", tokens.alias("tokens"), at.alias("first_ms"), at.alias("last_ms"), (F.col("doc_id") % 100).alias("importance"), F.lit("normal").alias("privacy"), F.lit("note").alias("kind"), F.lit("-").alias("context"))


@query(f"WITH {_CORPUS}, {_IDF} SELECT unnest(['{TERMS[0]}', '{TERMS[1]}', '{TERMS[2]}']) AS term, unnest([w0, w1, w2]) AS idf FROM w")
def idf_table(spark, d):
    weight = Q.idf(_search_rows(spark, d), TERMS)
    return spark.createDataFrame(list(weight.items()), "term string, idf double")


_SCORE = f"0.55 * lex + 0.15 * exp(-greatest(0, {_NOW} - last_ms) / 1209600000.0) + 0.10 * least(1.0, importance / 100)"
_LEX = "scored AS (SELECT *, ((CASE WHEN h0 THEN w0 ELSE 0 END) + (CASE WHEN h1 THEN w1 ELSE 0 END) + (CASE WHEN h2 THEN w2 ELSE 0 END)) / (w0 + w1 + w2) AS lex FROM hit, w)"


@query(f"WITH {_CORPUS}, {_IDF}, {_LEX} SELECT doc_id, round(least(1.0, {_SCORE}), 9) AS score FROM scored ORDER BY score DESC, last_ms DESC LIMIT 24")
def ranked_search(spark, d):
    r = Q.rank(Q.narrowed(_search_rows(spark, d), TERMS), TERMS, _NOW).withColumn("score", F.round("score", 9))
    return r.orderBy(F.desc("score"), F.desc("last_ms")).limit(24).select("doc_id", "score")


@query(f"WITH {_CORPUS}, {_IDF}, {_LEX} SELECT doc_id, round(least(1.0, ({_SCORE}) * 1.25), 9) AS score FROM scored WHERE last_ms < 1800000000 AND last_ms >= 360000000 ORDER BY score DESC, last_ms DESC LIMIT 24")
def ranked_search_windowed(spark, d):
    r = Q.rank(Q.narrowed(_search_rows(spark, d), TERMS), TERMS, _NOW, (360_000_000, 1_800_000_000), hard=True).withColumn("score", F.round("score", 9))
    return r.orderBy(F.desc("score"), F.desc("last_ms")).limit(24).select("doc_id", "score")


@query(
    f"""WITH {EV}, k AS (SELECT *, concat_ws('|', CAST(session_id AS VARCHAR), 'note', lower(repository)) AS key, row_number() OVER (PARTITION BY session_id, repository ORDER BY ts_ms, ord) AS nth FROM ev)
SELECT key, arg_min(type, (ts_ms, ord)) AS label, count(*) AS occurrences, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(importance) AS importance,
  array_to_string(list(ord ORDER BY nth DESC) FILTER (nth <= 24), ',') AS evidence FROM k GROUP BY session_id, key"""
)
def corpus_rows(spark, d):
    e = silver_events(spark, d).select(
        "session_id", "ord", "ts_ms", "importance", F.col("session_id").alias("context"), F.lit("note").alias("kind"), F.col("type").alias("label"), F.col("repository").alias("target"), F.lit(None).cast("string").alias("detail"), F.lit("normal").alias("privacy")
    )
    return Q.corpus(e, ["session_id"]).select("key", "label", "occurrences", "first_ms", "last_ms", "importance", F.concat_ws(",", F.col("evidence").cast("array<string>")).alias("evidence"))


@query(
    f"""WITH {EV} SELECT session_id, work_day, ord, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, work_day, type ORDER BY ts_ms DESC, ord DESC) AS INTEGER) AS nth FROM ev WHERE type = 'click') WHERE nth <= 3"""
)
def resume_ran(spark, d):
    """The cap of a resume bucket: the last three of a kind in a day."""
    nth = F.row_number().over(Window.partitionBy(*DAY, "type").orderBy(F.desc("ts_ms"), F.desc("ord")))
    return silver_events(spark, d).where("type = 'click'").withColumn("nth", nth).where("nth <= 3").select(*DAY, "ord", "nth")


@query(
    f"""WITH {EV} SELECT session_id, work_day, CASE WHEN count(*) FILTER (type = 'signup') > 0 THEN 'note' WHEN count(*) FILTER (type = 'error') > 0 THEN 'failing' WHEN count(*) FILTER (type = 'purchase') > 0 THEN 'agent' END AS rule,
  coalesce(arg_max(ord, (ts_ms, ord)) FILTER (type = 'signup'), arg_max(ord, (ts_ms, ord)) FILTER (type = 'error'), arg_max(ord, (ts_ms, ord)) FILTER (type = 'purchase')) AS ref FROM ev GROUP BY 1, 2
HAVING count(*) FILTER (type IN ('signup', 'error', 'purchase')) > 0"""
)
def resume_next_step(spark, d):
    from ..operators.resume import next_step

    e = silver_events(spark, d).withColumn("context", F.lit(1))
    text = F.col("ord").cast("string")
    kind = F.when(F.col("type") == "signup", "manual.note").when(F.col("type") == "error", "terminal.command").when(F.col("type") == "purchase", "agent.activity").otherwise("other")
    meta = F.to_json(F.struct(text.alias("text"), text.alias("commandRedacted"), text.alias("agent"), F.lit(1).alias("exitCode")))
    return next_step(e.withColumn("type", kind).withColumn("metadata", meta)).select(*DAY, "rule", F.col("text").cast("bigint").alias("ref"))


@query(None)
def engine_assignments(spark, d):
    """Held against labelled sessions in tests/test_sessions.py; SQL has no fold of this kind."""
    from ..operators.engine import assignments, with_config

    return assignments(engine_events(spark, d), with_config(activity_gap=6 * HOUR, activity_longest=24 * HOUR))


@query(None)
def engine_contexts(spark, d):
    from ..operators.engine import all_anchors, assignments, contexts_frame, with_config
    from ..sources.staging import staged

    e = engine_events(spark, d)
    anchors = staged(all_anchors(e), "anchors")
    return contexts_frame(e, staged(assignments(e, with_config(activity_gap=6 * HOUR, activity_longest=24 * HOUR), anchors), "assigned"), anchors)


def engine_events(spark, d):
    return silver_events(spark, d).withColumn("title", F.concat_ws(" ", "type", "repository"))


@query(f"WITH {EV} SELECT ord, session_id, type FROM ev")
def stream_ingest(spark, d):
    """The events as a stream, each delivered twice, written once."""
    from ..streaming import ingest

    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = e.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    once = ingest.deduplicated(twice, ["event_id"], "31 days")
    return ingest.drained(once.select(F.col("event_id").alias("ord"), F.col("user_id").alias("session_id"), F.col("event_type").alias("type")), "ingest")
