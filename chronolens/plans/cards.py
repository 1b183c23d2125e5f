"""Queries of the resume card, of projects, anchors and display over the work history, with the equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as S
from ..functions import text as T
from ..operators import anchors as A
from ..operators import exclude as X
from ..operators import projects as H
from ..operators import resume as R
from ..operators.intervals import bursts
from ..sources.adapters import KINDS, PLACES, table, work_history
from .catalogue import DAY, EV, query

NOW_MS, TODAY = 1_706_619_600_000, "2024-01-30"  # 2024-01-30 13:00 UTC
_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_PLACE = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
HIST = (
    EV
    + f""",
h0 AS (SELECT ev.*, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, ({_KIND})[ord % 10 + 1] AS kind, CASE WHEN ord % 3 = 0 THEN 'HEAD' END AS head FROM ev JOIN events ON event_id = ord),
h1 AS (SELECT *, ({_PLACE})[k % 4 + 1] AS place, coalesce(head, 'feature/ab-' || k % 5) AS branch FROM h0),
hist AS (SELECT *, CASE kind WHEN 'browser.navigation' THEN 'Guide ' || k % 3 WHEN 'agent.session' THEN CASE WHEN k % 3 = 0 THEN 'Codex — atlas' ELSE 'Fix crash ' || k % 6 END END AS title,
  CASE kind WHEN 'ide.file.saved' THEN place || '/src/file' || k % 9 || '.py' END AS path, CASE kind WHEN 'browser.navigation' THEN 'https://docs.example.org:8080/p' || k % 11 END AS url,
  CASE kind WHEN 'terminal.command' THEN 'make t' || k % 6 END AS cmd, CASE WHEN ord % 20 = 2 THEN ord % 3 END AS exit_code, CASE kind WHEN 'terminal.command' THEN place || '/src' END AS cwd,
  'App ' || ord % 10 AS shown FROM h1)"""
)


@query(
    f"""WITH {HIST}, l AS (SELECT session_id, work_day, ord, ts_ms,
  CASE kind WHEN 'ide.file.saved' THEN 'working' WHEN 'browser.navigation' THEN 'reading' WHEN 'terminal.command' THEN 'ran' WHEN 'terminal.error_tail' THEN 'failure' WHEN 'manual.note' THEN 'note' ELSE 'produced' END AS bucket,
  CASE kind WHEN 'ide.file.saved' THEN 'file' || k % 9 || '.py' WHEN 'browser.navigation' THEN title WHEN 'terminal.command' THEN cmd WHEN 'terminal.error_tail' THEN 'E' || k % 8 WHEN 'git.commit' THEN 'msg ' || k % 13
    WHEN 'manual.note' THEN 'note ' || k % 17 WHEN 'agent.session' THEN title WHEN 'external.run.finished' THEN 'Run r' || k % 4 || ' — ' || CASE WHEN k % 2 = 0 THEN 'succeeded' ELSE 'failed' END END AS label,
  CASE kind WHEN 'ide.file.saved' THEN path WHEN 'browser.navigation' THEN url WHEN 'terminal.command' THEN 'exit ' || coalesce(CAST(exit_code AS VARCHAR), '?') WHEN 'terminal.error_tail' THEN 'at line' || chr(10) || k % 3
    WHEN 'git.commit' THEN left(lpad(CAST(ord AS VARCHAR), 9, '0'), 7) WHEN 'agent.session' THEN 'src/a' || k % 7 || '.py, /abs/b' || k % 5 || '.py, /tmp/z.py' END AS detail,
  CASE WHEN kind = 'terminal.error_tail' OR kind = 'terminal.command' AND coalesce(exit_code, 1) <> 0 THEN 'failure' WHEN kind IN ('terminal.command', 'git.commit') THEN 'success' END AS tone,
  CASE kind WHEN 'ide.file.saved' THEN 'file' || k % 9 WHEN 'browser.navigation' THEN url ELSE CAST(ord AS VARCHAR) END AS once FROM hist WHERE kind NOT IN ('git.branch.checkout', 'git.status.summary')),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY session_id, work_day, bucket, once ORDER BY ts_ms, ord) = 1)
SELECT session_id, work_day, bucket, ord, label, detail, tone FROM f
QUALIFY row_number() OVER (PARTITION BY session_id, work_day, bucket ORDER BY ts_ms DESC, ord DESC) <= CASE bucket WHEN 'working' THEN 5 WHEN 'reading' THEN 5 WHEN 'ran' THEN 3 WHEN 'produced' THEN 4 WHEN 'failure' THEN 1 ELSE 1000000 END"""
)
def resume_lines(spark, d):
    card = R.capped(R.lines(work_history(spark, d, DAY).withColumn("context", F.lit(1))))
    return card.select(*DAY, "bucket", "ord", "label", "detail", "tone")


@query(
    f"""WITH {HIST}, r AS (
SELECT session_id, work_day, 0 AS late, ts_ms, ord, 0 AS n, CASE kind WHEN 'ide.file.saved' THEN 'file' WHEN 'browser.navigation' THEN 'url' WHEN 'agent.session' THEN 'workspace' ELSE 'folder' END AS kind,
  CASE kind WHEN 'ide.file.saved' THEN path WHEN 'browser.navigation' THEN url ELSE place END AS target FROM hist WHERE kind IN ('ide.file.saved', 'browser.navigation', 'agent.session', 'git.commit', 'git.branch.checkout', 'git.status.summary')
UNION ALL SELECT session_id, work_day, 0, ts_ms, ord, 1, 'file', place || '/src/a' || k % 7 || '.py' FROM hist WHERE kind = 'agent.session'
UNION ALL SELECT session_id, work_day, 0, ts_ms, ord, 2, 'file', '/abs/b' || k % 5 || '.py' FROM hist WHERE kind = 'agent.session'
UNION ALL SELECT session_id, work_day, 1, 0, 0, 0, 'terminal', arg_max(cwd, (ts_ms, ord)) FROM hist WHERE cwd IS NOT NULL GROUP BY 1, 2),
o AS (SELECT * FROM r WHERE NOT regexp_matches(target, '(?i)[/\\\\](temp|tmp)[/\\\\]') QUALIFY row_number() OVER (PARTITION BY session_id, work_day, target ORDER BY late, ts_ms, ord, n) = 1)
SELECT session_id, work_day, CAST(row_number() OVER (PARTITION BY session_id, work_day ORDER BY list_position(['workspace', 'folder', 'terminal', 'file', 'url'], kind), late, ts_ms, ord, n) AS INTEGER) AS nth, kind, target FROM o QUALIFY nth <= 10"""
)
def resume_resources(spark, d):
    return R.resources(work_history(spark, d, DAY).withColumn("context", F.lit(1))).drop("context")


@query(
    f"""WITH {HIST} SELECT ord, CASE kind WHEN 'ide.file.saved' THEN 'file' || k % 9 || '.py' WHEN 'browser.navigation' THEN title WHEN 'terminal.command' THEN cmd WHEN 'terminal.error_tail' THEN 'E' || k % 8 WHEN 'git.commit' THEN 'msg ' || k % 13
  WHEN 'git.branch.checkout' THEN 'checkout ' || branch WHEN 'git.status.summary' THEN k % 4 || ' uncommitted file(s) · ' || branch WHEN 'manual.note' THEN 'note ' || k % 17 WHEN 'agent.session' THEN title
  ELSE 'run r' || k % 4 || ' — ' || CASE WHEN k % 2 = 0 THEN 'succeeded' ELSE 'failed' END END AS headline,
  kind = 'git.commit' OR kind = 'terminal.command' AND coalesce(exit_code = 0, false) OR kind = 'external.run.finished' AND k % 2 = 0 AS win FROM hist"""
)
def event_headlines(spark, d):
    return work_history(spark, d).select("ord", S.headline(F.col("app_display")).alias("headline"), S.is_win().alias("win"))


@query(
    f"""WITH {HIST}, t AS (SELECT ord, 'url' AS kind, url AS target FROM hist WHERE url IS NOT NULL UNION ALL SELECT ord, 'file', path FROM hist WHERE path IS NOT NULL UNION ALL SELECT ord, 'folder', coalesce(cwd, place) FROM hist WHERE kind IN ('terminal.command', 'git.commit', 'git.branch.checkout', 'git.status.summary', 'agent.session')
UNION ALL SELECT ord, 'file', unnest([place || '/src/a' || k % 7 || '.py', '/abs/b' || k % 5 || '.py', '/tmp/z.py']) FROM hist WHERE kind = 'agent.session')
SELECT kind, target, count(*) AS n FROM t GROUP BY 1, 2"""
)
def event_targets(spark, d):
    t = work_history(spark, d).select(F.explode(S.targets()).alias("t")).select("t.*")
    return t.groupBy("kind", "target").agg(F.count("*").alias("n"))


_OWNED = """named AS (SELECT DISTINCT session_id, place AS root FROM hist WHERE kind IN ('agent.session', 'git.commit', 'git.status.summary', 'git.branch.checkout') AND place <> '/work/tmp/x'),
roots AS (SELECT * FROM named a WHERE NOT EXISTS (SELECT 1 FROM named b WHERE b.session_id = a.session_id AND starts_with(b.root, a.root || '/'))),
own0 AS (SELECT h.*, r.root, greatest(coalesce(end_ms, ts_ms), ts_ms) AS fin, row_number() OVER (PARTITION BY ord ORDER BY length(r.root) DESC) AS nth FROM hist h JOIN roots r ON h.session_id = r.session_id
  AND (CASE kind WHEN 'terminal.command' THEN place || '/src' ELSE place END = r.root OR starts_with(CASE kind WHEN 'terminal.command' THEN place || '/src' ELSE place END, r.root || '/'))
  WHERE kind IN ('terminal.command', 'git.commit', 'git.branch.checkout', 'git.status.summary', 'agent.session')),
own AS (SELECT * FROM own0 WHERE nth = 1),
files0 AS (SELECT session_id, root, ts_ms, ord, i, f FROM (SELECT session_id, root, ts_ms, ord, unnest([0, 1]) AS i, unnest([root || '/src/a' || k % 7 || '.py', '/abs/b' || k % 5 || '.py']) AS f FROM own WHERE kind = 'agent.session')),
files1 AS (SELECT session_id, root, f, max((ts_ms, ord, i)) AS newest FROM files0 GROUP BY ALL),
files AS (SELECT session_id, root, string_agg(f, ',' ORDER BY newest DESC) AS files FROM (SELECT * FROM files1 QUALIFY row_number() OVER (PARTITION BY session_id, root ORDER BY newest DESC) <= 8) GROUP BY ALL),
cards AS (SELECT session_id, root, max(fin) AS last_at,
  arg_max(branch, (ts_ms, ord)) FILTER (kind IN ('git.commit', 'git.branch.checkout') OR kind = 'agent.session' AND branch <> 'HEAD') AS branch, arg_max(k % 4, (ts_ms, ord)) FILTER (kind = 'git.status.summary') AS dirty,
  arg_max('msg ' || k % 13, (ts_ms, ord)) FILTER (kind = 'git.commit') AS last_commit, arg_max(title, (ts_ms, ord)) FILTER (kind = 'agent.session' AND k % 3 <> 0) AS last_session, count(*) FILTER (kind = 'agent.session') AS sessions,
  count(DISTINCT work_day) FILTER (work_day > DATE '2024-01-23' AND work_day <= DATE '2024-01-30') AS days_7 FROM own GROUP BY 1, 2)"""


def _owned(spark, d):
    return H.owned_events(work_history(spark, d), ["session_id"])


def _cards(spark, d, files=True):
    return H.project_cards(_owned(spark, d), F.lit(TODAY).cast("date"), ["session_id"], files)


@query(
    f"""WITH {HIST}, {_OWNED} SELECT session_id, root, regexp_extract(root, '[^/]*$') AS name, last_at, branch, dirty, last_commit, last_session, sessions, days_7, coalesce(files, '') AS files,
  concat_ws(chr(10), 'Project ' || regexp_extract(root, '[^/]*$') || ' (' || root || ')', 'Branch: ' || branch, 'Last session: ' || last_session, 'Last commit: ' || last_commit, CASE WHEN dirty > 0 THEN 'Uncommitted files: ' || dirty END,
  'Files touched lately:' || chr(10) || '- ' || replace(files, ',', chr(10) || '- ')) AS brief FROM cards LEFT JOIN files USING (session_id, root)"""
)
def home_cards(spark, d):
    cards = H.project_brief(_cards(spark, d))
    return cards.select("session_id", "root", "name", "last_at", "branch", "dirty", "last_commit", "last_session", "sessions", "days_7", F.array_join("files", ",").alias("files"), "brief")


@query(
    f"""WITH {HIST}, {_OWNED}, s AS (SELECT session_id, root, ts_ms AS a, CASE kind WHEN 'git.commit' THEN ts_ms + 60000 WHEN 'terminal.command' THEN ts_ms + greatest((k % 4) * 50000, 60000) ELSE fin END AS b FROM own WHERE work_day = DATE '2024-01-30' AND kind IN ('agent.session', 'git.commit', 'terminal.command')),
r AS (SELECT *, max(b) OVER (PARTITION BY session_id, root ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, root ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT session_id, root, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY session_id, root, island),
x AS (SELECT session_id, (min(start) + 3600000) // 3600000 * 3600000 - 3600000 AS a0, ceil((greatest(max("end"), {NOW_MS}) + 3600000) / 3600000) * 3600000 - 3600000 AS b0 FROM m GROUP BY 1),
y AS (SELECT session_id, a0, greatest(b0, a0 + 14400000) AS b1 FROM x),
z AS (SELECT m.*, greatest(0, least(100, (start - a0) / (b1 - a0) * 100)) AS l, greatest(0, least(100, ("end" - a0) / (b1 - a0) * 100)) AS r FROM m JOIN y USING (session_id))
SELECT session_id, root, start, "end", n, round(l, 6) AS "left", round(greatest(1.5, r - l), 6) AS width FROM z"""
)
def home_day_band(spark, d):
    spans = H.typed_spans(_owned(spark, d), ["session_id"], F.lit(TODAY).cast("date"))
    out = H.placed(spans, H.axis(spans, ["session_id"], NOW_MS, 60), ["session_id"])
    # halves as DuckDB rounds them: the product is rounded, not the decimal
    return out.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("left", "width")})


@query(
    f"""WITH {HIST}, {_OWNED}, c AS (SELECT *, regexp_extract(root, '[^/]*$') AS name, floor(({NOW_MS} - last_at) / 86400000.0) AS idle FROM cards),
main AS (SELECT session_id, 'main' AS note, arg_max(name, (days_7, last_at, root)) AS name, max(days_7) AS n FROM c GROUP BY 1),
paused AS (SELECT session_id, 'paused' AS note, arg_max(name, (sessions, last_at, root)) AS name, CAST(arg_max(idle, (sessions, last_at, root)) AS BIGINT) AS n, max(sessions) AS most FROM c WHERE idle BETWEEN 7 AND 30 GROUP BY 1),
rec AS (SELECT session_id, 'recoveries' AS note, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM hist WHERE kind = 'agent.session' AND regexp_matches(title, '(?i)plantage|crash') AND work_day > DATE '2024-01-23' AND work_day <= DATE '2024-01-30' GROUP BY 1)
SELECT * FROM main WHERE n >= 3 UNION ALL SELECT session_id, note, name, n FROM paused WHERE most >= 5 UNION ALL SELECT * FROM rec WHERE n >= 3"""
)
def home_week_notes(spark, d):
    return H.card_notes(_cards(spark, d, files=False), work_history(spark, d), NOW_MS, F.lit(TODAY).cast("date"), ["session_id"])


NAMES = ["harbour", "meadow", "lantern", "granite", "orchard", "saddle", "timber"]
_NAMES = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
_STOP = ", ".join(f"'{w}'" for w in T.TITLE_STOPWORDS)
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
TITLED = (
    EV
    + rf""",
t0 AS (SELECT ev.*, 'feat(ui): ' || type || ' ' || ({_NAMES})[TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 + 1] || ', the AB-' || (ord % 9 + 1) || ' parcel/' || ({_NAMES})[ord % 5 + 1] || ' 42 - Slack' AS title FROM ev JOIN events ON event_id = ord),
t1 AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\s*[—–-]\s*Slack\s*$', ''), '(?i)^(feat|fix|chore|docs|refactor|test|style|perf|build|ci)(\([^)]*\))?!?:\s*', ''), '\b([A-Z][A-Z0-9]{{1,9}}-\d{{1,6}})\b', ' ', 'g'),
  '[\[\](){{}}|·•:;,.!?/\\"''`—–-]+', ' ', 'g')), '\s+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\d+$')) AS words FROM t0),
t2 AS (SELECT session_id, work_day, ord, type AS app, list_filter(words, lambda w: length(w) >= 4) || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS phrases FROM t1),
t3 AS (SELECT session_id, work_day, ord, app, unnest(phrases) AS phrase, unnest(range(len(phrases))) AS pos FROM t2),
ph AS (SELECT *, {_NORM.format("phrase")} AS norm FROM t3 WHERE length({_NORM.format("phrase")}) >= 4)"""
)


def _titled(spark, d):
    from ..sources.adapters import silver_events

    e = silver_events(spark, d)
    name = lambda i: F.get(F.array(*map(F.lit, NAMES)), i)
    k = F.get_json_object("metadata", "$.k").try_cast("int")
    title = F.concat(F.lit("feat(ui): "), "type", F.lit(" "), name(k % 7), F.lit(", the AB-"), (F.col("ord") % 9 + 1).cast("string"), F.lit(" parcel/"), name((F.col("ord") % 5).cast("int")), F.lit(" 42 - Slack"))
    return e.withColumn("title", title)


@query(f"WITH {TITLED} SELECT session_id, work_day, norm, arg_min(phrase, (ord, pos)) AS value, count(DISTINCT app) AS apps, CAST(least(0.8, 0.4 + 0.12 * count(DISTINCT app)) AS DOUBLE) AS confidence FROM ph GROUP BY 1, 2, 3 HAVING count(DISTINCT app) >= 2")
def keyword_phrases(spark, d):
    return A.keyword_anchors(_titled(spark, d)).select(*DAY, "norm", "value", "apps", "confidence")


_PLACES = f"""pl AS (SELECT DISTINCT session_id, work_day, {_NORM.format("type")} AS norm FROM ev UNION SELECT DISTINCT session_id, work_day, {_NORM.format("repository")} FROM ev WHERE repository IS NOT NULL
UNION SELECT DISTINCT session_id, work_day, unnest(list_filter(string_split({_NORM.format("repository")}, '-'), lambda p: length(p) >= 4)) FROM ev)"""


@query(f"WITH {TITLED}, {_PLACES} SELECT session_id, work_day, norm FROM pl")
def place_names(spark, d):
    e = _titled(spark, d)
    return A.places(e, A.event_anchors(e))


@query(
    f"""WITH {TITLED}, {_PLACES}, n AS (SELECT session_id, work_day, count(*) AS titled FROM ev GROUP BY 1, 2),
g AS (SELECT session_id, work_day, norm, count(DISTINCT ord) AS titles, count(DISTINCT app) AS apps, arg_min(phrase, (ord, pos)) AS value FROM ph WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.session_id = ph.session_id AND pl.work_day = ph.work_day AND pl.norm = ph.norm) GROUP BY 1, 2, 3),
c AS (SELECT *, 0.35 + 0.25 * least(1.0, ln(titled / titles) / ln(titled)) + 0.2 * least(1.0, (titles - 1) / 3) + 0.2 * least(1.0, (apps - 1) / 2) AS c FROM g JOIN n USING (session_id, work_day) WHERE titles >= 2 AND titles / titled <= 0.5)
SELECT session_id, work_day, norm, value, titles, round(least(0.9, c), 9) AS confidence FROM c WHERE c >= 0.5"""
)
def subject_phrases(spark, d):
    e = _titled(spark, d)
    return A.subject_anchors(e, A.event_anchors(e)).select(*DAY, "norm", "value", "titles", F.round("confidence", 9).alias("confidence"))


@query(
    f"""WITH {HIST}, a AS (
SELECT ord, 'branch' AS type, branch AS value, 0.85 AS confidence FROM hist WHERE branch <> 'HEAD' AND kind IN ('git.commit', 'git.branch.checkout', 'git.status.summary', 'agent.session')
UNION ALL SELECT ord, 'issue', 'AB-' || k % 5, 0.95 FROM hist WHERE false
UNION ALL SELECT ord, 'worktree', array_to_string(list_filter(string_split(place, '/'), lambda p: p <> '')[-2:], '-'), 0.9 FROM hist WHERE kind IN ('git.commit', 'git.branch.checkout', 'git.status.summary', 'agent.session')
UNION ALL SELECT ord, 'repository', repository, 0.5 FROM hist WHERE repository IS NOT NULL
UNION ALL SELECT ord, 'repository', 'src', 0.45 FROM hist WHERE cwd IS NOT NULL
UNION ALL SELECT ord, 'document', 'file' || k % 9, 0.8 FROM hist WHERE path IS NOT NULL
UNION ALL SELECT ord, 'document', unnest(['a' || k % 7, 'b' || k % 5, 'z']), 0.8 FROM hist WHERE kind = 'agent.session'
UNION ALL SELECT ord, 'url', 'docs.example.org', 0.4 FROM hist WHERE url IS NOT NULL)
SELECT ord, type, {_NORM.format("value")} AS norm, CAST(confidence AS DOUBLE) AS confidence FROM a WHERE length({_NORM.format("value")}) >= 2"""
)
def event_anchor_rows(spark, d):
    return A.event_anchors(work_history(spark, d)).select("ord", "type", "norm", "confidence")


@query(
    r"""SELECT o_orderkey, id AS issue FROM (SELECT o_orderkey, unnest(list_distinct(list_filter(['ORD-' || o_orderkey % 100000, 'CU-' || o_custkey % 1000, 'ORD-' || o_orderkey % 100000, 'SHA-' || o_custkey % 3],
lambda x: x NOT IN ('UTF-8', 'UTF-16', 'HTTP-2', 'SHA-1', 'SHA-256', 'ISO-8601', 'RFC-3339')))) AS id FROM orders)"""
)
def issue_scan(spark, d):
    """Ids in a sentence beside shapes that are none: of the deny-list, in lower case, with too many digits."""
    part = lambda name, c, m: F.concat(F.lit(f"{name}-"), (F.col(c) % m).cast("string"))
    line = F.concat_ws(" ", F.lit("see"), part("ORD", "o_orderkey", 100_000), F.lit("and UTF-8,"), part("CU", "o_custkey", 1_000), F.lit("ab-12 XY-1234567"), part("ORD", "o_orderkey", 100_000), part("SHA", "o_custkey", 3))
    return table(spark, d, "orders").select("o_orderkey", F.explode(T.issue_ids(line)).alias("issue"))


_APPS = ["Code.exe", "Bitwarden", "SearchHost.exe", "chrome", "slack", "own", "LockApp.exe"]
_TITLES = ["Inbox", "Sign in to shop", "My Bank", "notes", " ", "Bankrupt plan"]


@query(
    f"""WITH s AS (SELECT event_id AS ord, ({_APPS})[event_id % 7 + 1] AS app, ({_TITLES})[event_id % 6 + 1] AS title FROM events)
SELECT ord, CASE WHEN app IN ('Code.exe', 'chrome') THEN 'normal' ELSE 'sensitive' END AS privacy FROM s WHERE app IN ('Code.exe', 'chrome', 'slack') AND title NOT IN ('Sign in to shop', 'My Bank', ' ')"""
)
def recordable_samples(spark, d):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int"))
    samples = table(spark, d, "events").select(F.col("event_id").alias("ord"), pick(_APPS).alias("app"), pick(_TITLES).alias("title"))
    return X.recordable(samples, "own").select("ord", "privacy")


@query(f"WITH {EV} SELECT session_id, repository, max(ts_ms) AS last_ms, CAST(row_number() OVER (PARTITION BY session_id ORDER BY max(ts_ms) DESC, repository) AS INTEGER) AS rank FROM ev WHERE repository IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 24")
def recent_repositories(spark, d):
    return X.recent_repositories(work_history(spark, d), ["session_id"])


@query(
    r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '(?i)(^|[^\p{L}\p{N}])(license|the|ha)', '\1[\2]', 'g')) AS digest FROM documents"""
)
def highlighted_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.highlighted(F.coalesce("text", F.lit("")), ["the", "license", "ha"])).alias("digest"))


@query(
    f"""WITH {HIST}, s AS (SELECT session_id, place, ts_ms, ord, k FROM hist WHERE kind = 'agent.session'), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_ms - p > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, place ORDER BY ts_ms, ord) AS b FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id, place ORDER BY ts_ms, ord) AS p FROM s)),
r AS (SELECT session_id, place, b, min(ts_ms) AS start, max(ts_ms) AS "end" FROM g GROUP BY 1, 2, 3), c AS (SELECT session_id, place, sum(k % 5) AS calls FROM s GROUP BY 1, 2 HAVING sum(k % 5) > 0)
SELECT session_id, place, start, "end", CASE WHEN start = max(start) OVER (PARTITION BY session_id, place) THEN calls END AS calls FROM r JOIN c USING (session_id, place)"""
)
def agent_burst_events(spark, d):
    """Runs of an agent's activity in a place; the totals stand at the last run, places without any call are left out."""
    e = work_history(spark, d).where(F.col("type") == "agent.session").withColumns({"place": F.get_json_object("metadata", "$.projectPath"), "calls": F.get_json_object("metadata", "$.toolCallCount").cast("bigint")})
    keys = ["session_id", "place"]
    totals = e.groupBy(*keys).agg(F.sum("calls").alias("calls")).where("calls > 0")
    runs = bursts(e, keys, 86_400_000)
    last = runs.groupBy(*keys).agg(F.max("start").alias("_last"))
    return runs.join(last, keys).join(totals, keys).select(*keys, "start", "end", F.when(F.col("start") == F.col("_last"), F.col("calls")).alias("calls"))
