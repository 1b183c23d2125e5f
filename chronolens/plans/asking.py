"""Queries of the question-answering operators, with the equal DuckDB SQL. A question is given by its terms and its window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import corpus as Q
from ..sources.adapters import silver_events, table
from .catalogue import _CORPUS, _IDF, _LEX, _NOW, _SCORE, CTX, HOUR, TERMS, _search_rows, contexts, query

#: name, terms, causal, hard window
QUESTIONS = [
    ("all", ["license", "the", "thsh"], False, None),
    ("unknown", ["qqzzqqzz"], False, None),
    ("cause", ["license"], True, (360_000_000, 720_000_000)),
    ("time", [], False, (360_000_000, 720_000_000)),
    ("no_time", [], False, (-7_200_000, -3_600_000)),
]


def _rows(spark, d) -> DataFrame:
    return _search_rows(spark, d).withColumn("key", F.col("doc_id"))


def _verdict_sql(name: str, terms: list[str], causal: bool, window: tuple[int, int] | None) -> str:
    hit = lambda t: f"len(list_filter(tokens, lambda x: starts_with(x, '{t}'))) > 0"
    weights = ", ".join([f"ln(1 + count(*) / (1 + count(*) FILTER ({hit(t)}))) AS w{i}" for i, t in enumerate(terms)] or ["count(*) AS w"])  # one row in either case
    total = " + ".join(f"w{i}" for i in range(len(terms)))
    lex = f"({' + '.join(f'(CASE WHEN {hit(t)} THEN w{i} ELSE 0 END)' for i, t in enumerate(terms))}) / ({total})" if terms else "0.0"
    inside = f"WHERE last_ms < {window[1]} AND last_ms >= {window[0]}" if window else ""
    boost = 1.25 if window else 1.0
    none = "CASE WHEN rows = 0 THEN 'empty_window' END"
    why = "CASE WHEN relevant = 0 THEN 'no_match' WHEN best < 0.35 THEN 'below_threshold'" + (" WHEN sources < 2 THEN 'insufficient_evidence'" if causal else "") + " END"
    return f"""SELECT '{name}' AS question, rows, relevant, sources, round(best, 6) AS best, {why if terms else none} AS refusal FROM (
WITH r AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS tokens, doc_id * 3600000 AS last_ms, doc_id % 100 AS importance FROM documents),
w AS (SELECT {weights} FROM r), l AS (SELECT *, {lex} AS lex FROM r, w {inside}), s AS (SELECT doc_id, lex, least(1.0, ({_SCORE}) * {boost}) AS score FROM l)
SELECT count(*) AS rows, count(*) FILTER (lex > 0) AS relevant, count(DISTINCT doc_id) FILTER (lex > 0) AS sources, max(score) FILTER (lex > 0) AS best FROM s)"""


@query("\nUNION ALL ".join(_verdict_sql(*q) for q in QUESTIONS))
def ask_verdict(spark, d):
    rows, found = Q.narrowed(_rows(spark, d), sorted({t for _, terms, *_ in QUESTIONS for t in terms})), []
    for name, terms, causal, window in QUESTIONS:
        ranked = Q.rank(rows, terms, _NOW, window, hard=window is not None)
        one = A.verdict(ranked, terms, causal)
        found.append(one.select(F.lit(name).alias("question"), "rows", "relevant", "sources", F.round("best", 6).alias("best"), "refusal"))
    return reduce(DataFrame.union, found)


@query(
    f"""WITH {_CORPUS}, {_IDF}, {_LEX}, s AS (SELECT doc_id, source AS context, last_ms, CASE WHEN doc_id % 4 = 0 THEN 'window' ELSE 'note' END AS kind, round(least(1.0, {_SCORE}), 9) AS score
  FROM scored JOIN documents USING (doc_id) WHERE lex > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, last_ms DESC, doc_id) AS nth FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY nth) AS k FROM n WHERE kind <> 'window' OR nth = 1),
h AS (SELECT context, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS highlights FROM k WHERE k <= 6 GROUP BY 1), b AS (SELECT context, max(score) AS score FROM s GROUP BY 1),
c AS (SELECT source AS context, min(doc_id) * 3600000 AS start, max(doc_id) * 3600000 AS "end" FROM documents GROUP BY 1)
SELECT context, start, "end", coalesce(score, 0.0) AS score, coalesce(highlights, '') AS highlights FROM c LEFT JOIN b USING (context) LEFT JOIN h USING (context) WHERE start < 720000000 AND "end" >= 360000000"""
)
def ask_rollup(spark, d):
    """A document stands for a fact and its source for a context."""
    of = table(spark, d, "documents").select("doc_id", F.col("source").alias("context"))
    rows = Q.narrowed(_rows(spark, d).drop("context"), TERMS).join(of, "doc_id").withColumn("kind", F.when(F.col("doc_id") % 4 == 0, "window").otherwise("note"))
    ranked = A.relevant(Q.rank(rows, TERMS, _NOW).withColumn("score", F.round("score", 9)), TERMS)
    held = of.groupBy("context").agg((F.min("doc_id") * HOUR).alias("start"), (F.max("doc_id") * HOUR).alias("end"))
    out = A.rollup(held, ranked, ["context"], (360_000_000, 720_000_000), hard=True)
    return out.select("context", "start", "end", "score", F.array_join(F.col("highlights").cast("array<string>"), ",").alias("highlights"))


@query(
    f"""WITH {CTX}, busy AS (SELECT session_id FROM ev WHERE work_day = DATE '2024-01-20' GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT * FROM ctx WHERE work_day < DATE '2024-01-20' AND session_id NOT IN (SELECT session_id FROM busy)), l AS (SELECT session_id, max(work_day) AS work_day FROM e GROUP BY 1)
SELECT session_id, work_day, key, start, "end", active_ms FROM e JOIN l USING (session_id, work_day) WHERE active_ms > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY "end" DESC, start DESC, ord DESC) = 1"""
)
def morning_brief(spark, d):
    return A.morning_brief(contexts(spark, d), silver_events(spark, d), "2024-01-20", quiet=1).select("session_id", "work_day", "key", "start", "end", "active_ms")
