"""Searchable facts of a timeline and their ranking.

Rows: key, kind, label, target, context, occurrences, first_ms, last_ms, importance, privacy, evidence, tokens.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.meta import number
from ..sources.staging import staged

#: Fixed values.
WEIGHTS = {"lexical": 0.55, "context": 0.20, "recency": 0.15, "importance": 0.10}
RECENCY_MS, EVIDENCE, THRESHOLD = 14 * 86_400_000, 24, 0.35
HARD_BOOST, SOFT_BOOST, SENSITIVE = 1.25, 1.2, 0.6


def _meta(name: str) -> Column:
    value = F.get_json_object("metadata", f"$.{name}")
    return F.when(F.trim(value) != "", value)


def facets(events: DataFrame) -> DataFrame:
    """One row for each fact an event states: events' columns and kind, label, target, detail."""
    one = lambda when, kind, label, target=None, detail=None: F.when(
        when & label.isNotNull(),
        F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), label.alias("label"), (label if target is None else target).alias("target"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")),
    )
    kind, always = F.col("type"), F.lit(True)
    path = F.coalesce(_meta("path"), _meta("toPath"))
    exit_code = number("exitCode", F.col("metadata"))
    every = F.array_compact(
        F.array(
            one(_meta("url").isNotNull(), "url", F.coalesce(F.when(F.col("title") != "", F.col("title")), _meta("url")), _meta("url")),
            one(path.isNotNull(), "file", T.leaf(path), path),
            one(always, "file", T.leaf(_meta("workspacePath")), _meta("workspacePath")),
            one(kind == "terminal.command", F.when(exit_code == 0, "command").otherwise("error"), _meta("commandRedacted"), _meta("commandRedacted"), _meta("cwd")),
            one(kind == "git.commit", "commit", _meta("messageRedacted")),
            one(kind == "git.branch.checkout", "commit", _meta("to")),
            one(kind == "manual.note", "note", _meta("text")),
            one(kind.startswith("agent."), "agent", F.coalesce(F.when(F.col("title") != "", F.col("title")), _meta("agent"))),
            one(kind == "ide.diagnostic.error", "error", _meta("messageRedacted"), _meta("path")),
            one(kind == "terminal.error_tail", "error", F.get_json_object("metadata", "$.lines[0]")),
            one(kind.startswith("system.window."), "window", F.when(F.col("title") != "", F.col("title"))),
        )
    )
    return events.withColumn("f", F.explode(every)).select(*events.columns, "f.*")


def corpus(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (keys, context, kind, label, target, detail, ord, ts_ms, importance, privacy) as deduplicated rows.

    What describes a row comes from its first fact; the evidence is the oldest EVIDENCE facts, newest first."""
    identity = F.concat_ws("|", F.coalesce(F.col("context").cast("string"), F.lit("-")), "kind", F.lower(F.coalesce("target", "label")))
    order = F.struct("ts_ms", "ord")
    ranked = facts.withColumn("key", identity).withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ts_ms", "ord")))
    first = lambda c: F.min_by(c, order).alias(c)
    rows = ranked.groupBy(*keys, "key").agg(
        first("context"), first("kind"), first("label"), first("target"), first("detail"), first("privacy"), F.count("*").alias("occurrences"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max("importance").alias("importance"),
        F.reverse(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= EVIDENCE, F.struct("nth", "ord")))), lambda x: x["ord"])).alias("evidence"),
    )
    words = F.concat_ws(" ", "label", "detail", "target")
    return rows.withColumn("tokens", T.tokens(words, T.fold(words)))


def context_tokens(contexts: DataFrame, anchors: DataFrame) -> DataFrame:
    """context, context_tokens: words of each context's label, repository, branch and project, and of the values of its anchors (context, value). contexts: context, label, repository, branch, project."""
    named = contexts.select("context", F.explode(F.array_compact(F.array("label", "repository", "branch", "project"))).alias("value"))
    each = named.unionByName(anchors.where("value is not null").select("context", "value")).select("context", F.explode(T.tokens(F.col("value"), T.fold(F.col("value")))).alias("token"))
    found = each.distinct().groupBy("context").agg(F.sort_array(F.collect_list("token")).alias("context_tokens"))
    every = contexts.select("context").unionByName(anchors.select("context")).distinct()
    return every.join(found, "context", "left").withColumn("context_tokens", F.coalesce("context_tokens", F.array().cast("array<string>")))


def matches(term: str, tokens: Column) -> Column:
    """Whether a term is one of the tokens, or the beginning of one if it has three characters."""
    return F.exists(tokens, lambda t: (t == term) | (t.startswith(term) if len(term) >= 3 else F.lit(False)))


def narrowed(rows: DataFrame, terms: list[str]) -> DataFrame:
    """rows with only those tokens that match one of the terms, written once: weights and scores of these terms are the same, and no text is cut into tokens again for them."""
    hit = lambda t: reduce(or_, [(t == term) | (t.startswith(term) if len(term) >= 3 else F.lit(False)) for term in terms], F.lit(False))
    return staged(rows.withColumn("tokens", F.filter("tokens", hit)), "narrowed-rows")


def idf(rows: DataFrame, terms: list[str]) -> dict[str, float]:
    """ln(1 + N / (1 + df)) over all rows: one aggregate, one number a term."""
    if not terms:
        return {}
    got = rows.agg(*[F.ln(1 + F.count("*") / (1 + F.count_if(matches(t, F.col("tokens"))))).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return {t: got[i] for i, t in enumerate(terms)}


def _coverage(terms: list[str], weight: dict[str, float], tokens: Column) -> Column:
    total = sum(weight[t] for t in terms)
    if not total:
        return F.lit(0.0)
    hit = sum((F.when(matches(t, tokens), F.lit(weight[t])).otherwise(0.0) for t in terms), F.lit(0.0))
    return hit / total


def rank(rows: DataFrame, terms: list[str], now_ms: int, window: tuple[int, int] | None = None, hard: bool = False, kinds: list[str] | None = None, context_tokens: DataFrame | None = None, weight: dict[str, float] | None = None) -> DataFrame:
    """rows with lexical, context_score, score, matched, complete; those in question only. Order by score, then last_ms, both falling. weight: idf of the terms, if it is known."""
    weight = idf(rows, terms) if weight is None else weight
    if context_tokens is not None:
        rows = rows.join(context_tokens, "context", "left")
    own = F.coalesce("context_tokens", F.array().cast("array<string>")) if context_tokens is not None else F.array().cast("array<string>")
    inside = (F.col("first_ms") < window[1]) & (F.col("last_ms") >= window[0]) if window else F.lit(False)
    if window and hard:
        rows = rows.where(inside)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    matched = F.array_compact(F.array(*[F.when(matches(t, F.col("tokens")), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
    complete = (F.size("matched") == len(terms)) & F.lit(bool(terms))
    recency = F.exp(-F.greatest(F.lit(0), F.lit(now_ms) - F.col("last_ms")) / RECENCY_MS)
    score = (
        WEIGHTS["lexical"] * F.col("lexical") + WEIGHTS["context"] * F.col("context_score") + WEIGHTS["recency"] * recency
        + WEIGHTS["importance"] * F.least(F.lit(1.0), F.coalesce("importance", F.lit(0)) / 100)
    ) * F.when(inside, F.lit(HARD_BOOST if hard else SOFT_BOOST)).otherwise(1.0)
    out = rows.withColumns({"matched": matched, "lexical": _coverage(terms, weight, F.col("tokens")), "context_score": _coverage(terms, weight, own)})
    out = out.withColumn("complete", complete).where((F.coalesce("privacy", F.lit("normal")) != "private") | F.col("complete"))
    toned = score * F.when((F.col("privacy") == "sensitive") & ~F.col("complete"), F.lit(SENSITIVE)).otherwise(1.0)
    return out.withColumn("score", F.least(F.lit(1.0), toned))
