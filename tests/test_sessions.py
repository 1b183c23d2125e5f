"""The grouping engine on labelled sessions of our own, and answers from ranked facts."""

import json

import pytest
from pyspark.sql import functions as F

from chronolens.operators import answer, engine, evaluate

SCHEMA = "session_id string, work_day string, ref string, ord long, ts_ms long, end_ms long, tz int, source string, type string, app string, title string, repository string, importance int, metadata string, tag string"
NINE = 1_705_309_200_000


def step(tag, kind, app, title, repository, seconds=20, important=False, **meta):
    return (tag, kind, app, title, repository, seconds, important, meta)


def session(name, steps):
    """steps, or a number of seconds to wait between them."""
    rows, at = [], NINE
    for s in steps:
        if isinstance(s, int):
            at += s * 1000
            continue
        tag, kind, app, title, repository, seconds, important, meta = s
        n = len(rows)
        rows.append((name, "2024-01-15", f"e{n}", n, at, at + seconds * 1000, 0, "app", kind, app, title, repository, 85 if important else 30, json.dumps(meta), tag))
        at += seconds * 1000
    return rows


def task(tag, issue, repository, subject):
    """Ticket, editor, tests and commit of one task."""
    at = f"/w/{repository}"
    return [
        step(tag, "browser.navigation", "browser", f"{issue} {subject}", None, url=f"https://tracker.example/{issue}", host="tracker.example"),
        step(tag, "git.branch.checkout", "git", None, repository, to=f"fix/{issue}", worktree=at),
        step(tag, "ide.file.saved", "editor", f"{subject}.py", repository, path=f"{at}/src/{subject}.py", workspacePath=at),
        step(tag, "terminal.command", "shell", None, repository, important=True, commandRedacted="make test", cwd=at, exitCode=1, branch=f"fix/{issue}"),
        step(tag, "ide.file.saved", "editor", f"{subject}.py", repository, path=f"{at}/src/{subject}.py", workspacePath=at),
        step(tag, "git.commit", "git", None, repository, important=True, messageRedacted=f"{issue} mend {subject}", branch=f"fix/{issue}", worktree=at),
    ]


A_TASK, B_TASK = ("a", "ABC-12", "alpha", "login"), ("b", "XYZ-7", "beta", "invoice")
NOISE = [step(None, "system.window.focus", "player", "tune", None, 5)]

SESSIONS = {
    "one task": session("one task", task(*A_TASK) + [60] + task(*A_TASK)),
    "interleaved": session("interleaved", task(*A_TASK) + task(*B_TASK) + [120] + task(*A_TASK) + [40] + task(*B_TASK)),
    "back after hours": session("back after hours", task(*A_TASK) + [3 * 3600] + task(*B_TASK) + [3600] + task(*A_TASK)),
    "with noise": session("with noise", task(*A_TASK) + [1800] + NOISE + [3600] + NOISE + [1800] + task(*B_TASK)),
}


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([r for s in SESSIONS.values() for r in s], SCHEMA)


@pytest.fixture(scope="module")
def assigned(events):
    return engine.assignments(events).cache()


def _truth(events):
    return events.select("session_id", "ref", "tag", (F.col("importance") >= 80).alias("important"))


def _predicted(events, assigned):
    return events.select("session_id", "ref", "ord").join(assigned, ["session_id", "ord"]).select("session_id", "ref", F.col("context").cast("string").alias("cluster"))


def test_every_event_is_assigned_once(events, assigned):
    assert assigned.count() == events.count() == assigned.select("session_id", "ord").distinct().count()


def test_quality_gates(events, assigned):
    counts = evaluate.contingency(_truth(events), _predicted(events, assigned))
    found = {r.session_id: r for r in evaluate.pairwise(counts).collect()}
    assert set(found) == set(SESSIONS)
    mean = lambda c: sum(r[c] for r in found.values()) / len(found)
    assert mean("false_merge") < 0.10 and mean("false_split") < 0.15 and mean("f1") > 0.95
    recall = evaluate.important_recall(_truth(events), _predicted(events, assigned), counts).collect()
    assert sum(r.important_recall for r in recall) / len(recall) > 0.9


def test_truth_scores_one_and_baselines_less(events, assigned):
    truth = _truth(events)
    own = evaluate.pairwise(evaluate.contingency(truth, truth.select("session_id", "ref", F.col("tag").alias("cluster")))).collect()
    assert all(r.f1 == r.ari == 1.0 for r in own)
    f1 = lambda p: {r.session_id: r.f1 for r in evaluate.pairwise(evaluate.contingency(truth, p)).collect()}
    engine_f1 = f1(_predicted(events, assigned))
    for name in ("single", "per-event", "per-application", "time-gap"):
        other = f1(evaluate.PREDICTORS[name](events))
        assert sum(engine_f1.values()) > sum(other.values()), name


def test_contexts_are_named_by_their_issue(events, assigned):
    rows = engine.contexts_frame(events.where("session_id = 'interleaved'"), assigned.where("session_id = 'interleaved'")).collect()
    assert sorted(r.issue for r in rows) == ["ABC-12", "XYZ-7"] and not any(r.fallback for r in rows)
    assert all(0 < r.active_ms <= r.end - r.start for r in rows)


def test_detached_heads_of_two_repositories_stay_apart(spark):
    one = lambda tag, repo: [step(tag, "terminal.command", "shell", None, repo, commandRedacted="ls", cwd=f"/w/{repo}", projectPath=f"/w/{repo}", branch="HEAD", exitCode=0)] * 4
    e = spark.createDataFrame(session("heads", one("a", "left") + one("b", "right")), SCHEMA)
    rows = _predicted(e, engine.assignments(e)).join(e.select("ref", "tag"), "ref").collect()
    assert len({(r.tag, r.cluster) for r in rows}) == 2 and len({r.cluster for r in rows}) == 2


def test_loose_events_are_in_no_context(events, assigned):
    loose = answer.loose_events(events, assigned).collect()
    held = {(r.session_id, r.ord) for r in assigned.where("context is not null").select("session_id", "ord").collect()}
    assert not held & {(r.session_id, r.ord) for r in loose}


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "key string, kind string, context string, last_ms long, lexical double, context_score double, score double")


def test_refusals(spark):
    rows = _ranked(spark, [("k1", "note", "c", 5, 0.5, 0.0, 0.6), ("k2", "file", "c", 4, 0.0, 0.5, 0.5), ("k3", "note", "d", 3, 0.0, 0.0, 0.9)])
    why = lambda r, **k: answer.verdict(r, ["x"], **k).first().refusal
    assert why(rows) is None and why(rows, causal=True) == "insufficient_evidence"
    assert why(rows.where("key = 'k3'")) == "no_match" and why(rows.withColumn("score", F.lit(0.3))) == "below_threshold"
    assert why(rows.limit(0)) == "no_match" and answer.verdict(rows.limit(0), []).first().refusal == "empty_window"
    held = spark.createDataFrame([("c",)], "context string")
    assert answer.verdict(rows.limit(0), [], contexts=held).first().refusal is None
    assert [r.key for r in answer.results(rows, ["x"]).collect()] == ["k1", "k2"]
    assert {r.key for r in answer.closest(rows).collect()} == {"k1", "k2"}
    assert [r.key for r in answer.closest(rows.where("key = 'k3'")).collect()] == ["k3"] and answer.closest(rows.limit(0)).count() == 0


def test_rollup_highlights(spark):
    rows = _ranked(spark, [("w0", "window", "c", 9, 1.0, 0.0, 0.9), ("w1", "window", "c", 8, 1.0, 0.0, 0.8), ("n", "note", "c", 1, 1.0, 0.0, 0.1), ("w2", "window", "d", 1, 1.0, 0.0, 0.2)] + [(f"m{i}", "note", "d", 1, 1.0, 0.0, 0.5) for i in range(9)])
    held = spark.createDataFrame([("c", 0, 10), ("d", 0, 10), ("e", 0, 10), ("f", 50, 60)], "context string, start long, end long")
    got = {r.context: (r.score, r.highlights) for r in answer.rollup(held, rows, ["context"], (0, 20), hard=True).collect()}
    assert got == {"c": (0.9, ["w0", "n"]), "d": (0.5, [f"m{i}" for i in range(6)]), "e": (0.0, [])}


def test_latest_context_of_a_project(spark):
    contexts = spark.createDataFrame([("s", "d", 1, 0, 10, "alpha"), ("s", "d", 2, 5, 20, None), ("s", "d", 3, 5, 90, "beta")], "session_id string, work_day string, context int, start long, end long, repository string")
    resources = spark.createDataFrame([("s", "d", 2, "/w/alpha/src/a.py"), ("s", "d", 3, "/w/alphabet/a.py")], "session_id string, work_day string, context int, target string")
    assert [r.context for r in answer.latest_for_project(contexts, resources, "/w/alpha/").collect()] == [2]
