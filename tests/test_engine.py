"""The grouping engine against a second, naive one that compares everything with everything, on random days."""

import random
import time
from itertools import pairwise

import pytest

from chronolens.operators import engine

LOOSE, STRONG, MEDIUM, IDENTITY = ("keyword", "document", "project"), ("issue", "worktree"), ("branch", "project", "document"), ("issue", "worktree", "branch")
BOUNDARY = ("system.idle.start", "system.session.lock", "system.power.sleep", "system.capture.paused")


def match(a, b):
    """Whether anchor a (type, norm) matches b: equal norms of one type or a loose a; or both loose with a part of four characters in common."""
    if a[1] == b[1] and (a[0] == b[0] or a[0] in LOOSE):
        return True
    words = lambda x: {w for w in x[1].split("-") if len(w) >= 4}
    return a[0] in LOOSE and b[0] in LOOSE and bool(words(a) & words(b))


def matching(xs, ys):
    return [a for a in xs if any(match(a, b) for b in ys)]


def conflict(xs, ys):
    for kind in IDENTITY:
        mine, theirs = [a for a in xs if a[0] == kind], [b for b in ys if b[0] == kind]
        if mine and theirs and not matching(mine, theirs):
            return True
    return False


def merge(anchors, more):
    for a in more:
        if a[:2] not in anchors:
            anchors.append(a[:2])


def naive_activities(events, c):
    out, now = [], None
    for i, e in enumerate(events):
        if e["type"] in BOUNDARY:
            now = None
            continue
        own = [a[:2] for a in e["anchors"]]
        if now is not None:
            recent = [a[:2] for k in now["events"][-3:] for a in events[k]["anchors"]]
            together = e["app"] in now["apps"] or matching(own, recent)
            if e["ts"] - now["end"] > c.activity_gap or e["end"] - now["start"] > c.activity_longest or conflict(own, recent) or not together:
                now = None
        if now is None:
            now = {"events": [], "apps": [], "anchors": [], "start": e["ts"], "end": e["end"]}
            out.append(now)
        now["events"].append(i)
        now["end"] = max(now["end"], e["end"])
        if e["app"] not in now["apps"]:
            now["apps"].append(e["app"])
        merge(now["anchors"], own)
    return out


def naive_score(act, ctx, previous, c):
    shared = matching(act["anchors"], ctx["anchors"])
    strong, medium = any(a[0] in STRONG for a in shared), any(a[0] in MEDIUM for a in shared)
    weak = {a[1] for a in shared if a[0] not in STRONG + MEDIUM}
    if not strong and conflict(act["anchors"], ctx["anchors"]):
        return 0.0
    gap = max(0, act["start"] - ctx["end"])
    if not shared:
        if not act["anchors"]:
            drift = max(0, act["end"] - ctx["anchored"]) if ctx["anchors"] else gap
            return c.threshold * (1 - drift / c.drift) if drift < c.drift else 0.0
        goes_on = previous is not None and previous[0] is ctx and previous[1] == act["apps"][0] and gap < c.continuation
        return c.threshold if goes_on else 0.0
    recency = 0.5 ** (gap / c.half_life)
    raw = 0.5 * (1 if strong else 0.7 if medium else 0) + 0.28 * min(1, len(weak) / 2) + 0.14 * recency + 0.04 * bool(set(act["apps"]) & set(ctx["apps"]))
    return raw if strong else raw * (0.4 + 0.6 * recency)


def absorb(host, other):
    host["start"], host["end"], host["anchored"] = min(host["start"], other["start"]), max(host["end"], other["end"]), max(host["anchored"], other["anchored"])
    host["events"] += other["events"]
    host["apps"] += [a for a in other["apps"] if a not in host["apps"]]
    merge(host["anchors"], other["anchors"])


def naive_day(events, c):
    acts, found, previous = naive_activities(events, c), [], None
    for act in acts:
        scores = [naive_score(act, ctx, previous, c) for ctx in found]
        best = max(range(len(found)), key=lambda k: (scores[k], -k), default=None)
        if best is None or scores[best] < c.threshold or scores[best] <= 0:
            found.append({"events": [], "apps": [], "anchors": [], "start": act["start"], "end": act["end"], "anchored": act["start"], "number": len(found) + 1})
            best = len(found) - 1
        ctx = found[best]
        absorb(ctx, {**act, "anchored": act["end"] if act["anchors"] else ctx["anchored"]})
        previous = (ctx, act["apps"][-1])

    def one_merge():
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                if matching(found[i]["anchors"], found[j]["anchors"]) and not conflict(found[i]["anchors"], found[j]["anchors"]):
                    absorb(found[i], found.pop(j))
                    return True
        return False

    def one_bracket():
        for i, inner in enumerate(found):
            if all(a[0] not in STRONG + MEDIUM for a in inner["anchors"]):
                for host in found:
                    if host is not inner and host["anchors"] and host["start"] < inner["start"] and host["end"] > inner["end"]:
                        absorb(host, inner)
                        found.remove(inner)
                        return True
        return False

    while one_merge():
        pass
    while one_bracket():
        pass
    activity = {i: n for n, a in enumerate(acts, 1) for i in a["events"]}
    context = {i: x["number"] for x in found if len(x["events"]) >= c.least_events for i in x["events"]}
    return [(activity.get(i), context.get(i)) for i in range(len(events))]


def random_day(rng, n, norms=9):
    kinds, words = ["issue", "worktree", "branch", "project", "document", "repository", "url", "keyword", "custom"], ["alpha", "beta", "gamma", "main", "ab", "delta"]
    norm = lambda: "-".join(rng.sample(words, rng.choice([1, 1, 2]))) + rng.choice(["", "", f"-{rng.randrange(norms)}"])
    pool = [(rng.choice(kinds), norm(), rng.choice([0.5, 0.9])) for _ in range(norms)]
    ts, out = 0, []
    for _ in range(n):
        ts += rng.choice([0, 1_000, 20_000, 60_000, 91_000, 130_000, 700_000, 3_000_000])
        own = rng.sample(pool, min(len(pool), rng.choice([0, 0, 1, 1, 2, 3])))
        out.append({"ts": ts, "end": ts + rng.choice([0, 0, 5_000, 400_000]), "type": rng.choice(["x"] * 12 + list(BOUNDARY)), "app": rng.choice("ABC"), "anchors": own})
    return out


@pytest.mark.parametrize("seed", range(12))
def test_random_days(seed):
    rng, grouped = random.Random(seed), 0
    for _ in range(40):
        day = random_day(rng, rng.randrange(0, 60), rng.randrange(2, 25))
        config = engine.with_config(drift=rng.choice([600_000, 60_000]), activity_gap=rng.choice([90_000, 10_000]))
        got = engine.group_day(day, config)
        assert got == naive_day(day, config)
        grouped += len({c for _, c in got if c})
    assert grouped > 40


def test_starts_never_fall():
    rng = random.Random(1)
    for _ in range(30):
        acts = engine.activities(random_day(rng, 80, 12), engine.EngineConfig())
        assert all(a.start <= b.start for a, b in pairwise(acts))


def test_a_day_of_very_many_events_takes_time_near_their_number():
    def day(n):
        rng, out = random.Random(7), []
        for i in range(n):
            issue = f"ab-{i // 40}"
            out.append({"ts": i * 30_000, "end": i * 30_000, "type": "x", "app": f"A{i // 20}", "anchors": [("issue", issue, 0.9), ("url", f"host-{rng.randrange(n)}", 0.5)] if rng.random() < 0.6 else []})
        return out

    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        got = engine.group_day(day(n), engine.EngineConfig())
        took.append(time.process_time() - began)
        assert len({c for _, c in got if c}) > n / 80
    assert took[1] < 30 * max(took[0], 0.05)


def test_matches_and_detail(spark):
    from chronolens.operators import evaluate

    rng, rows = random.Random(2), []
    for s in "abc":
        rows += [(s, f"{s}{i}", rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice(["c1", "c2", "c3", None]), rng.random() < 0.4) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, ref string, tag string, cluster string, important boolean")
    truth, predicted = df.select("session_id", "ref", "tag", "important"), df.select("session_id", "ref", "cluster")
    counts = {(r.session_id, r.tag, r.cluster): r.n for r in evaluate.contingency(truth, predicted).collect()}
    want = set()
    for s in "abc":
        left = sorted(((-n, t, c) for (x, t, c), n in counts.items() if x == s))
        while left:
            n, t, c = left[0]
            want.add((s, t, c, -n))
            left = [x for x in left if x[1] != t and x[2] != c]
    assert {tuple(r) for r in evaluate.matches(evaluate.contingency(truth, predicted)).collect()} == want
    got = {r.session_id: r for r in evaluate.detail(truth, predicted).collect()}
    assert {(s, m.tag, m.cluster, m.n) for s, r in got.items() for m in r.matches} == want
    noise = {s: sum(1 for x in rows if x[0] == s and x[2] is None and x[3] is not None) for s in "abc"}
    assert {s: r.noise_absorbed for s, r in got.items()} == noise
    assert evaluate.matches(evaluate.contingency(truth.limit(0), predicted)).count() == 0


def test_registry_and_predictions_file(spark, tmp_path):
    from chronolens.operators import evaluate
    from chronolens.sources import readers

    e = spark.createDataFrame([("s", "2024-01-15", i, str(i), i * 60_000, i * 60_000, "app", "r", "t") for i in range(4)], "session_id string, work_day string, ord long, ref string, ts_ms long, end_ms long, app string, repository string, tag string")
    assigned = spark.createDataFrame([("s", "2024-01-15", i, 1, 1 if i else None) for i in range(4)], "session_id string, work_day string, ord long, activity long, context long")
    named = evaluate.registry(e, e.select("session_id", "ref", "tag"), assigned)
    assert len(named) == 8 and all(p.columns == ["session_id", "ref", "cluster"] and p.count() == 4 for p in named.values())
    (tmp_path / "p").write_text('{"s": {"0": "c", "1": "c", "2": "d", "3": null}}')
    truth = e.select("session_id", "ref", "tag", (e.ord == 0).alias("important"))
    given = evaluate.summary(truth, {"labels": named["labels"], "file": readers.predictions(spark, str(tmp_path / "p"))}, "s").collect()
    assert {r.predictor: (r.sessions, round(r.f1, 6)) for r in given} == {"labels": (1, 1.0), "file": (1, round(2 * 1 / 6 / (1 + 1 / 6), 6))}


def test_labelled_sessions_of_a_file(spark, tmp_path):
    import json

    from chronolens.sources import readers

    session = {"id": "g1", "name": "n", "day": "2024-01-15", "tzOffsetMinutes": 60, "events": [{"ref": "e1", "type": "x"}, {"ref": "e2", "type": "y"}]}
    (tmp_path / "g1.json").write_text(json.dumps(session, indent=1))
    (tmp_path / "g2.json").write_text(json.dumps({**session, "id": "g2"}))
    rows = readers.labelled_sessions(spark, str(tmp_path), "ref:string,type:string", ["g1"]).orderBy("ord").collect()
    assert [(r.id, r.tz, r.ord, r.event.ref) for r in rows] == [("g1", 60, 0, "e1"), ("g1", 60, 1, "e2")]


def test_brief_of_a_context(spark):
    from chronolens.plans import export

    keys = "session_id string, work_day string, context long"
    card = spark.createDataFrame([("s", "d", 1, "working", 2, 2, "b.py"), ("s", "d", 1, "working", 1, 1, "a.py"), ("s", "d", 1, "ran", 1, 1, "make")], f"{keys}, bucket string, ts_ms long, ord long, label string")
    step = spark.createDataFrame([("s", "d", 1, "failing", "make")], f"{keys}, rule string, text string")
    assert [r.text for r in export.brief(card, step).collect()] == ["ran: make\nworking: a.py; b.py\nnext (failing): make"]


def test_days_move_once_each_and_titles_are_cut_once(spark):
    """Nothing moves by events or phrases: three tables move by days, and the fold finds them there."""
    from chronolens.plans.catalogue import QUERIES

    plan = QUERIES["engine_assignments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3, plan
    assert all("ord#" not in line and "norm#" not in line for line in exchanges), plan


def test_a_day_lies_in_one_batch():
    import pyarrow as pa

    rng = random.Random(5)
    days = [(s, d) for s in [None, *range(40)] for d in range(3)]
    keys = [k for k in days for _ in range(rng.choice([1, 2, 5, 60]))]
    table = pa.table({"s": pa.array([k[0] for k in keys], pa.int64()), "d": [k[1] for k in keys], "n": range(len(keys))})
    seen, at = [], 0
    for b, begins in engine._whole_days(iter(table.to_batches(max_chunksize=7))):
        got = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for i, j in zip(begins, begins[1:]):
            assert len(set(got[i:j])) == 1
            seen.append(got[i])
        assert b.column(2).to_pylist() == list(range(at, at := at + b.num_rows))
    assert at == len(keys) and seen == days


def test_contexts_count_names_as_sets_of_their_day(spark):
    """No aggregate in passes for distinct values, and titles are cut into phrases once for the subjects."""
    from chronolens.plans.catalogue import engine_events

    events = engine_events(spark, "/root/testdata/sf0.001")
    anchors = engine.all_anchors(events).localCheckpoint()
    assigned = engine.assignments(events, anchors=anchors).localCheckpoint()
    plan = engine.contexts_frame(events, assigned, anchors)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan
    assert sum("Generate explode" in line and "Codex" not in line and "sequence(0" in line for line in plan.splitlines()) == 1, plan


def test_rollup_hands_on_few_rows_a_context_and_texts_are_cut_once(spark):
    from chronolens.operators import answer, corpus
    from chronolens.plans import asking

    ranked = spark.createDataFrame([("a", k, kind, float(s), 0) for k, kind, s in [(1, "window", 9), (2, "window", 8), (3, "note", 7), *((n, "note", 7 - n) for n in range(4, 12))]] + [("b", 20, None, 1.0, 0), ("b", 21, "note", 0.5, 0), ("c", 30, "note", 2.0, 0), ("c", 31, "window", 1.0, 0)], "context string, key long, kind string, score double, last_ms long")
    contexts = spark.createDataFrame([(c, 0, 1) for c in "abcd"], "context string, start long, end long")
    out = answer.rollup(contexts, ranked, ["context"])
    assert {r.context: (r.score, r.highlights) for r in out.collect()} == {"a": (9.0, [1, 3, 4, 5, 6, 7]), "b": (1.0, [20, 21]), "c": (2.0, [30]), "d": (0.0, [])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # two limits, each before and after its shuffle

    rows = spark.createDataFrame([(1, ["the", "thesis", "x"]), (2, ["license"]), (3, None)], "doc_id long, tokens array<string>")
    assert {r.doc_id: r.tokens for r in corpus.narrowed(rows, ["the", "x"]).collect()} == {1: ["the", "thesis", "x"], 2: [], 3: None}
    assert "documents.parquet" not in str([line for line in asking.ask_rollup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines() if "text" in line])
