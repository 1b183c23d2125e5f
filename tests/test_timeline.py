"""Readers, streams and timeline operators on small fixtures; the catalogue against its SQL."""

import datetime as dt
import json

import duckdb
import pandas as pd
import pytest

from chronolens.operators import intervals, redact
from chronolens.plans import catalogue
from chronolens.sources import readers, store
from chronolens.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, dt.datetime):
        return x.date().isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and not hasattr(x, "as_integer_ratio"):
        return [_plain(v) for v in x]
    return f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio") else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cursor = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(str([_plain(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert sorted(str([_plain(r[c]) for c in cols]) for r in got.collect()) == want


def test_agent_sessions_skip_torn_lines(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s1", "timestamp": "2024-01-15T09:00:00Z", "cwd": "/w/a", "gitBranch": "HEAD", "isSidechain": False, "message": {"content": "plain"}, "secret": "x"},
        {"type": "assistant", "sessionId": "s1", "timestamp": "2024-01-15T09:05:00Z", "gitBranch": "main", "message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"a": 1}}, {"type": "tool_use", "name": "Run"}, {"type": "tool_use", "name": "Edit"}]}},
        {"type": "ai-title", "aiTitle": "first"},
        {"type": "ai-title", "aiTitle": "second"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"type": "torn')
    r = readers.agent_sessions(spark, str(tmp_path)).first()
    assert (r.session_id, r.cwd, r.branch, r.title, r.stamps, r.only_side) == ("s1", "/w/a", "main", "second", 2, False)
    assert r.last_ms - r.first_ms == 300_000 and [tuple(t) for t in r.tools] == [("Edit", 2), ("Run", 1)]
    assert tuple(readers.read_totals(readers.json_lines(spark, str(tmp_path), readers.AGENT_RECORD)).first()[1:]) == (4, 1)


def test_shell_spool(spark, tmp_path):
    (tmp_path / "a").write_text("v=1\nts=1000\nexit=2\nms=50\nshell=bash\ncwd=/w\ncmd=echo a=b\nsecond line\n")
    (tmp_path / "b").write_text("v=2\nts=1000\ncmd=ls\n")
    (tmp_path / "c").write_text("v=1\nts=5\ncmd=" + "x" * 500)
    (tmp_path / "d").write_text("v=1\nts=1000\ncmd=   \n")
    rows = {r.ts_ms: r for r in readers.shell_commands(spark, str(tmp_path)).collect()}
    assert set(rows) == {1000, 5}
    assert rows[1000].command == "echo a=b\nsecond line" and (rows[1000].exit_code, rows[1000].duration_ms, rows[1000].cwd) == (2, 50, "/w")
    assert len(rows[5].command) == 401 and rows[5].exit_code == -1
    assert readers.shell_commands(spark, str(tmp_path), now_ms=10**9).count() == 0


def test_reflog_and_indexes(spark, tmp_path):
    (tmp_path / "log").write_text(
        "0 1 A <a@b> 1705309200 +0100\tcommit: Fix it\n1 2 A <a@b> 1705309300 -0230\tcheckout: moving from main to fix/x\n2 3 A <a@b> 1705309400 +0000\treset: moving\ntorn\n"
    )
    rows = readers.reflog(spark, str(tmp_path / "log")).orderBy("ts_ms").collect()
    assert [(r.kind, r.text, r.to, r.tz) for r in rows] == [("commit", "Fix it", None, 60), ("checkout", None, "fix/x", -150)]
    assert readers.reflog(spark, str(tmp_path / "log"), now_ms=1_705_309_400_000, newest=1).count() == 1
    (tmp_path / "index").write_text('{"id": "a", "thread_name": "old"}\n{"id": "a", "thread_name": "new"}\n{"id": "a", "thread_name": " "}\n')
    assert [tuple(r) for r in readers.thread_names(spark, str(tmp_path / "index")).collect()] == [("a", "new")]
    (tmp_path / "p").write_text('{"s": {"e1": "c", "e2": null}}')
    assert {tuple(r) for r in readers.predictions(spark, str(tmp_path / "p")).collect()} == {("s", "e1", "c"), ("s", "e2", None)}


def test_focus_spans_fold():
    s = lambda *rows: pd.DataFrame(rows, columns=["ts_ms", "app", "title", "key", "idle_ms"])
    done, held = ingest._fold("d", s((0, "a", "t", "a", 0), (1000, "a", "t", "a", 0), (2000, "b", "u", "b", 0)), None, 300_000)
    assert done == [("d", "a", "t", 0, 2000)] and held[3:] == (2000, 2000)
    done, held = ingest._fold("d", s((1500, "a", "t", "a", 0), (400_000, "b", "u", "b", 350_000)), held, 300_000)
    assert done == [("d", "b", "u", 2000, 50_000)] and held is None
    done, held = ingest._fold("d", s((500_000, "b", "u", "b", 0), (900_000, "b", "u", "b", 0)), held, 300_000)
    assert done == [("d", "b", "u", 500_000, 500_000)] and held[3] == 900_000


def test_focus_spans_stream(spark, tmp_path):
    at = lambda s: f"2024-01-15T09:{s // 60:02d}:{s % 60:02d}Z"
    rows = [{"stream_id": "d", "ts": at(s), "app": a, "title": "t (3)" if s else "t", "idle_ms": 0} for s, a in [(0, "x"), (10, "x"), (20, "y"), (40, "x")]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    samples = spark.readStream.schema("stream_id string, ts timestamp, app string, title string, idle_ms long").json(str(tmp_path / "in"))
    got = ingest.drained(ingest.focus_spans(samples), "spans").orderBy("start_ms").collect()
    assert [(r.app, r.end_ms - r.start_ms, r.importance) for r in got][:2] == [("x", 20_000, 15), ("y", 20_000, 15)]


def test_versions_replace_sessions(spark, tmp_path):
    write = ingest.versions_to(str(tmp_path / "v"))
    write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, x int"), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        write(spark.createDataFrame([("a", 9)], "s string, x int"), 1)
    assert {(r.s, r.x) for r in ingest.current(spark.read.parquet(str(tmp_path / "v")), ["s"]).collect()} == {("a", 9), ("b", 3)}


def test_store_wants_redaction(spark, tmp_path):
    e = spark.createDataFrame([(1, 5, "2024-01-15", "x", True), (2, 6, "2024-01-15", "y", None)], "ord long, ts_ms long, work_day string, title string, redaction_ok boolean")
    with pytest.raises(ValueError):
        store.append(e.drop("redaction_ok"), str(tmp_path / "e"))
    store.append(e, str(tmp_path / "e"))
    assert [r.ord for r in store.read(spark, str(tmp_path / "e")).collect()] == [1]


def test_redaction_covers_all_fields(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    df = spark.createDataFrame([(f"use {key} now", None), ("plain", "")], "title string, command string")
    rows = redact.storable(redact.redact_fields(df, ["title", "command"])).collect()
    assert len(rows) == 2 and not any(key in (r.title or "") for r in rows) and any("[REDACTED:" in r.title for r in rows)


def test_intervals_on_empty_and_ties(spark):
    spans = spark.createDataFrame([("k", 0, 10), ("k", 0, 10), ("k", 10, 40_000)], "k string, start long, end long")
    assert intervals.covered_ms(spans, ["k"]).first().covered_ms == 40_000
    assert intervals.covered_ms(spans.limit(0), ["k"]).count() == 0


def test_shifted_keeps_gaps(spark):
    e = spark.createDataFrame([("s", 0, 10), ("s", 100, None)], "s string, ts_ms long, end_ms long")
    assert sorted(r.ts_ms for r in readers.shifted(e, 1000, ["s"]).collect()) == [900, 1000]
