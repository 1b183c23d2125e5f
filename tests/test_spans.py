"""Focus spans by timers: as ingest.focus_spans, over restarts, out of order, and silent streams."""

import json
import random

import pandas as pd
import pytest

from chronolens.streaming import ingest, spans

SCHEMA = "stream_id string, ts timestamp, app string, title string, idle_ms long"
BASE = 1_705_309_200


@pytest.fixture()
def fed(spark, tmp_path):
    """feed(rows) puts a file of (stream, second, app) and runs the query over it, from the checkpoint; got() gives what it has written."""
    (tmp_path / "in").mkdir()

    def feed(rows, make=spans.focus_spans, name="x", **how):
        n = len(list((tmp_path / "in").iterdir()))
        (tmp_path / "in" / f"{n:03d}.json").write_text("\n".join(json.dumps({"stream_id": s, "ts": pd.Timestamp(BASE + t, unit="s").isoformat() + "Z", "app": a, "title": "t", "idle_ms": 0}) for s, t, a in rows))
        again(make, name, **how)

    def again(make=spans.focus_spans, name="x", **how):
        samples = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        with spans.rocksdb(spark):
            q = make(samples, **how).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state-{name}").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out-{name}")
            q.awaitTermination()

    def got(name="x"):
        rows = spark.read.schema(f"{ingest.SPAN}, importance int").parquet(f"{tmp_path}/out-{name}").collect()
        return sorted((r.stream_id, r.app, r.start_ms // 1000 - BASE, r.end_ms // 1000 - BASE) for r in rows)

    feed.again, feed.got = again, got
    return feed


def test_a_span_goes_on_over_a_restart(fed):
    fed([("d", 0, "x"), ("d", 10, "x")])
    assert fed.got() == []
    fed([("d", 20, "x"), ("d", 30, "y"), ("e", 30, "z")])  # another run of the query, in the middle of the span
    assert fed.got() == [("d", "x", 0, 30)]
    fed([("d", 40, "x")])
    assert fed.got() == [("d", "x", 0, 30), ("d", "y", 30, 40)]
    fed.again()
    assert len(fed.got()) == 2


def test_timers_close_silent_streams_and_date_back(fed):
    fed([("d", 0, "x"), ("d", 50, "x"), ("e", 0, "y")])
    fed([("e", 2_000, "y")])  # moves the watermark far on
    fed([("e", 2_001, "y")])
    assert ("d", "x", 0, 50) in fed.got() and ("e", "y", 0, 0) in fed.got() and len(fed.got()) == 2


def test_same_rows_as_the_tuple_of_state(fed, spark):
    rng, t, batches = random.Random(3), 0, []
    for _ in range(6):
        batch = []
        for _ in range(25):
            t += rng.choice([1, 1, 2, 30, 400])
            batch += [(s, t, rng.choice("xxyz")) for s in rng.sample(["d", "e", "f"], 2)]
        batches.append(batch)
    for b in batches:
        fed(b)
    fed.again(ingest.focus_spans, "old")
    assert fed.got("old") == fed.got() and len(fed.got()) > 50


def test_settled_spans_are_those_of_the_order_of_time(fed):
    rng = random.Random(8)
    rows = [("d", 3 * i, rng.choice("xxxy")) for i in range(200)]
    held = pd.DataFrame([((BASE + t) * 1000, a, "t", f"{a}|t", 0) for _, t, a in rows], columns=spans.COLUMNS)
    want, _ = ingest._fold("d", held, None, ingest.IDLE_MS)
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 45))
    for k in range(0, 200, 20):
        fed(mixed[k : k + 20], settled=True)
    fed([("z", 5_000, "x")], settled=True)
    fed([("z", 5_001, "x")], settled=True)
    got = [g for g in fed.got() if g[0] == "d"]
    assert set(got) >= {("d", a, s // 1000 - BASE, e // 1000 - BASE) for _, a, _, s, e in want} and len(got) == len(want) + 1


def test_bursts_and_day_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"k": k, "ts": pd.Timestamp(BASE + s, unit="s").isoformat() + "Z"} for k, s in [("a", 0), ("a", 60), ("a", 4_000), ("b", 0), ("a", 400_000), ("b", 90_000)]]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "in"))
    got = sorted((r.k, r.start_ms // 1000 - BASE, r.end_ms // 1000 - BASE, r.n) for r in ingest.drained(ingest.bursts(stream(), ["k"], late="1 second"), "b").collect())
    assert got == [("a", 0, 60, 2), ("a", 4_000, 4_000, 1), ("b", 0, 0, 1), ("b", 90_000, 90_000, 1)]  # the last one of `a` is still open
    days = {str(r.work_day): r.events for r in ingest.drained(ingest.day_counts(stream(), 60, "1 second"), "d").collect()}
    assert days == {"2024-01-15": 4, "2024-01-16": 1}


def test_pauses_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"k": k, "ts_ms": t}) for k, t in [("a", 5), ("a", 15), ("a", 99), ("b", 15), (None, 15)]))
    pauses = spark.createDataFrame([("a", 10, 20), ("a", 90, None)], "k string, from_ms long, until_ms long")
    stream = spark.readStream.schema("k string, ts_ms long").json(str(tmp_path / "in"))
    got = ingest.drained(ingest.outside_pauses(stream, pauses, ["k"]), "p").collect()
    assert sorted((r.k or "", r.ts_ms) for r in got) == [("", 15), ("a", 5), ("b", 15)]


def test_latest_before(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 0, 0, "w")], "k string, ts_ms long, ord long, v string")
    assert sorted((r.k, r.v) for r in ingest.latest_before(df, ["k"]).collect()) == [("a", "z"), ("b", "w")]


def test_a_new_stream_costs_three_calls_of_the_state():
    """What is known is not asked for: a stream without state has no timer, and samples that don't wait have no list. Spans come as rows."""
    from types import SimpleNamespace

    calls = []
    note = lambda name, value=None: lambda *_: calls.append(name) or value
    state = SimpleNamespace(exists=note("exists", False), get=note("get"), update=note("update"), clear=note("clear"), put=note("put"))
    handle = SimpleNamespace(getValueState=lambda *_: state, getListState=lambda *_: state, listTimers=note("listTimers", iter([])), deleteTimer=note("deleteTimer"), registerTimer=note("registerTimer"))
    made = spans.Spans(300_000, False)
    made.init(handle)
    rows = [spans.Row("stream_id", *spans.COLUMNS)("d", t, a, None, a, 0) for t, a in [(5_000, "y"), (0, "x")]]
    got = list(made.handleInputRows(("d",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert [r.asDict() for r in got] == [{"stream_id": "d", "app": "x", "title": None, "start_ms": 0, "end_ms": 5_000}]
    assert calls == ["get", "update", "registerTimer"]
