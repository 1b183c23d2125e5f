"""Days computed anew, replaced sessions: batches that are late, delivered again and run again."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronolens.sources import days, sessions, store


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def rows(*of):
    """(ord, day number, value)"""
    return [(o, day(d) if d is not None else None, v) for o, d, v in of]


SCHEMA = "ord long, work_day date, value long"


def by_day(df):
    return df.groupBy("work_day").agg(F.sum("value").alias("total"), F.count("*").alias("n")).where("total > 0")


def snapshot(df):
    return sorted(map(tuple, df.select("work_day", "total", "n").collect()))


def test_touched_days_follow_the_store(spark, tmp_path):
    path, target = f"file://{tmp_path}/store", f"file://{tmp_path}/days"
    follow = days.following(path, target, ["ord"], by_day)
    batches = [
        rows((1, 0, 5), (2, 0, 7), (3, 1, 1), (9, None, 100)),
        rows((4, 1, 2), (1, 0, 5), (5, 30, 9)),  # late, and one delivered again
        rows((2, 0, 70), (6, 30, 1), (6, 30, 1)),  # changed, and twice in a batch
        rows((5, 30, 0), (6, 30, 0)),  # a day whose result goes
    ]
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, SCHEMA)
        follow(frame, number)
        whole = snapshot(by_day(days.latest(days.stored(spark, path), ["ord"])))
        assert snapshot(days.results(spark, target)) == whole
        files = sorted(str(p) for p in (tmp_path / "store").rglob("part-*"))
        follow(frame, number)  # runs again
        assert snapshot(days.results(spark, target)) == whole and len(sorted((tmp_path / "store").rglob("part-*"))) == len(files)
    assert whole == [(day(0), 75, 2), (day(1), 3, 2)] and not (tmp_path / "days" / f"work_day={day(30)}").exists()
    follow(spark.createDataFrame([], SCHEMA), 9)
    assert snapshot(days.results(spark, target)) == whole


def test_reading_is_pruned_to_the_days(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    days.put(spark.createDataFrame(rows(*((i, i % 20, i) for i in range(200))), SCHEMA), 0, path)
    some = days.stored(spark, path, [day(3), day(4)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [work_day" in plan.replace("isnotnull(work_day#", "work_day#") or "PartitionFilters: [cast(work_day" in plan
    read = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert some.count() == 20
    files = {r[0].split("/")[-3] for r in some.select(F.input_file_name()).distinct().collect()}
    assert files == {f"work_day={day(3)}", f"work_day={day(4)}"} and read is not None


def test_only_touched_days_are_written(spark, tmp_path):
    path, target = f"file://{tmp_path}/store", f"file://{tmp_path}/days"
    follow = days.following(path, target, ["ord"], by_day)
    follow(spark.createDataFrame(rows((1, 0, 5), (2, 1, 5)), SCHEMA), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "days" / f"work_day={day(0)}").iterdir()}
    follow(spark.createDataFrame(rows((3, 1, 5)), SCHEMA), 1)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "days" / f"work_day={day(0)}").iterdir()} == before


def test_batches_of_a_day_are_folded(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for n in range(5):
        days.put(spark.createDataFrame(rows((n, 0, n), (1, 0, n * 10), (50 + n, n, 1)), SCHEMA), n, path)
    want = sorted(map(tuple, days.latest(days.stored(spark, path), ["ord"]).collect()))
    assert days.crowded(spark, path, 4) == [day(0)]
    days.fold(spark, path, [day(0)], ["ord"])
    assert sorted(map(tuple, days.latest(days.stored(spark, path), ["ord"]).collect())) == want
    assert len(list((tmp_path / "store" / f"work_day={day(0)}").glob("batch=*"))) == 1 and days.crowded(spark, path, 1) == []


def test_stream_follows_over_a_restart(spark, tmp_path):
    path, target, source = f"file://{tmp_path}/store", f"file://{tmp_path}/days", tmp_path / "in"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        q = stream.writeStream.foreachBatch(days.following(path, target, ["ord"], by_day)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for n, batch in enumerate([[(1, 0, 5), (2, 1, 1)], [(3, 0, 5), (1, 0, 5)], [(4, 2, 1)]]):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"ord": o, "work_day": str(day(d)), "value": v}) for o, d, v in batch))
        run()
        assert snapshot(days.results(spark, target)) == snapshot(by_day(days.latest(days.stored(spark, path), ["ord"])))
    assert snapshot(days.results(spark, target)) == [(day(0), 10, 2), (day(1), 1, 1), (day(2), 1, 1)]


# replaced sessions


@pytest.fixture()
def table(spark, tmp_path):
    name = f"sessions_{tmp_path.name.replace('-', '_')}"
    path = f"file://{tmp_path}/{name}"
    sessions.create(spark, name, path, "session STRING, ts_ms BIGINT, x INT", ["session"], ["ts_ms"], 8)
    yield name, path
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def put(spark, table, number, *of):
    sessions.put(spark.createDataFrame(list(of), "session string, ts_ms long, x int"), number, table[0], ["session"], 8)


def held(spark, table):
    return sorted((r.session, r.ts_ms, r.x) for r in sessions.current(spark, table[0], ["session"]).collect())


def test_sessions_are_replaced(spark, table):
    put(spark, table, 0, ("a", 1, 1), ("a", 2, 2), ("b", 1, 3), (None, 1, 0))
    assert held(spark, table) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
    for _ in range(2):  # runs again
        put(spark, table, 1, ("a", 9, 9), ("c", 1, 1), ("c", 1, 1))
    want = [("a", 9, 9), ("b", 1, 3), ("c", 1, 1), ("c", 1, 1)]
    assert held(spark, table) == want
    put(spark, table, 2, ("b", 1, 3))  # delivered again
    assert held(spark, table) == want and sessions.versions(spark, table[0]) == [0, 1, 2]
    sessions.fold(spark, table[0], table[1], ["session"], least=1, buckets=8)
    assert held(spark, table) == want and sessions.versions(spark, table[0]) == [0, 2]
    sessions.fold(spark, table[0], table[1], ["session"], buckets=8)
    assert held(spark, table) == want and sessions.versions(spark, table[0]) == [2]
    put(spark, table, 3, ("a", 1, 0))
    assert held(spark, table) == [("a", 1, 0), *want[1:]]


def test_sessions_after_a_restart(spark, table):
    put(spark, table, 0, ("a", 1, 1))
    put(spark, table, 1, ("a", 2, 2))
    spark.sql(f"DROP TABLE {table[0]}")  # of the catalogue only: the folder is the user's
    sessions.create(spark, table[0], table[1], "session STRING, ts_ms BIGINT, x INT", ["session"], ["ts_ms"], 8)
    assert held(spark, table) == [("a", 2, 2)]


def test_half_done_fold_changes_nothing(spark, table, monkeypatch):
    put(spark, table, 0, ("a", 1, 1), ("b", 1, 1))
    put(spark, table, 1, ("a", 2, 2))
    monkeypatch.setattr(sessions, "drop_folder", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sessions.fold(spark, table[0], table[1], ["session"], buckets=8)
    spark.sql(f"ALTER TABLE {table[0]} RECOVER PARTITIONS")
    assert held(spark, table) == [("a", 2, 2), ("b", 1, 1)]
    monkeypatch.undo()
    sessions.fold(spark, table[0], table[1], ["session"], buckets=8)
    assert held(spark, table) == [("a", 2, 2), ("b", 1, 1)]


def test_store_is_not_moved_and_buckets_are_pruned(spark, table):
    put(spark, table, 0, *((f"s{i}", i, i) for i in range(500)))
    put(spark, table, 1, *((f"s{i}", i, -i) for i in range(0, 500, 3)))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sessions.current(spark, table[0], ["session"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        some = sessions.of_sessions(spark, table[0], "session", ["s3", "s4"])
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and ("SelectedBucketsCount: 2 out of 8" in plan or "SelectedBucketsCount: 1 out of 8" in plan)
        assert sorted((r.session, r.x) for r in some.collect()) == [("s3", -3), ("s4", 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_append_splits_large_days(spark, tmp_path):
    """One day of many rows isn't one writing task."""
    e = spark.range(200_000).select(F.col("id").alias("ord"), F.col("id").alias("ts_ms"), F.lit("2024-01-15").alias("work_day"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit(True).alias("redaction_ok"))
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        store.append(e.repartition(4), str(tmp_path / "e"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert len(list((tmp_path / "e" / "work_day=2024-01-15").glob("part-*"))) > 1 and store.read(spark, str(tmp_path / "e")).count() == 200_000


def test_sessions_as_files_are_few_files(spark, monkeypatch):
    """However many sessions: lines of small files are kept in a table, files that may hold several sessions do."""
    from pathlib import Path

    from chronolens.plans import streams

    for name in ("agent_files", "rollout_files", "thread_index", "spooled_commands", "labelled_files", "predicted_files"):
        made = []

        def fresh(*args):
            made.append(f"/tmp/{name}-{__import__('uuid').uuid4().hex}")
            return made[-1]

        monkeypatch.setattr(streams, "fresh_path", fresh)
        monkeypatch.setattr("chronolens.sources.staging.fresh_path", fresh)
        assert getattr(streams, name)(spark, "/root/testdata/sf0.01").count() > 0
        assert made and sum(1 for folder in made for _ in Path(folder).rglob("part-*")) <= 16
