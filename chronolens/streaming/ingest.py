"""Structured Streaming: focus samples to spans, repeated deliveries, work-day and session windows, versions of sessions. Days computed anew are in sources/days.py.

State is kept by stream (one device or shell) and is a few values; late data is what the watermark says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.events import span_importance, title_key
from ..functions.time import work_day
from ..operators.intervals import pause_gate
from ..sources.staging import fresh_path

IDLE_MS = 5 * 60_000
LATE = "6 hours"
SPAN = "stream_id string, app string, title string, start_ms long, end_ms long"
SAMPLE = ["ts_ms", "app", "title", "key", "idle_ms"]
OPEN = "app string, title string, key string, start_ms long, seen_ms long"


def _fold(stream_id: str, samples: pd.DataFrame, held: tuple | None, idle_ms: int) -> tuple[list[tuple], tuple | None]:
    """fold() of a frame's columns SAMPLE."""
    return fold(stream_id, samples[SAMPLE].itertuples(index=False, name=None), held, idle_ms)


def fold(stream_id: str, samples: Iterable[tuple], held: tuple | None, idle_ms: int) -> tuple[list[tuple], tuple | None]:
    """Closed spans and what stays open, after samples (ts_ms, app, title, key, idle_ms), taken in order of time. A span ends at the sample that has another key, or at the last input before a pause of idle_ms."""
    done = []
    close = lambda end: done.append((stream_id, held[0], held[1], held[3], max(held[3], end)))
    for ts, app, title, key, idle in sorted(samples, key=lambda s: s[0]):
        if held and ts < held[4]:
            continue  # later samples were taken in before
        if held and (idle >= idle_ms or ts - held[4] >= idle_ms):
            close(ts - idle if idle >= idle_ms else held[4])
            held = None
        if idle >= idle_ms:
            continue
        if held and held[2] != key:
            close(ts)
            held = None
        held = (*held[:4], ts) if held else (app, title, key, ts, ts)
    return done, held


def focus_spans(samples: DataFrame, late: str = "1 minute", idle_ms: int = IDLE_MS) -> DataFrame:
    """samples (a stream): stream_id, ts (timestamp), app, title, idle_ms (since the last input). Spans of one application and title, with importance, as they close; a silent stream's span closes by event time."""
    ms = F.unix_millis("ts")
    key = F.concat_ws("|", F.coalesce("app", F.lit("")), title_key(F.coalesce("title", F.lit(""))))
    rows = samples.where("ts is not null").withWatermark("ts", late).select("stream_id", "ts", ms.alias("ts_ms"), "app", "title", key.alias("key"), F.coalesce("idle_ms", F.lit(0)).cast("long").alias("idle_ms"))

    def run(name, frames, state: GroupState):
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(name[0], held[0], held[1], held[3], max(held[3], held[4]))], columns=["stream_id", "app", "title", "start_ms", "end_ms"])
            return
        got = [f for f in frames if len(f)]
        done, held = _fold(name[0], pd.concat(got), held, idle_ms) if got else ([], held)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(held[4] + idle_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["stream_id", "app", "title", "start_ms", "end_ms"])

    spans = rows.groupBy("stream_id").applyInPandasWithState(run, SPAN, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    return spans.withColumn("importance", span_importance(F.col("end_ms") - F.col("start_ms")))


def deduplicated(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """events (a stream with ts) whose keys haven't been seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Session windows of a stream: keys, start_ms, end_ms (of the last event), n."""
    ms = F.unix_millis("ts")
    grouped = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.count("*").alias("n"))
    return grouped.drop("session_window")


def day_counts(events: DataFrame, tz_minutes: int, late: str = LATE) -> DataFrame:
    """Events of each work day (04:00 to 04:00 local): tumbling windows of a stream."""
    shift = f"{(4 * 60 - tz_minutes) % 1440} minutes"
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", shift)).agg(F.count("*").alias("events"))
    return days.select(work_day(F.unix_millis(F.col("window.start")), F.lit(tz_minutes)).alias("work_day"), "events")


def versions_to(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each batch under its number. A batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def current(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with a version, those of each key's latest: what grew is replaced as a whole."""
    last = versions.groupBy(*keys).agg(F.max("version").alias("version"))
    return versions.join(last, [*keys, "version"], "left_semi")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now: written to the shared folder in append mode, and read back."""
    spark: SparkSession = stream.sparkSession
    root = fresh_path(spark, f"stream-{name}")
    started = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/rows")
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def outside_pauses(stream: DataFrame, pauses: DataFrame, keys: list[str]) -> DataFrame:
    """The stream without events inside a pause (keys, from_ms, until_ms; null until_ms: still paused). They are read and dropped, so that nothing arrives late when the pause ends.

    pauses is a table: each batch sees it as it is then. The anti-join is stream against table, an equi-join on keys."""
    return pause_gate(stream, pauses, keys)


def latest_before(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The newest sample of each key, by ts_ms then ord."""
    by = Window.partitionBy(*keys).orderBy(F.desc("ts_ms"), F.desc("ord"))
    return samples.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
