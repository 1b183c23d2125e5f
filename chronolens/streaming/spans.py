"""Focus spans by state and timers of event time, kept in RocksDB.

One value a stream (device) is the span that is open, one list the samples that wait for the watermark, and one timer says when either is next to be looked at: when
the open span has been idle for long enough, or when the oldest waiting sample is passed by the watermark. A span that a timer closes ends when its stream was last heard of,
which lies before the timer. State goes with the span, so a device that falls silent leaves nothing behind. (A time to live isn't given: Spark has it for processing time only.)

settled = False takes samples in as they come; of one that comes after later ones of an earlier batch nothing can be told any more, and it is left out, as
in ingest.focus_spans. settled = True lets samples wait until the watermark has passed them, so that whatever order they come in within the watermark, the spans are those of the order of time.

Samples of a stream that are taken in together are held at once: those of one trigger, at a sample a second, and with settled = True those of the watermark's delay besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.events import span_importance, title_key
from .ingest import IDLE_MS, OPEN, SPAN, fold

WAITING = "ts_ms long, app string, title string, key string, idle_ms long"
COLUMNS = [c.split()[0] for c in WAITING.split(", ")]
FOUND = Row(*(c.split()[0] for c in SPAN.split(", ")))
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, as timers need; a checkpoint remembers it."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


class Spans(StatefulProcessor):
    def __init__(self, idle_ms: int, settled: bool):
        self.idle_ms, self.settled = idle_ms, settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getListState("waiting", WAITING)

    def _advance(self, key, fresh: list[tuple], now: int, fired: bool) -> Iterator[Row]:
        """fired: by the stream's timer, which Spark takes away itself. Each call of the state is a round trip, so none is made whose answer is known: without state there is no timer."""
        waited = self.settled and self.waiting.exists()
        samples = [*self.waiting.get(), *fresh] if waited else fresh
        ready = [s for s in samples if s[0] <= now] if self.settled else samples
        later = [s for s in samples if s[0] > now] if self.settled else []
        was = self.open.get()
        done, held = fold(key[0], ready, tuple(was) if was else None, self.idle_ms)
        first = min((s[0] for s in later), default=None)
        if held and held[4] + self.idle_ms <= now and (first is None or first > now):
            done.append((key[0], held[0], held[1], held[3], max(held[3], held[4])))
            held = None
        if held:
            self.open.update(held)
        elif was:
            self.open.clear()
        if later:
            self.waiting.put(later)
        elif waited:
            self.waiting.clear()
        if (was or waited) and not fired:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        wanted = [t for t in (first, held[4] + self.idle_ms if held else None) if t is not None]
        if wanted:
            self.handle.registerTimer(max(min(wanted), now + 1))
        yield from (FOUND(*span) for span in done)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [tuple(r[c] for c in COLUMNS) for r in rows], timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def focus_spans(samples: DataFrame, late: str = "1 minute", idle_ms: int = IDLE_MS, settled: bool = False) -> DataFrame:
    """samples (a stream): stream_id, ts (timestamp), app, title, idle_ms (since the last input). Spans of one application and title, with importance, as they close. To be started within rocksdb()."""
    key = F.concat_ws("|", F.coalesce("app", F.lit("")), title_key(F.coalesce("title", F.lit(""))))
    rows = samples.where("ts is not null").withWatermark("ts", late).select("stream_id", "ts", F.unix_millis("ts").alias("ts_ms"), "app", "title", key.alias("key"), F.coalesce("idle_ms", F.lit(0)).cast("long").alias("idle_ms"))
    spans = rows.groupBy("stream_id").transformWithState(Spans(idle_ms, settled), SPAN, "append", "EventTime")
    return spans.withColumn("importance", span_importance(F.col("end_ms") - F.col("start_ms")))
