"""A shell's spool folder as a stream: one command a file, read once and then deleted.

Files are read whole, in batches of a bounded number; Spark deletes (or moves) them when the batch behind theirs begins, so that a batch that runs again still has its files, and the
checkpoint knows them, so that a restart gives none twice. Whether a file gives a row or not (torn, of another version, over six hours old, written while recording is paused), it goes.
The command and its folder are redacted, and what can't be redacted is dropped.

Every trigger is a beat: the query's progress holds how many files were read and how many commands they gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.redact import redact_fields, storable
from ..sources.readers import commands_of

BEAT = "spool"


def files(spark: SparkSession, path: str, suffix: str = ".cmd", a_batch: int = 1_000, archive: str | None = None) -> DataFrame:
    """file, value of the spool's files as they come. They are deleted once read, or moved below `archive`."""
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", a_batch)
    stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else stream.option("cleanSource", "delete")
    return stream.load(path).select(F.col("_metadata.file_path").alias("file"), "value").observe(BEAT, F.count("*").alias("files"))


def commands(stream: DataFrame, now_ms: Column | None = None, recording: Column | None = None) -> DataFrame:
    """ts_ms, exit_code, duration_ms, shell, cwd, command, redacted, of a stream of files. now_ms: the time of the batch unless given; recording: a condition on the row, true unless given."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    rows = commands_of(stream, now)
    rows = rows if recording is None else rows.where(F.coalesce(recording, F.lit(False)))
    return storable(redact_fields(rows, ["command", "cwd"])).drop("file")


def beat(query: StreamingQuery) -> tuple[str, int] | None:
    """Time of the last trigger that read files, and how many it read."""
    beats = [(p["timestamp"], p["observedMetrics"][BEAT]["files"]) for p in query.recentProgress if BEAT in (p["observedMetrics"] or {})]
    return beats[-1] if beats else None
