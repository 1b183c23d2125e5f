"""Log files as a stream: lines behind the byte that was read last, file by file.

A source of Spark's Python data source API. Its offset, kept in the stream's checkpoint, holds for each file the byte behind the last whole line, so that each line is given exactly
once over any restart; a line that isn't finished yet waits for its line feed. A file that became shorter, or in which no line ends where the offset points, has been
rewritten: its offset jumps to the new end, and nothing of it is given a second time. (One that was rewritten and has a line ending just there can't be told from
one that grew.) A file that vanished is forgotten.

The driver looks at sizes and at the last bytes of files that changed; lines are read by tasks, large files in pieces of PIECE bytes. Bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.events import reflog_action
from ..operators.intervals import changes_only

SCHEMA = "file string, at long, first boolean, value string"
PIECE, TAIL, BATCH_LINES = 64 << 20, 1 << 16, 10_000


class Piece(InputPartition):
    """Lines of a file that begin at `begin` to before `end`. start: where the file's unread part begins; until: where it ends."""

    def __init__(self, file: str, start: int, begin: int, end: int, until: int, first: bool):
        self.file, self.start, self.begin, self.end, self.until, self.first = file, start, begin, end, until, first


def whole_lines(store: pafs.FileSystem, path: str, size: int) -> int:
    """The byte behind the last line feed of the first `size` bytes."""
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - TAIL)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def pieces(start: dict, end: dict) -> list[Piece]:
    out = []
    for file, until in sorted(end.items()):
        begin = start.get(file, 0)
        out += [Piece(file, begin, at, min(at + PIECE, until), until, file not in start) for at in range(begin, until, PIECE)]
    return out


def lines(store: pafs.FileSystem, path: str, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line without its line feed) of a piece; none where the unread part doesn't begin at a line's begin."""
    with store.open_input_file(path) as f:
        if f.size() < piece.until or piece.start and f.read_at(1, piece.start - 1) != b"\n":
            return
        f.seek(max(piece.begin - 1, piece.start))
        at, rest = f.tell(), b""
        if piece.begin > piece.start:  # the line that a piece begins in belongs to the one before, unless it begins just there
            while at < piece.until:
                block = f.read(min(TAIL, piece.until - at))
                k = block.find(b"\n")
                if k >= 0:
                    at += k + 1
                    break
                at += len(block)
            f.seek(at)
        while at < piece.end:
            block = f.read(min(1 << 20, piece.until - at - len(rest)))
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if at >= piece.end:
                    return
                yield at, line
                at += len(line) + 1
            if not block:
                return


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.known = path, suffix, {}

    def _files(self) -> list[pafs.FileInfo]:
        store, root = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [info]
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        return [f for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        store, _ = pafs.FileSystem.from_uri(self.path)
        known = {}
        for f in self._files():
            seen = (f.size, f.mtime_ns)
            known[f.path] = self.known[f.path] if self.known.get(f.path, (None,))[0] == seen else (seen, whole_lines(store, f.path, f.size))
        self.known = known
        return {"ends": json.dumps({path: end for path, (_, end) in sorted(known.items())})}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(json.loads(start["ends"]), json.loads(end["ends"]))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("first", pa.bool_()), ("value", pa.string())])
        held: list[tuple[int, str]] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(held)), pa.array([a for a, _ in held], pa.int64()), pa.array([partition.first] * len(held)), pa.array([v for _, v in held], pa.string())], schema=schema)

        for at, line in lines(store, partition.file, partition):
            held.append((at, line.decode("utf-8", "replace")))
            if len(held) == BATCH_LINES:
                yield batch()
                held = []
        if held:
            yield batch()


class LineTail(DataSource):
    """Options: path (a file or folder as pyarrow's file systems name it, with its scheme), suffix (of the files' names; any)."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], self.options.get("suffix", ""))


def tailed(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """file, at (place of the line), first (whether the file was met in this batch), value: a stream of the files' lines."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", path).option("suffix", suffix).load()


def reflog_entries(rows: DataFrame, now_ms: int, days: int = 7, newest: int = 50) -> DataFrame:
    """Of a batch of reflog lines: file, at, ts_ms, kind, text, from, to of commits and checkouts. Of a file that is met for the first time, its last `days` and the `newest` lines of these at most."""
    stamp = F.regexp_extract("value", r"> (\d+) [+-]\d{4}\t", 1).try_cast("long") * 1000
    read = rows.select("file", "at", "first", stamp.alias("ts_ms"), reflog_action(F.col("value")).alias("a")).where("ts_ms is not null")
    old = read.where(~F.col("first"))
    met = read.where(F.col("first") & (F.col("ts_ms") >= now_ms - days * 86_400_000))
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at")))).where(F.col("_n") <= newest).drop("_n")
    return old.unionByName(met).where("a.kind <> 'other'").select("file", "at", "ts_ms", "a.*")


def status_summaries(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, ts_ms, ord, dirty) of the number of changed files, where it differs from the sample before and isn't 0."""
    return changes_only(samples.where("dirty is not null"), keys, F.col("dirty")).where("dirty > 0")
