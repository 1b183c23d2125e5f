"""Token ids in sorted-string-table shards.

Shard file: data blocks, then the block index, a Bloom filter and a fixed-size footer.
- Entry: shared key length (1 byte), own key length (1 byte), value length (4 bytes), rest of the key, value. The key is
  doc_id as 8 big-endian bytes with its sign bit flipped, so that bytes sort as numbers; a null doc_id has the empty key
  and comes first. The value is the ids as little-endian unsigned 16- or 32-bit integers.
- Block: entries (each RESTART-th holds its whole key), the restarts' offsets, their number; compressed with zstd; then CRC-32.
- Block index: for each block its last key's length, that key, offset, stored length, plain length.
- Bloom filter: BLOOM_BITS bits a key, BLOOM_HASHES probes by double hashing.
- Footer: offsets and lengths of index and filter, numbers of entries and ids, width of an id, magic.

Writing: rows are range-partitioned by (doc_id, hash of the text), sorted, encoded and written by the tasks to the folder that all
executors share. A file's name holds a fresh number, and only files in the manifest (one row for each shard, written once by
Spark) count, so a task may run again after a loss. Reading goes block by block; looking a key up asks the filter, finds
the block by bisection of the sparse index and the entry by bisection of the block's restarts.

Nulls: a null text counts as empty and has only the end id. Repeated doc_ids are neighbours, ordered by the hash of their texts.
An empty table gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, row_key, staged, text_of
from .wordcache import FragmentCache

MAGIC = b"CLSSTB01"
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 64 * 1024, 16, 10, 7
#: Without such characters, Unicode's composition changes nothing and lower-casing goes character by character.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
PUNCTUATION_RUN = re.compile(r"[^\w\s]{2}|[_\x1c-\x1f]")
FOOTER = struct.Struct("<QQQQQQB8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<BQII")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.index, self.keys, self.n_ids, self.entries = [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last, self.in_block = key, self.in_block + 1
        self.entries, self.n_ids = self.entries + 1, self.n_ids + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        if not self.in_block:
            return
        plain = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        stored = pa.compress(plain, codec="zstd", asbytes=True)
        stored += struct.pack("<I", zlib.crc32(stored))
        self.index.append((self.last, self.at, len(stored), len(plain)))
        self._write(stored)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        for key, at, stored, plain in self.index:
            self._write(INDEX.pack(len(key), at, stored, plain) + key)
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys) // 8 * 8 + 8)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[probes(key, bits)] = True
        self._write(np.packbits(bloom).tobytes())
        self._write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.entries, self.n_ids, self.width, MAGIC))


class ShardReader:
    """Reads one shard; `source` has size(), seek() and read(), as Arrow's files do."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        index_at, index_len, bloom_at, bloom_len, self.entries, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        raw, i, self.blocks = self._read(index_at, index_len), 0, []
        while i < len(raw):
            n, at, stored, plain = INDEX.unpack_from(raw, i)
            i += INDEX.size
            self.blocks.append((raw[i : i + n], at, stored, plain))
            i += n
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, bloom_len), np.uint8)).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, stored, plain = self.blocks[k]
        data = self._read(at, stored)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        data = pa.decompress(data[:-4], decompressed_size=plain, codec="zstd", asbytes=True)
        n = struct.unpack("<I", data[-4:])[0]
        return data[: -4 - 4 * n], list(struct.unpack(f"<{n}I", data[-4 - 4 * n : -4]))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, own, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield key, np.frombuffer(value, f"<u{self.width}")

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of a key, all of them if it is repeated."""
        if not self.bloom[probes(key, len(self.bloom))].all():
            return []
        found = []
        for k in range(bisect_left(self.blocks, key, key=lambda b: b[0]), len(self.blocks)):
            data, restarts = self._block(k)
            whole = [data[r + ENTRY.size : r + ENTRY.size + data[r + 1]] for r in restarts]
            for own, value in self._entries(data, restarts[max(0, bisect_left(whole, key) - 1)]):
                if own == key:
                    found.append(np.frombuffer(value, f"<u{self.width}"))
                elif own > key:
                    return found
        return found


class WordEncoder:
    """Encodes with a tokenizer that drops white space and never looks across it: texts are split at ASCII blanks, and the ids of recent pieces are kept."""

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = FragmentCache(self._encode)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: many are encoded in a row, a blank between them, and told apart by where their tokens begin."""
        rows = [pieces[i : i + 100] for i in range(0, len(pieces), 100)]
        out = []
        for row, e in zip(rows, self.tokenizer.encode_batch([" ".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, f"<u{self.width}")
            begins = np.array([a for a, _ in e.offsets], np.int64)
            ends = np.searchsorted(begins, np.cumsum([len(x) + 1 for x in row]), "left").tolist()
            out += [ids[i:j].tobytes() for i, j in zip([0, *ends], ends)]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces, ends = [], [0]
        for text in texts:
            if not BEYOND_LATIN.search(text) and "<|" not in text:  # as the tokenizer does first; its special tokens' strings are told apart by case
                text = text.lower()
                if not PUNCTUATION_RUN.search(text):  # a single mark is a piece of its own
                    text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
            pieces += text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            ends.append(len(pieces))
        values = self.cache.get_all(pieces)
        return [b"".join(values[i:j]) for i, j in zip(ends, ends[1:])]


@functools.cache
def word_encoder(path: str, width: int) -> WordEncoder:
    """One for each Python worker, which Spark uses for many tasks; so the cache stays warm."""
    return WordEncoder(path, width)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) and return the manifest: path, entries, n_tokens, first_id, first_key (hash of the first text), last_id; one row a shard."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select("doc_id", text_of().alias("text"), row_key(text_of()).alias("key"))
    rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")

    def encoded(batch, encoder, chars=300_000):
        """(doc_id, key, ids) of each row, encoded in groups of about so many characters."""
        group, held = [], 0
        for row in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), batch.column(2).to_pylist()):
            group.append(row)
            held += len(row[1])
            if held >= chars:
                yield from zip([r[0] for r in group], [r[2] for r in group], encoder.encode_all([r[1] for r in group]))
                group, held = [], 0
        yield from zip([r[0] for r in group], [r[2] for r in group], encoder.encode_all([r[1] for r in group]))

    def write(batches):
        store = writer = path = None
        first = last = None
        encoder, end = word_encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for doc_id, key, ids in encoded(batch, encoder):
                if writer is None:
                    store, root = pafs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.sst"
                    out = store.open_output_stream(path)
                    writer, first = ShardWriter(out, width), (doc_id, key)
                writer.add(key_of(doc_id), ids + end)
                last = doc_id
        if writer is not None:
            writer.close()
            out.close()
            name = f"{folder}/{path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist([{"path": name, "entries": writer.entries, "n_tokens": writer.n_ids, "first_id": first[0], "first_key": first[1], "last_id": last}], schema)

    schema = pa.schema([("path", pa.string()), ("entries", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("first_key", pa.int64()), ("last_id", pa.int64())])
    return staged(rows.mapInArrow(write, "path string, entries long, n_tokens long, first_id long, first_key long, last_id long"), "shard-manifest")


def open_shard(path: str) -> ShardReader:
    store, name = pafs.FileSystem.from_uri(path)
    return ShardReader(store.open_input_file(name))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files. The running sum is over one row for each shard."""
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base")
    n = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                out, at = [], int(base)
                for key, ids in open_shard(path):
                    out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) >= 10_000:
                        yield frame(out)
                        out = []
                yield frame(out)

    def frame(rows):
        done = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        return done.astype({"doc_id": "Int64"})

    return placed.repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the documents in wanted (doc_id), one row (doc_id, ids) for each stored entry: keys go to the shards whose range holds them."""
    spans = manifest.select("path", "first_id", "last_id")
    asked = wanted.select("doc_id").distinct()
    inside = F.col("doc_id").between(F.col("first_id"), F.col("last_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNull()) | (F.col("first_id").isNull() & (F.col("doc_id") <= F.col("last_id")))

    def find(_, rows: pd.DataFrame) -> pd.DataFrame:
        shard = open_shard(rows["path"].iloc[0])
        out = [(d, ids.astype("int64").tolist()) for d in rows["doc_id"] for ids in shard.get(key_of(None if pd.isna(d) else int(d)))]
        return pd.DataFrame(out, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})

    return asked.join(F.broadcast(spans), inside).groupBy("path").applyInPandas(find, "doc_id long, ids array<long>")
