"""Byte-level BPE by forced-boundary splitting.

Method. A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged, so a cut between
them is certain: the fragments on both sides are encoded independently and their ids concatenated. Whether a pair is such
a one is read from a 256 x 256 table made from the vocabulary, over the bytes of many documents at once. Cuts that could
change how the tokenizer's own pattern splits the text are left out: after white space (a run of white space is split
by what follows it), beside an apostrophe (contractions), inside a character and inside a special token's string, at
whose two ends there is always a cut. Fragments repeat, so the ids of recent ones are kept in a bounded cache.

Works for tokenizers without normaliser whose pre-tokenizer is the byte-level one with its pattern and no added space.

Nulls: a null text counts as empty: no ids, empty decoded text. Every input row gives one row; repeated rows, null ids and
empty tables need nothing special. Texts are encoded whole; a batch is worked through in blocks of about 1 MB (or one text).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .wordcache import FragmentCache

#: White space beyond ASCII, in UTF-8 (fixed values).
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
BLOCK_BYTES = 1_000_000


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        to_byte = byte_of_char()
        vocabulary = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        specials = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = max([*vocabulary, *specials]) + 1
        self.token_bytes = [specials.get(i, vocabulary.get(i, b"")) for i in range(size)]
        self.lengths = np.array([len(t) for t in self.token_bytes])
        self.decimal = [str(i) for i in range(size)]
        self.special = re.compile(b"|".join(map(re.escape, specials.values()))) if specials else None

        cut = np.ones((256, 256), bool)
        for token in vocabulary.values():
            b = np.frombuffer(token, np.uint8)
            cut[b[:-1], b[1:]] = False
        cut[[*range(9, 14), *range(28, 33), 0x27], :] = False
        cut[:, 0x27] = False
        cut[:, 0x80:0xC0] = False
        self.cut = cut.ravel()
        self.cache = FragmentCache(self._encode, cache)

    def _encode(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment. Those that begin with a blank and end in a byte after which a blank is a certain cut are encoded many in a row and told apart by their tokens' lengths."""
        apart = [not (x[:1] == b" " and self.cut[x[-1] << 8 | 0x20] and x[-1] < 0x80) for x in fragments]
        rows = [[x] for x, alone in zip(fragments, apart) if alone]
        joined = [x for x, alone in zip(fragments, apart) if not alone]
        rows += [joined[i : i + 100] for i in range(0, len(joined), 100)]
        found = self.tokenizer.encode_batch_fast([b"".join(r).decode("utf-8") for r in rows], add_special_tokens=False)
        own: dict[bytes, bytes] = {}
        for row, e in zip(rows, found):
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in row]), "left") + 1
            for x, i, j in zip(row, [0, *ends.tolist()], ends.tolist()):
                own[x] = ids[i:j].tobytes()
        return [own[x] for x in fragments]

    def cuts(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Sorted offsets of all cuts in data, whose texts end at `ends`, 0 and the end included."""
        b = np.frombuffer(data, np.uint8)
        at = np.zeros(len(b) + 1, bool)
        if len(b) > 1:
            at[1:-1] = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        if not data.isascii():
            at[[m.end() for m in WIDE_SPACE.finditer(data)]] = False
        for m in self.special.finditer(data) if self.special else ():
            at[m.start() + 1 : m.end()] = False
            at[[m.start(), m.end()]] = True
        at[ends] = True
        at[0] = at[-1] = True
        return np.flatnonzero(at)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        data, ends = b"".join(texts), np.cumsum([0, *map(len, texts)])
        cuts = self.cuts(data, ends)
        place = cuts.tolist()
        values = self.cache.get_all([data[i:j] for i, j in zip(place, place[1:])])
        first = np.searchsorted(cuts, ends).tolist()
        return [np.frombuffer(b"".join(values[i:j]), "<u4") for i, j in zip(first, first[1:])]

    def decode(self, ids: list[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def forced_boundary_bpe(path: str) -> ForcedBoundaryBPE:
    """One for each Python worker, which Spark uses for many tasks; so the cache stays warm."""
    return ForcedBoundaryBPE(path)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8, null as empty, in lists of about `limit` bytes."""
    block, held = [], 0
    for x in column.cast(pa.large_binary()):
        data = x.as_py() or b""
        block.append(data)
        held += len(data)
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def encoded(docs: DataFrame, path: str, columns: list[str], keep: bool = True) -> DataFrame:
    """columns of docs, then token_ids (array), decoded (string; both only if keep), n_tokens, ids_sha256, decoded_sha256. docs: text and `columns`."""
    held = in_small_batches(docs.select(*columns, F.col("text").alias("__text")))
    more = "token_ids array<int>, decoded string, " if keep else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("__text").schema)

    def run(batches):
        bpe = forced_boundary_bpe(path)
        for batch in batches:
            begin = 0
            for block in text_blocks(batch.column(batch.num_columns - 1)):  # a block goes back at once, so that a task holds the results of one only
                ids, plain, counts, a, b = [], [], [], [], []
                for found in bpe.encode(block):
                    listed = found.tolist()
                    text = bpe.decode(listed)
                    counts.append(len(listed))
                    a.append(hashlib.sha256(",".join([bpe.decimal[i] for i in listed]).encode()).hexdigest())
                    b.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    if keep:
                        ids.append(found.astype(np.int32))
                        plain.append(text)
                arrays = [batch.column(i).slice(begin, len(block)) for i in range(batch.num_columns - 1)]
                names = [*batch.schema.names[:-1]]
                if keep:
                    arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                    names += ["token_ids", "decoded"]
                arrays += [pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])
                begin += len(block)

    return held.mapInArrow(run, f"{schema}, {more}n_tokens long, ids_sha256 string, decoded_sha256 string")
