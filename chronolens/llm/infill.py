"""Fill-in-the-middle transformation of texts by big-integer bit-parallelism.

Method. bytes.translate turns a text's UTF-8 bytes into a string of 0 and 1 for a class of bytes, which is read as one big integer, bit i being
byte i. Line feeds, shifted by one place and joined with the first bit, mark where units (lines with their line feed) begin; bit_count gives
their number n. Two draws cut the text before its a-th and b-th unit: the place of a ranked bit is found by recursive halving, counting the bits of
the lower half each time, so that all halvings together read the integer twice. Code points are bits of bytes that begin one.

Draws. h1 to h4 are the first four groups of 8 hexadecimal digits of the SHA-256 of `seed:key`. The prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) units, the middle after the larger, the suffix is the rest. h3 % 100 >= fim_percent leaves a text as it is (form plain), as do an
empty text and one that holds a sentinel; h4 % 100 < spm_percent gives form spm (suffix, prefix, middle), else psm (prefix, suffix, middle).

Nulls: a null text counts as empty, a null key as an empty string. Prefix, middle and suffix may be empty. Repeated rows are changed alike. Very long
texts are handled whole; what a task holds is a few times the longest. Empty tables give empty results; columns that aren't asked for are ignored,
those asked for are carried under their names and may not be called like the results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: What marks prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
RESULTS = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of outputs in a batch that goes back, unless one text has more.
BATCH_BYTES = 8_000_000


def _class(wanted) -> bytes:
    return bytes(ord("1") if wanted(b) else ord("0") for b in range(256))


LINE_FEEDS, CHARACTERS = _class(lambda b: b == 10), _class(lambda b: b & 0xC0 != 0x80)


def bits_of(data: bytes, table: bytes) -> int:
    """Bit i is 1 where byte i of data (not empty) is of the class."""
    return int(data.translate(table)[::-1], 2)


def select(bits: int, k: int) -> int:
    """Place of the k-th set bit from the lowest, k from 0 and less than their number."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - n, at + half
    return at


def unit_begins(data: bytes) -> int:
    """A bit for each byte of data (not empty) that begins a line."""
    return (bits_of(data, LINE_FEEDS) << 1 | 1) & ((1 << len(data)) - 1)


def cut(data: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of lines, and the bytes after which prefix and middle end."""
    if not data:
        return 0, 0, 0
    begins = unit_begins(data)
    n = begins.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: select(begins, k) if k < n else len(data)
    return n, place(a), place(b)


def infill(data: bytes, digest: str, sentinels: tuple[bytes, bytes, bytes], fim_percent: int, spm_percent: int) -> tuple:
    """n, form, code points of prefix and of middle (null if plain), output."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n, a, b = cut(data, h1, h2)
    if not data or h3 % 100 >= fim_percent or any(s in data for s in sentinels):
        return n, "plain", None, None, data
    if data.isascii():
        sizes = (a, b - a)
    else:
        leads = bits_of(data, CHARACTERS)
        before, until = ((leads & ((1 << k) - 1)).bit_count() for k in (a, b))
        sizes = (before, until - before)
    p, s, m = sentinels
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", *sizes, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", *sizes, b"".join((p, prefix, s, suffix, m, middle))


def infilled(docs: DataFrame, columns: list[str], key: Column | None = None, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """columns of docs, n (lines), form, prefix_chars, middle_chars and output (the text made anew)."""
    name = F.coalesce((F.col("doc_id") if key is None else key).cast("string"), F.lit(""))
    held = in_small_batches(docs.select(*columns, F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("__digest"), F.col("text").alias("__text")))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.drop("__digest", "__text").schema)
    marks = tuple(s.encode() for s in sentinels)

    def run(batches):
        for batch in batches:
            begin, held_bytes, rows = 0, 0, []
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

            def done(end):
                carried = [batch.column(i).slice(begin, end - begin) for i in range(batch.num_columns - 2)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*carried, *made], names=[*batch.schema.names[:-2], *(x.split()[0] for x in RESULTS.split(", "))])

            for i, (digest, text) in enumerate(zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).cast(pa.large_binary()))):
                rows.append(infill(text.as_py() or b"", digest.as_py(), marks, fim_percent, spm_percent))
                held_bytes += len(rows[-1][4])
                if held_bytes > BATCH_BYTES:
                    yield done(i + 1)
                    begin, held_bytes, rows = i + 1, 0, []
            if rows:
                yield done(batch.num_rows)

    return held.mapInArrow(run, schema + RESULTS)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from. No sentinel stands in the text, and none arises where a part meets one, so the first three are those that were put in."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), 4)
    at = lambda *order: F.concat(*(parts[i] for i in order))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
