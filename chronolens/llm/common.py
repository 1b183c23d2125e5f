"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import fresh_path, staged  # noqa: F401  the operators take them from here


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Every run of ASCII characters that are neither letter nor digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_line(text: Column) -> Column:
    """Lower-cased words of a text, one space between them; words are runs of ASCII letters, digits and non-ASCII characters."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def word_array(text: Column) -> Column:
    line = word_line(text)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def row_key(text: Column) -> Column:
    """Beside doc_id, tells rows of the same doc_id apart; rows equal in both have equal results."""
    return F.xxhash64(text)


#: Rows of a batch of texts on its way to Python, at most.
BATCH_ROWS = 2_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends BATCH_ROWS rows to Python at once, if it sent more: batches of whole texts are large, and both sides hold them beside what they make of them."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df
