"""Spelling variants: pairs of words at one edit, by merging the light subtrees of a trie (errata), and the form that each word belongs to.

Method. The words make a trie; a node is a prefix, and the end of a word is a child too. Of each node with several children the one with most words is heavy,
the others are light, so that a word has at most log2(words) light edges on its path. At each of them the part of the word below the edge is merged
into the rest of the subtree with one character skipped or replaced:

  skipped    the light character itself goes; or the heavy one is put before it, which is the heavy word with that character skipped
  replaced   by the heavy character; or by an errata character that all light children of the node share

Terminals that coincide are words at one edit. Only light subtrees move, the smaller into the larger. Every pair is met: where two words part, at the
last place where the edit can be told to be, at least one of the two edges is light.

In Spark the trie is a table of nodes (prefix, words below it), the merged terminals are strings, and coinciding is a join on the word or a group of the same errata
string, which has one member for each character at most. Nothing else is grouped, and nothing is brought together by length or first letters, so no group
grows with the number of words. Words below a frequent prefix are a skewed key of the join with the nodes, a staged table, which Spark splits.

Nulls: a null text has no words, a null doc_id counts as an empty string where deletions are drawn. Repeated rows count again. Very long texts and words are handled whole; long words that others share far into them cost the square of the shared length. Ties are settled by code-point order. Empty tables give
empty results; other columns are ignored. Nothing comes to the driver but whether roots still change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Words of so many code points, a power of two, are taken to their end; the nodes of longer ones only as far as other words share them.
SHORT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5, deletions: int = 0) -> DataFrame:
    """word, n: runs of letters A to Z and U+00C0 to U+00FF of at least least_chars code points and least_count occurrences.

    With deletions = k, a run whose CRC-32 of `doc_id:run` divides by k loses its code point of that number modulo its length: misspellings drawn at a known rate."""
    # only maximal runs match, and shorter ones have no part in the result
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("word"))
    if deletions:
        drawn = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = drawn.select(F.when(F.col("h") % deletions == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def with_depth(words: DataFrame) -> DataFrame:
    """words and depth: how far down the path of a word its nodes may have other words below them. Of long words only, told by prefixes of 32, 64, 128, ... characters: behind the first that no other word shares, a path is the word's own."""
    size = F.length("word")
    short = words.where(size <= SHORT).withColumn("depth", size)
    long = words.where(size > SHORT)
    lengths = F.transform(F.sequence(F.lit(SHORT.bit_length() - 1), F.floor(F.log2(size)).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    each = long.select("word", F.explode(lengths).alias("k")).select("word", "k", F.xxhash64("k", F.substring("word", F.lit(1), F.col("k"))).alias("key"))
    own = each.groupBy("key").agg(F.count("*").alias("n"), F.first("word").alias("word"), F.first("k").alias("k")).where("n = 1")
    limits = own.groupBy("word").agg(F.min("k").alias("limit"))
    return short.unionByName(long.join(limits, "word", "left").withColumn("depth", F.coalesce("limit", size)).drop("limit"))


def heavy_paths(words: DataFrame) -> DataFrame:
    """prefix, heavy (the character of its heavy child) of the trie's nodes that have several children, an end among them. words: word, depth."""
    lengths = F.sequence(F.lit(1), F.col("depth"))
    nodes = words.select(F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("path")).groupBy("path").agg(F.count("*").alias("size"))
    last = F.length("path")
    children = nodes.select(F.substring("path", F.lit(1), last - 1).alias("prefix"), F.substring("path", last, F.lit(1)).alias("edge"), "size")
    ends = words.select(F.col("word").alias("prefix"), F.lit("").alias("edge"), F.lit(0).cast("long").alias("size"))
    kids = children.unionByName(ends).groupBy("prefix").agg(F.max_by("edge", F.struct("size", "edge")).alias("heavy"), F.count("*").alias("children"))
    return kids.where("children > 1").drop("children")


def light_edges(words: DataFrame) -> DataFrame:
    """word, n, prefix, edge (empty where the word ends), rest, heavy: for each light edge on the path of a word."""
    words = staged(with_depth(words), "depths")
    paths = words.select("word", "n", F.explode(F.sequence(F.lit(0), "depth")).alias("at"))
    paths = paths.select("word", "n", "at", F.substring("word", F.lit(1), F.col("at")).alias("prefix")).join(staged(heavy_paths(words), "nodes"), "prefix")
    edges = paths.select("word", "n", "prefix", "heavy", F.substring("word", F.col("at") + 1, F.lit(1)).alias("edge"), F.substring("word", F.col("at") + 2, F.length("word")).alias("rest"))
    return edges.where(F.col("edge") != F.col("heavy"))


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n, each word once. word, n_near (words at one edit), near_word, near_n (of the most frequent of them, ties to the first in code-point order), for words that have any."""
    light = staged(light_edges(words), "light")
    inner = F.col("edge") != ""
    merged = light.select(
        "word", "n",
        F.explode(F.array_compact(F.array(
            F.when(inner, F.struct(F.lit(0).alias("kind"), F.concat("prefix", "rest").alias("to"))),
            F.struct(F.lit(0).alias("kind"), F.concat("prefix", "heavy", "edge", "rest").alias("to")),
            F.when(inner, F.struct(F.lit(1).alias("kind"), F.concat("prefix", "heavy", "rest").alias("to"))),
        ))).alias("m"),
    ).select("word", "n", "m.kind", "m.to")
    met = merged.join(words.select(F.col("word").alias("to"), F.col("n").alias("to_n")), "to")
    both = met.select("word", "n", "to", "to_n").union(met.select("to", "to_n", "word", "n"))
    # a pair of different lengths may coincide more than once; a replaced one is met at one node, in one way
    pairs = both.distinct().groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("less"), F.col("to").alias("near_word"))).alias("best"))

    shared = light.where(inner).groupBy("prefix", "rest").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("near_word")))).alias("all")).where(F.size("all") > 1)
    member = shared.select("all", F.posexplode("all").alias("pos", "one"))
    errata = member.select(F.col("one.near_word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("pos") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    found = pairs.union(errata).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", "best.near_word", (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word, root: where following forms ends. Links of links are followed, so that a chain takes the logarithm of its length in rounds."""
    held = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        held = step.select("word", "root")
        if step.where("moved").isEmpty():
            return held


def variant_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """counts: word, n. word, form (its near word of largest n, if that is at least ratio times the word's own; else null), root, n, n_near, form_n. ratio > 1, so forms make no circle."""
    words = staged(counts, "words")
    near = words.join(near_words(words), "word", "left")
    taken = F.col("near_n") >= F.col("n") * ratio
    named = near.select("word", F.when(taken, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("near_n")).alias("form_n"))
    named = staged(named, "named")
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
