"""Benchmark decontamination: SimHash over item-sized windows, found through multi-index Hamming blocks.

Main path: DataFrame functions only.

Method. Words are those of word_line; a shingle is five words in a row (an item of fewer words is one shingle of its own
length). A window is as many words of a document as an item has, or the whole of a shorter document. Its similarity to an item is the
Jaccard similarity of their multisets of shingles.
- An item of n shingles and a window that reach the threshold t share t * n shingles at least, so one of the item's n - t * n + 1
  rarest (by the number of items that have them); documents with one of these are looked at, however few or many items share the others.
- Of such a document those windows matter that hold at least 2t / (1 + t) * n places whose shingle the item has, wherever they stand
  and in whatever order: starts come from runs of so many places, so no window that reaches the threshold is left out.
- Each such window's 64-bit SimHash is cut into radius + 1 blocks; a fingerprint within the radius of the item's agrees with it in one
  block at least, so the equi-join on (item, block number, block value) finds all of them. It carries fingerprints and ids alone.
- What lies within the radius is verified by the exact similarity.
Bits of two shingle multisets of similarity 0.8 differ with probability 0.15 each, so one such pair is beyond the radius of 24 with
probability 4e-6; more similar ones more rarely. Blocks of so large a radius have two or three bits and select little by
themselves; that joined rows grow with the windows, not with the number of items of one size, is due to the shared shingles.

Nulls: null texts count as empty, null doc_id and item_id are ordinary values. Items and documents without words match
nothing. Repeated rows give one result row for each pair of ids. Empty tables give empty results; other columns are
ignored. Texts are scanned whole. Ties between windows of equal similarity go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, staged, text_of, word_array

SHINGLE = 5
#: Up to so many item shingles (16 bytes each) are broadcast; with more, the join shuffles.
BROADCAST_ROWS = 500_000


def shingles(words: Column, length: int) -> Column:
    """Hashes of all runs of `length` words, in order; none if there are fewer."""
    return F.when(F.size(words) >= length, F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]))).otherwise(F.array().cast("array<bigint>"))


def own_shingles(words: Column) -> Column:
    """Shingles of a window or an item: of five words, or all its words as one."""
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= SHINGLE, shingles(words, SHINGLE)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _runs(words: Column, length: int) -> Column:
    """Places and hashes of all runs of less than SHINGLE words, hashed as own_shingles() does."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.struct(i.alias("p"), F.xxhash64(F.array_join(F.slice(words, i + 1, length), " ")).alias("hash")))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<struct<p:int,hash:bigint>>"))


def simhash(hashes: Column) -> Column:
    """64 bits; a bit is set if more than half of the hashes have it."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, x: n.bitwiseOR(x))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks as structs (no, value)."""
    n, parts, at = radius + 1, [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        parts.append(F.struct(F.lit(k).alias("no"), value.alias("value")))
        at += width
    return F.array(*parts)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as multisets."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _hashes(words: Column, w: Column) -> Column:
    """Shingles of a text as an item of w words has them, in order."""
    runs = shingles(words, SHINGLE)
    for length in range(1, SHINGLE):
        runs = F.when(w == length, F.transform(_runs(words, length), lambda x: x["hash"])).otherwise(runs)
    return runs


def _prefixes(item: DataFrame) -> DataFrame:
    """item_key, hash: of each item the rarest shingles, so many that a text sharing `least` of all has one of them."""
    each = staged(item.select("item_key", "n", "least", F.explode("item_shingles").alias("hash")), "item-shingles")
    common = each.groupBy("hash").agg(F.countDistinct("item_key").alias("items"))
    ordered = each.join(common, "hash").groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("items", "hash"))).alias("all"), F.first("n").alias("n"), F.first("least").alias("least"))
    return ordered.select("item_key", F.explode(F.slice("all", F.lit(1), F.col("n") - F.col("least") + 1)).alias("s")).select("item_key", F.col("s.hash").alias("hash")).distinct()


def _windows(docs: DataFrame, item: DataFrame) -> DataFrame:
    """doc_id, key (row_key of the text), item_key, w, start, window_shingles of all windows that may reach the threshold."""
    texts = docs.select("doc_id", row_key(text_of()).alias("key"), word_array(text_of()).alias("words"))
    prefixes = staged(_prefixes(item), "item-prefixes")
    few = prefixes.count() <= BROADCAST_ROWS
    short = [r.w for r in item.where(F.col("w") < SHINGLE).select("w").distinct().collect()]  # 4 values at most
    hashes = [shingles(F.col("words"), SHINGLE)] + [F.transform(_runs(F.col("words"), length), lambda x: x["hash"]) for length in short]
    seen = texts.select("doc_id", "key", F.explode(F.concat(*hashes) if short else hashes[0]).alias("hash"))
    pairs = staged(seen.join(F.broadcast(prefixes) if few else prefixes, "hash").select("doc_id", "key", "item_key").distinct(), "pairs")

    held = texts.withColumnsRenamed({"doc_id": "d", "key": "k"})
    here = pairs.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    here = here.join(item.select("item_key", "w", "n", "least", "full", "item_shingles"), "item_key")
    here = staged(here.select("doc_id", "key", "item_key", "w", "n", "least", "full", "item_shingles", _hashes(F.col("words"), F.col("w")).alias("hashes")).distinct(), "texts")
    places = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("item_shingles", h), i)), lambda i: i.isNotNull())
    here = staged(here.select("doc_id", "key", "item_key", "w", "n", "least", "full", "hashes", places.alias("places")), "places")

    last = F.size("hashes") - F.col("n")
    enough = F.sequence(F.lit(0), F.size("places") - F.col("full"))
    begin = lambda i: F.greatest(F.lit(0), F.get("places", i + F.col("full") - 1) - F.col("n") + 1)
    end = lambda i: F.least(F.get("places", i), last)
    starts = F.array_distinct(F.flatten(F.transform(enough, lambda i: F.when(begin(i) <= end(i), F.sequence(begin(i), end(i))).otherwise(F.array().cast("array<int>")))))
    starts = F.when((last >= 0) & (F.size("places") >= F.col("full")), starts).when((last < 0) & (F.size("places") >= F.col("least")), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return here.select("doc_id", "key", "item_key", "w", "n", "hashes", F.explode(starts).alias("start")).select("doc_id", "key", "item_key", "w", "start", F.slice("hashes", F.col("start") + 1, F.col("n")).alias("window_shingles"))


def _matches(docs: DataFrame, items: DataFrame, threshold: float, radius: int) -> DataFrame:
    """doc_id, key (row_key of the text), start, w, item_id, distance, similarity of all windows that reach the threshold."""
    item = items.select("item_id", word_array(text_of()).alias("words")).where(F.size("words") > 0).dropDuplicates()
    item = item.select("item_id", F.xxhash64(F.col("item_id").cast("string"), F.array_join("words", " ")).alias("item_key"), F.size("words").alias("w"), own_shingles(F.col("words")).alias("item_shingles"))
    item = item.withColumn("n", F.size("item_shingles"))
    share = lambda t: F.greatest(F.lit(1), F.ceil(F.col("n") * t - 1e-9).cast("int"))
    item = staged(item.withColumns({"least": share(threshold), "full": share(2 * threshold / (1 + threshold)), "item_print": simhash(F.col("item_shingles"))}), "items")

    windows = _windows(docs, item).withColumns({"window_print": simhash(F.col("window_shingles")), "window": F.xxhash64("doc_id", "key", "start", "item_key")})
    windows = staged(windows, "windows")
    left = windows.select("window", "item_key", "window_print", F.explode(blocks(F.col("window_print"), radius)).alias("block"))
    right = item.select("item_key", "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("block"))
    distance = F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))).cast("int")
    near = left.join(right, ["item_key", "block"]).where(distance <= radius).select("window", "item_key").distinct()
    checked = windows.join(near, ["window", "item_key"], "left_semi").join(item.select("item_key", "item_id", "item_shingles", "item_print"), "item_key")
    checked = checked.withColumn("similarity", similarity(F.col("window_shingles"), F.col("item_shingles"))).where(F.col("similarity") >= threshold)
    return checked.select("doc_id", "key", "start", "w", "item_id", distance.alias("distance"), "similarity")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 24) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Rows doc_id, item_id, start, n_words, distance, similarity: the best window of each document for each item it holds."""
    checked = _matches(docs, items, threshold, radius)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("neg_start"), F.col("w"), F.col("distance"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.neg_start")).alias("start"), F.col("b.w").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 24) -> DataFrame:
    """The rows of docs, whole, that hold no item. Rows are told apart by doc_id and text, so a clean text stays beside a contaminated one of the same or no doc_id."""
    bad_id, bad_key = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    bad = _matches(docs, items, threshold, radius).select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (row_key(text_of()) == F.col(bad_key)), "left_anti")
