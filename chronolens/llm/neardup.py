"""Near-duplicate detection with BagMinHash signatures.

Method. A text is the multiset of its runs of five words (lower-cased, split at white space; a shorter text is one run). The weight
axis is cut into [0,1), [1,2), [2,4), [4,8), ...; for each shingle and each interval below its count there is a Poisson process
whose rate is the interval's width, seeded by (shingle, interval), of points (time, register, weight). A point counts if its
weight lies below the shingle's count, so that larger counts see a superset of the points of smaller ones. A register's
signature is its earliest point. Two texts agree in a register with probability sum(min) / sum(max) of their counts, the weighted
Jaccard similarity. Points are made in order of time only until every register has one, which is what makes it quick.

Signatures are banded. The smallest text of a band is its pivot, and what pivots join, directly or through others, is a cluster. First each text is
compared with the one pivot it shares most bands with, so that most clusters become one part at the cost of a comparison a text. Where a
cluster still has several parts, its texts are first told apart by their rarest shingles: texts at the threshold share one of the rarest |x| - ceil(0.8 |x|) + 1
occurrences of each, so only texts that such shingles join, directly or through others, stay in one cluster. Common passages, though they share bands, join nothing there.
Then the texts outside its largest part are compared with all its texts: both are dealt to blocks of BLOCK texts
and WEIGHT shingles at most, every two blocks are one task, which finds all overlaps by multiplying matrices of occurrences and returns only
links that join different parts, fewer than it has members. So no link between candidates is lost, and neither pairs nor an unbounded group
come together. Links make components, the groups. At the threshold 0.8, 30 bands of 5 registers miss a pair with probability 7e-6.

Equal texts are one class from the start. Nulls: a null text counts as empty; empty texts are equal to each other and link to nothing else.
A null doc_id is kept and stands for its group only where no other doc_id does. Repeated rows are copies. Empty tables give empty results;
other columns are ignored. Nothing but counts comes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_small_batches, staged

SHINGLE, BANDS, ROWS, BLOCK, SMALL = 5, 30, 5, 1024, 64
#: Shingles (occurrences) of a block's texts, unless one text has more.
WEIGHT = 400_000
#: Counters of shingles by their hashes; which shingles are rare is told by these.
COUNTERS = 1 << 20
#: So many columns of an occurrence matrix are held at once.
COLUMNS = 4096
_U = np.uint64


def _random_table(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * _U(2) + _U(1)


_BYTE = _random_table(256, 11)
_BASE = 0x9E3779B97F4A7C15
_STEPS = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEPS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser known as splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2 ** 64, for offsets of any size."""
    high = at // _STEPS
    if not high.any():
        return table[at]
    jumps = np.array([pow(base, int(h) * _STEPS, 1 << 64) for h in range(int(high.max()) + 1)], np.uint64)
    return table[at % _STEPS] * jumps[high]


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit hashes, and their counts. A shingle's hash is that of its bytes, from differences of one running sum."""
    data = b" ".join(text.decode("utf-8", "replace").lower().encode().split())
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b) + 1)
    running = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_UP, _BASE, at[:-1]), out=running[1:])
    blanks = np.flatnonzero(b == 32)
    begins, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(b)]])
    n = max(1, len(begins) - SHINGLE + 1)
    begins, ends = begins[:n], ends[min(SHINGLE, len(ends)) - 1 :]
    return np.unique(mix((running[ends] - running[begins]) * _power(_DOWN, pow(_BASE, -1, 1 << 64), begins)), return_counts=True)


def bag_minhash(x: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The m registers (64-bit names of points) of a non-empty multiset."""
    levels = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 1)
    item = np.repeat(np.arange(len(x)), levels) if levels.max() > 1 else np.arange(len(x))
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels) if levels.max() > 1 else np.zeros(len(x), np.int64)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width, most = np.maximum(low, 1.0), counts[item].astype(float)
    seed = mix(x[item] + _U(_BASE) * (level.astype(np.uint64) + _U(1)))
    mean = (np.log(m) + 3) * m / counts.sum()  # points of a unit process until the horizon
    while True:
        first, name = np.full(m, np.inf), np.zeros(m, np.uint64)
        live, done, since = np.arange(len(seed)), 0, np.zeros(len(seed))
        while len(live):
            k = max(int(mean) + 1, done)  # so many more points of each process that hasn't passed the horizon
            s = mix(seed[live, None] + np.arange(done + 1, done + k + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
            t = since[:, None] + np.cumsum(-np.log(((s >> _U(11)).astype(float) + 0.5) / 2**53), 1) / width[live, None]
            i, j = np.nonzero(t <= mean)
            point, time = s[i, j], t[i, j]
            a = mix(point ^ _U(0xA3B195354A39B70D))
            if len(seed) > len(x):
                ok = low[live[i]] + (a >> _U(32)).astype(float) / 2**32 * width[live[i]] < most[live[i]]
                point, time, a = point[ok], time[ok], a[ok]
            register = ((a & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)
            np.minimum.at(first, register, time)
            best = first[register] == time
            name[register[best]] = point[best]
            more = t[:, -1] <= mean
            live, since, done = live[more], t[more, -1], done + k
        if np.isfinite(first).all():
            return name
        mean *= 1.7


def bands(text: bytes) -> list[int]:
    """Hashes of the signature's bands; none for an empty text."""
    x, counts = shingles(text)
    if not len(x):
        return []
    rows = bag_minhash(x, counts, BANDS * ROWS).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_BASE)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64).tolist()


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    (xa, ca), (xb, cb) = unpack(a), unpack(b)
    _, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = float(np.minimum(ca[i], cb[j]).sum())
    return both / (float(ca.sum()) + float(cb.sum()) - both)


def pack(x: np.ndarray, counts: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes() + counts.astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n)


def _texts(column: pa.Array):
    return (x.as_py() or b"" for x in column.cast(pa.large_binary()))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (MD5 of the text: equal for equal texts), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            nodes, found, known = [], [], {}
            for text in _texts(b.column(1)):
                node = hashlib.md5(text, usedforsecurity=False).digest()
                if node not in known:
                    known[node] = bands(text)
                nodes.append(node)
                found.append(known[node])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, node binary, bands array<long>")


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, packed multiset and its size (weight) of the texts of the wanted (node, doc_id), each node once."""

    def run(batches):
        for b in batches:
            rows = [(node.as_py(), shingles(text)) for node, text in zip(b.column(0), _texts(b.column(1)))]
            arrays = [pa.array([n for n, _ in rows], pa.binary()), pa.array([pack(x, c) for _, (x, c) in rows], pa.binary()), pa.array([int(c.sum()) for _, (_, c) in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "bag", "weight"])

    nodes = docs.select(node_of(F.col("text")).alias("node"), "text", "doc_id")
    wanted = wanted.toDF(*[f"_{c}" for c in wanted.columns])
    one = nodes.join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_semi").dropDuplicates(["node"])
    return one.select("node", "text").mapInArrow(run, "node binary, bag binary, weight long")


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]], split: int) -> np.ndarray:
    """Sums of smaller counts of the first `split` bags (rows) with the others (columns); with split = 0, of all with all. Occurrences (shingle, nth) are columns of 0 and 1."""
    sizes = [int(c.sum()) for _, c in bags]
    owner = np.repeat(np.arange(len(bags)), sizes)
    name = np.concatenate([np.repeat(x, c) for x, c in bags])
    nth = np.concatenate([np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) for _, c in bags]).astype(np.uint64)
    _, column, times = np.unique(mix(name + nth * _U(_BASE)), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    out = np.zeros((len(range(len(bags))[left]), len(range(len(bags))[right])), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        held = np.zeros((len(bags), COLUMNS), np.float32)
        held[owner[part], column[part] - lo] = 1
        out += held[left] @ held[right].T
    return out


def links_of(nodes: list[bytes], bags: list[tuple[np.ndarray, np.ndarray]], split: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between the first `split` and the others (all with all for 0), but for those that others already make."""
    size = np.array([c.sum() for _, c in bags], float)
    both = overlaps(bags, split)
    rows, columns = (np.arange(split), np.arange(split, len(bags))) if split else (np.arange(len(bags)),) * 2
    found = both >= threshold * (size[rows][:, None] + size[columns][None] - both) - 1e-6
    parent, out = list(range(len(bags))), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*(v.tolist() for v in np.nonzero(found))):
        i, j = int(rows[i]), int(columns[j])
        if i != j and (a := root(i)) != (b := root(j)):
            parent[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def similar(links: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those of links (a, b) whose similarity reaches the threshold. A b that many links have is a skewed key of a join, which Spark splits."""

    def run(batches):
        for batch in batches:
            rows = zip(*batch.columns)  # one by one, as a batch of multisets is large
            found = [(a.as_py(), b.as_py()) for a, b, x, y in rows if overlap(x.as_py(), y.as_py()) >= threshold - 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    one, other = bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    return links.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def rarest(x: np.ndarray, counts: np.ndarray, seen: np.ndarray, threshold: float) -> np.ndarray:
    """Names of those occurrences (shingle, nth) of a multiset of which any other one that reaches the threshold shares one, among its own; those that no other text can have left out.

    The order is by the shingle's counter, then by name. Any order that all texts share gives right results, so counters that two shingles share do no harm."""
    held = np.repeat(x, counts)
    nth = (np.arange(len(held)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    name, often = mix(held + nth * _U(_BASE)), seen[(held % _U(COUNTERS)).astype(np.int64)]
    first = np.lexsort((name, often))[: len(held) - int(np.ceil(threshold * len(held) - 1e-6)) + 1]
    return name[first[often[first] > 1]]


def occurrences_seen(bags: DataFrame) -> np.ndarray:
    """In how many multisets there is a shingle of each counter, two at most: so that a counter says whether a shingle may be in another text, and rare ones come first."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for bag in b.column(0):
                x, _ = unpack(bag.as_py())
                np.add.at(total, (x % _U(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    found = bags.select("bag").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows of 12 bytes at most
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def narrowed(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """members: node, label, part. Those of clusters of several parts, each with the label of a smaller cluster: that of the texts which rare shingles join. No link between different parts is lost."""
    parts = members.groupBy("label").agg(F.min("part").alias("least"), F.max("part").alias("most")).where(F.col("least") != F.col("most")).select("label")
    held = staged(members.join(parts, "label").join(bags, "node").select("node", "label", "part", "bag"), "several")
    seen = occurrences_seen(held)

    def run(batches):
        for b in batches:
            for node, label, part, bag in zip(*b.columns):
                names = rarest(*unpack(bag.as_py()), seen, threshold).view(np.int64)
                if len(names):
                    arrays = [pa.array([v.as_py()] * len(names), pa.binary()) for v in (label, node, part)]
                    yield pa.RecordBatch.from_arrays([pa.array(names), *arrays], names=["name", "label", "node", "part"])

    rows = staged(held.mapInArrow(run, "name long, label binary, node binary, part binary"), "rarest")
    # aggregates on both sides, so that a shingle of a third of all texts is no one task's
    first = rows.groupBy("label", "name").agg(F.min("node").alias("first"), F.min("part").alias("least"), F.max("part").alias("most")).where(F.col("least") != F.col("most"))
    links = rows.join(first.select("label", "name", "first"), ["label", "name"]).where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    return components(links).join(members.select("node", "part"), "node")


def verified(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """members: node, label (of its cluster), part. Links (a, b) between nodes of a cluster, but of different parts, whose similarity reaches the
    threshold; enough of them to join what all of them join. Clusters of one part need none."""
    held = members.join(bags, "node")
    largest = F.max(F.struct("n", "weight", "part")).alias("main")
    parts = held.groupBy("label", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    sizes = parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), largest).where(F.col("n") > F.col("main.n"))
    blocks = lambda n, weight: F.greatest(F.ceil(n / BLOCK), F.ceil(weight / WEIGHT)).cast("int")
    sizes = staged(sizes.select("label", F.col("n").alias("members"), F.col("weight").alias("total"), F.col("main.part").alias("main"), blocks(F.col("n"), F.col("weight")).alias("all"), blocks(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("outer")), "open")
    load = sizes.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("weight")).first()
    packs = max(1, load.n // BLOCK, load.weight // WEIGHT)
    held = held.join(sizes, "label")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    until = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # an outer node stands left in every task of its block, and each node, outer or not, right in every task of its own
    left = F.when(F.col("part") != F.col("main"), F.transform(until("all"), lambda k: F.struct(at("outer").alias("lo"), k.alias("hi"), F.lit(0).alias("side"))))
    right = F.transform(until("outer"), lambda k: F.struct(k.alias("lo"), at("all").alias("hi"), F.lit(1).alias("side")))
    tasks = F.explode(F.concat(F.coalesce(left, F.array().cast("array<struct<lo:int,hi:int,side:int>>")), right)).alias("t")
    small = (F.col("members") <= SMALL) & (F.col("all") == 1)
    held = held.select("label", "node", "bag", F.when(small, F.pmod(F.xxhash64("label"), F.lit(packs))).alias("pack"), tasks)
    held = held.select("label", "node", "bag", "pack", F.when(F.col("pack").isNull(), F.col("label")).alias("big"), "t.lo", "t.hi", "t.side")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("label", sort=False):
            group = group.sort_values("side", kind="stable")
            nodes, split = group["node"].tolist(), int((group["side"] == 0).sum())
            if 0 < split < len(nodes):
                out += [(a, b) for a, b in links_of(nodes, [unpack(x) for x in group["bag"]], split, threshold) if a != b]
        return pd.DataFrame(out, columns=["a", "b"])

    return held.groupBy("big", "pack", "lo", "hi").applyInPandas(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for the nodes of edges (a, b): smallest labels travel along links, and labels of labels are followed, until nothing changes."""
    links = staged(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = staged(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = links.join(labels.toDF("a", "label"), "a").groupBy("b").agg(F.min("label").alias("seen")).withColumnRenamed("b", "node")
        low = labels.join(seen, "node").select("node", F.least("label", "seen").alias("low"), F.col("label").alias("was"))
        low = staged(low, "low")
        jump = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("next")), "low").select("node", F.least("low", "next").alias("label"), "was")
        jump = staged(jump, "labels")
        labels = jump.select("node", "label")
        if jump.where(F.col("label") != F.col("was")).isEmpty():
            return labels


def pivots(nodes: DataFrame) -> DataFrame:
    """nodes: node, bands. node, first (smallest pivot of its bands), most (the pivot of most of them, itself left out; or null), all: for nodes with bands."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    # both sides are aggregates or skewed join keys, so a band of a third of all texts is no one task's
    held = rows.join(rows.groupBy("key").agg(F.min("node").alias("pivot")), "key")
    other = F.when(F.col("pivot") != F.col("node"), F.col("pivot"))
    return held.groupBy("node").agg(F.min("pivot").alias("first"), F.mode(other, True).alias("most"), F.collect_set("pivot").alias("all"))


def grouped(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, node, group_id, group_node (which row stands for the group), group_size for each row of docs."""
    sig = staged(signatures(docs), "signatures")
    nodes = staged(sig.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    led = staged(pivots(nodes), "pivots")
    # one link a node, and one from each of its pivots to the smallest: the same clusters as by all links
    links = led.select(F.col("node").alias("a"), F.col("first").alias("b")).union(led.select(F.explode("all").alias("a"), F.col("first").alias("b")).distinct())
    clusters = components(links.where(F.col("a") != F.col("b")))
    bags = staged(multisets(docs, clusters.select("node").join(nodes.select("node", F.col("rep").alias("doc_id")), "node")), "bags")
    direct = staged(similar(led.where(F.col("most").isNotNull()).select(F.col("node").alias("a"), F.col("most").alias("b")), bags, threshold), "direct")
    parts = components(direct).withColumnRenamed("label", "part")
    members = clusters.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    close = staged(narrowed(staged(members, "members"), bags, threshold), "close")
    labels = components(staged(verified(close, bags, threshold).union(direct), "verified"))

    named = nodes.select("node", "rep", "copies").join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    named = staged(named, "classes")
    first = F.min(F.struct(F.col("rep").isNull().alias("unknown"), F.col("rep"), F.col("node")))
    groups = named.groupBy("label").agg(first.alias("first"), F.sum("copies").alias("group_size"))
    of = named.join(groups, "label").select("node", F.col("first.rep").alias("group_id"), F.col("first.node").alias("group_node"), "group_size")
    return sig.select("doc_id", "node").join(of, "node")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its group), group_size (rows), for each row of docs."""
    return grouped(docs, threshold).select("doc_id", "group_id", "group_size")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of docs, whole, of each group: that of the smallest doc_id (of equal rows that repeat it, any one)."""
    kept = grouped(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("node") == F.col("group_node")))
    node, kept_id, kept_node = free_name(docs, "node"), free_name(docs, "kept_id"), free_name(docs, "kept_node")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_node)).distinct()
    marked = docs.withColumn(node, node_of(F.col("text")))
    held = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi")
    return held.dropDuplicates(["doc_id", node]).drop(node)
