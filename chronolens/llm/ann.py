"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Method. Vectors are scaled to length 1, so that the inner product is the cosine. Product quantisation gives each pair of
components a code of four bits. Its loss weighs the part of the residual parallel to the vector, which moves large inner products,
`eta` times as much as the part across: |r|^2 + (eta - 1) <r, x>^2. Codebooks start from k-means and alternate coordinate descent over
codes with the closed-form least-squares update; they are fitted to `sample` vectors (a bounded sample, the smallest by a
hash of vec_id), and then every vector is encoded. A query makes a table of 16 partial products for each code, two of which are joined
to one of 256 entries for a byte; a scan adds table entries; the best `shortlist` of each block are reranked by exact cosines in double precision, and so
are SPOT rows from all over it. What these show of the scan's error says which others may still be among the best, and they are reranked too, until none is left: a
cluster that is denser than the codes can tell apart is reranked whole.

In front of the scan, vectors are dealt to cells by their nearest centre (k-means on the same sample; sqrt(n) / 4 cells, CELLS at most). A query
probes the cells of the nearest centres, so many that RECALL of the five nearest neighbours in the sample lie in them, by queries of the same table that are as far from
their nearest centre (BINS such classes), so that queries unlike the rows get what they need. Clustered vectors need few cells,
so the work of a query grows like the square root of the rows; vectors without any structure need most cells, whatever their number. What is
encoded is a vector's difference from its cell's centre; the centre's own product is the same for all rows of a cell and changes no shortlist.

Work is split by cell, and within by blocks of BLOCK rows and BYTES at most, so a cell that many vectors fall into is many tasks;
its queries are split in the same way. Only each block's best survive. Equal vectors are indexed once, with their k + 1 smallest ids, more of which no
query can need; so ties between equal vectors are exact and a vector that repeats without bound isn't gathered.

Vectors are compared with those of the same length only. The LENGTHS most frequent ones have an index each; the others are scanned exactly.
Null, zero, empty vectors and those with null or non-finite components take no part, nor rows without an id; very small and very large
components do. Repeated rows count once. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK, BYTES, QUERY_BLOCK = 32_768, 32_000_000, 2_048
CELLS, RECALL, LENGTHS, SPOT, BINS, ASKED = 1_024, 0.98, 8, 64, 8, 512


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id long, v array<double>, n (its length); without what takes no part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def least_squares(codes: np.ndarray, parts: np.ndarray, way: np.ndarray, inner: np.ndarray, eta: float, start: np.ndarray, tolerance: float = 1e-9, most: int = 300) -> np.ndarray:
    """Codewords (codes, 16, width) of the least anisotropic loss for given codes, by conjugate gradients from `start`.

    The normal equations are (counts + (eta - 1) Z' Z) b = sums + (eta - 1) Z' inner, Z having a vector's components at its codewords. Z is never made: its products are
    gathered and scattered by the codes, so memory and each step grow with rows times dimension."""
    m, _, width = start.shape
    at = np.arange(m)[None] * 16 + codes
    size = m * 16
    spread = lambda v: np.stack([np.bincount(at.ravel(), v[:, :, j].ravel(), size) for j in range(width)], 1)
    count = np.bincount(at.ravel(), minlength=size)[:, None] + 1e-6
    apply = lambda b: count * b + (eta - 1) * spread(np.einsum("nmw,nmw->n", way, b[at])[:, None, None] * way)
    goal = spread(parts) + (eta - 1) * spread(inner[:, None, None] * way)
    scale = count + (eta - 1) * spread(way * way)  # the diagonal
    b = start.reshape(size, width).copy()
    rest = goal - apply(b)
    step = rest / scale
    along, now = step, float((rest * step).sum())
    least = tolerance**2 * float((goal * goal / scale).sum())
    for _ in range(most):
        if now <= least:
            break
        moved = apply(along)
        a = now / float((along * moved).sum())
        b += a * along
        rest -= a * moved
        step = rest / scale
        before, now = now, float((rest * step).sum())
        along = step + now / before * along
    return b.reshape(start.shape)


@dataclass
class AnisotropicQuantiser:
    books: np.ndarray  # (codes, 16, width): codewords
    eta: float

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, codes, width), padded by zeros."""
        m = len(self.books)
        return np.pad(x, ((0, 0), (0, m * self.width - x.shape[1]))).reshape(len(x), m, self.width)

    def encode(self, x: np.ndarray, target: np.ndarray, sweeps: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """Codes (rows, codes) of target, what unit vectors x have beyond their cell's centre, by coordinate descent on the anisotropic loss."""
        parts, way, rows = self.split(target), self.split(x), np.arange(len(x))
        codes = ((parts[:, :, None] - self.books[None]) ** 2).sum(3).argmin(2) if start is None else start.copy()
        along = np.stack([((parts[:, m] - self.books[m][codes[:, m]]) * way[:, m]).sum(1) for m in range(len(self.books))], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m, book in enumerate(self.books):
                part = parts[:, m]
                across = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
                parallel = (part * way[:, m]).sum(1)[:, None] - way[:, m] @ book.T
                rest = (total - along[:, m])[:, None]
                codes[:, m] = (across + (self.eta - 1) * (rest + parallel) ** 2).argmin(1)
                own = parallel[rows, codes[:, m]]
                total += own - along[:, m]
                along[:, m] = own
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 3, seed: int = 5) -> AnisotropicQuantiser:
        """x: unit vectors (rows, dimension), at least one; target: what is encoded of each."""
        n, d = x.shape
        m = -(-d // width)
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        q = cls(np.zeros((m, 16, width)), eta)
        parts, way = q.split(target), q.split(x)
        for k in range(m):
            book = parts[rng.integers(0, n, 16), k] + rng.normal(0, 1e-3, (16, width))
            for _ in range(8):
                near = ((parts[:, k, None] - book) ** 2).sum(2).argmin(1)
                count = np.bincount(near, minlength=16)[:, None]
                sums = np.stack([np.bincount(near, parts[:, k, j], 16) for j in range(width)], 1)
                book = np.where(count > 0, sums / np.maximum(1, count), book)
            q.books[k] = book
        codes, inner = q.encode(x, target), (x * target).sum(1)
        for _ in range(rounds):
            # least squares over all codewords at once: sum over x of (t - Bc)' (1 + (eta - 1) x x') (t - Bc)
            q.books = least_squares(codes, parts, way, inner, eta, q.books)
            codes = q.encode(x, target, start=codes)
        return q

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256) partial products; byte j holds the codes 2j (low) and 2j + 1."""
        t = np.einsum("qmw,mcw->qmc", self.split(queries), self.books).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, 16), np.float32)], 1)
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(t), -1, 256)

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """(bytes, rows)."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8).T)


@dataclass
class Index:
    """What is fitted for one length of vectors: the quantiser, centres of cells and how many cells a query probes, by its cosine with the nearest centre."""

    quantiser: AnisotropicQuantiser
    centres: np.ndarray
    edges: np.ndarray  # between classes of queries
    needed: np.ndarray  # cells that each class probes

    @property
    def probes(self) -> int:
        """The most cells that a query probes."""
        return int(self.needed.max())

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, k: int = 5, seed: int = 4, asked: np.ndarray | None = None) -> Index:
        """x: unit vectors of the sample; rows: how many vectors there are; asked: some of the queries (none: of x)."""
        rng = np.random.default_rng(seed)
        n = max(1, min(CELLS, len(x) // 8, int(rows**0.5 / 4)))
        centres = x[rng.choice(len(x), n, replace=False)]
        for _ in range(8):
            own = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            full = np.sqrt((sums * sums).sum(1)) > 0
            centres[full] = unit(sums[full])
        own = (x @ centres.T).argmax(1)
        asked = x[rng.choice(len(x), min(len(x), ASKED), replace=False)] if asked is None or not len(asked) else asked
        with_centres = asked @ centres.T
        order = np.argsort(np.argsort(-with_centres, 1), 1)  # places of the cells, nearest first
        near = asked @ x.T
        near[near >= 1 - 1e-12] = -2  # the query itself
        near = np.argsort(-near, 1)[:, : max(1, min(k, len(x) - 1))]
        places, close = np.take_along_axis(order, own[near], 1) + 1, with_centres.max(1)
        classes = np.array_split(np.argsort(close), max(1, min(BINS, len(asked) // 32)))
        needed = [np.sort(places[c].ravel())[int(np.ceil(RECALL * places[c].size)) - 1] for c in classes]
        edges = [close[c[-1]] for c in classes[:-1]]
        return cls(AnisotropicQuantiser.fit(x, x - centres[own]), centres, np.array(edges), np.array(needed))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each unit vector."""
        return (x @ self.centres.T).argmax(1)

    def probed(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells that each query (a unit vector) probes, nearest first."""
        close = x @ self.centres.T
        count = self.needed[np.searchsorted(self.edges, close.max(1))]
        return [cells[:n] for cells, n in zip(np.argsort(-close, 1, kind="stable"), count)]


def shortlisted(score: np.ndarray, exact, shortlist: int, k: int) -> np.ndarray:
    """Rows that may be among the k best. score: the scan's; exact(rows): their cosines. Reranks the best by score and some of all, then what the error seen there leaves open."""
    seen, cosines, wide = np.zeros(len(score), bool), np.full(len(score), -np.inf), -np.inf
    new = np.union1d(np.argpartition(-score, shortlist - 1)[:shortlist], np.arange(0, len(score), -(-len(score) // SPOT)))
    while new.size:
        seen[new], cosines[new] = True, exact(new)
        wide = max(wide, float((cosines[new] - score[new]).max()))
        least = -np.partition(-cosines, k - 1)[k - 1]
        new = np.flatnonzero(~seen & (score >= least - wide))
    return np.flatnonzero(cosines >= least - 1e-9)


def search_block(q: AnisotropicQuantiser | None, packed: np.ndarray, x: np.ndarray, queries: np.ndarray, shortlist: int, k: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that may be its k best (all rows without a quantiser) and their exact cosines. x, queries: original vectors."""
    x, queries, out, shortlist = scaled(x), scaled(queries), [], max(shortlist, k)
    norm = np.sqrt((x * x).sum(1))
    directions = x / norm[:, None]
    for lo in range(0, len(queries), 64):
        part = queries[lo : lo + 64]
        scan = q is not None and len(x) > shortlist
        for query, tables in zip(part, q.tables(unit(part)) if scan else part):
            if scan:
                score = tables[0][packed[0]]
                for table, byte in zip(tables[1:], packed[1:]):
                    score += table[byte]
                way = query / np.sqrt((query * query).sum())
                near = shortlisted(score, lambda rows, way=way: directions[rows] @ way, shortlist, k)
            else:
                near = np.arange(len(x))
            out.append((near, (x[near] * query).sum(1) / (norm[near] * np.sqrt((query * query).sum()))))
    return out


def by_length(frame: pd.DataFrame):
    """(length, rows, their vectors as one matrix) for each length in the frame."""
    for n, rows in frame.groupby("n", sort=False):
        yield int(n), rows, np.stack(rows["v"].to_numpy())


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shortlist: int = 150, sample: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found, by cosine, ties to the smaller vec_id. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    distinct = staged(distinct.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("n").alias("n")), "ann-vectors")
    asked = rows.where(is_query)
    names = staged(asked.groupBy("v").agg(F.min("vec_id").alias("q"), F.first("n").alias("n")), "ann-asked")
    models: dict[int, Index] = {}
    matrix_of = lambda some: unit(np.array([r.v for r in some]))
    for size in distinct.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(LENGTHS).collect():
        some = distinct.where(F.col("n") == size.n).orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").collect()
        if len(some) > shortlist:
            queried = names.where(F.col("n") == size.n).orderBy(F.xxhash64("q", F.lit(1)), "q").limit(ASKED).select("v").collect()
            models[size.n] = Index.fit(matrix_of(some), size["count"], k, asked=matrix_of(queried) if queried else None)

    def encode(frames):
        for f in frames:
            for n, part, x in by_length(f):
                model = models.get(n)
                if model:
                    u = unit(x)
                    cell = model.cells(u)
                    code = [p.tobytes() for p in model.quantiser.pack(model.quantiser.encode(u, u - model.centres[cell])).T]
                else:
                    cell, code = 0, b""
                yield pd.DataFrame({"n": n, "cell": cell, "ids": part["ids"], "v": [v.tobytes() for v in x], "code": code})

    def probe(frames):
        for f in frames:
            for n, part, x in by_length(f):
                model = models.get(n)
                cells = model.probed(unit(x)) if model else [np.zeros(1, int)] * len(x)
                yield pd.DataFrame({"n": n, "cells": cells, "q": part["q"], "v": [v.tobytes() for v in x]})

    index = staged(distinct.mapInPandas(encode, "n int, cell int, ids array<long>, v binary, code binary"), "ann-index")
    queries = names.mapInPandas(probe, "n int, cells array<int>, q long, v binary").select("n", F.explode("cells").alias("cell"), "q", "v")
    queries = staged(queries, "ann-queries")
    at_most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BYTES) / (8 * F.col("n")))))
    held = index.groupBy("n", "cell").agg(F.ceil(F.count("*") / at_most).cast("int").alias("blocks"))
    askers = queries.groupBy("n", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    split = staged(held.join(askers, ["n", "cell"]), "ann-blocks")
    until = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.join(split, ["n", "cell"]).select("n", "cell", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), until("parts").alias("part"), "ids", "v", "code")
    right = queries.join(split, ["n", "cell"]).select("n", "cell", until("blocks").alias("block"), F.pmod(F.xxhash64("q"), "parts").cast("int").alias("part"), "q", "v")

    def scan(key, block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found, matrix = [], lambda column: np.frombuffer(b"".join(column), float).reshape(len(column), -1)
        if len(block) and len(some):
            model, ids = models.get(int(key[0])), block["ids"].to_numpy()
            packed = np.ascontiguousarray(np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1).T)
            first = np.array([i[0] for i in ids])
            for number, (near, score) in zip(some["q"], search_block(model and model.quantiser, packed, matrix(block["v"]), matrix(some["v"]), shortlist, k + 1)):
                best = np.lexsort((first[near], -score))[: k + 1]
                every = sorted((-s, int(v)) for i, s in zip(near[best].tolist(), score[best].tolist()) for v in ids[i])
                found += [(int(number), v, -s) for s, v in every[: k + 1]]
        return pd.DataFrame(found, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    place = ["n", "cell", "block", "part"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(scan, "q long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    readers = asked.select(F.col("vec_id").alias("query_id"), "v").distinct().join(names.select("v", "q"), "v").select("query_id", "q")
    # a vector that a third of the queries have is one group of k + 1 rows here; the join on q is what AQE may split
    pairs = readers.join(best, "q").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
