"""Quality classifier: a generalised additive model with pairwise interactions.

Method. Each feature of a text is cut into bins at quantiles of the training rows. In cycles, shallow trees (four leaves at most)
are fitted to the gradient of the logistic loss, one feature after the other; a tree over bins adds to that feature's lookup
table, so that a text's score is a sum of table entries. Then the pairs of features whose two-way trees gain most get tables
of their own in the same way. Scoring is vectorised bin lookup and addition.

Learning uses labelled rows only, at most `limit` labels (the smallest by a hash of doc_id; a bounded sample) and 2 * `limit` rows that they
label (the smallest by a hash of doc_id and text, as a repeated doc_id has many), of which just the features come to the driver. Rows without a label, or whose label is null, teach nothing. If no rows or only one class
is there to learn from, the model is the (smoothed) share of label 1.

Nulls: a null text counts as empty, and an empty text has a score as any other. Repeated rows get a row each; with repeated labels for
one doc_id each counts. Empty tables give empty results; other columns are ignored. Features are counts over whole texts.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

FEATURES = ["log_bytes", "word_bytes", "upper_share", "mark_share", "symbol_share", "digit_share", "distinct_words", "repeated_next", "distinct_lines", "words_per_line"]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"


def features(data: bytes) -> list[float]:
    """Of a text in UTF-8; in the order of FEATURES."""
    n, words, lines = max(1, len(data)), data.split(), data.split(b"\n")
    less = lambda drop: (len(data) - len(data.translate(None, drop))) / n
    n_words = max(1, len(words))
    return [
        float(np.log1p(len(data))), len(data) / n_words, less(_UPPER), less(_MARKS), less(_SYMBOLS), less(_DIGITS),
        len(set(words)) / n_words, sum(map(operator.eq, words, words[1:])) / n_words, len(set(lines)) / len(lines), len(words) / len(lines),
    ]


@dataclass
class PairwiseGam:
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 5
    cycles: int = 150
    rate: float = 0.15
    ridge: float = 1.0
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pair_tables: dict = field(default_factory=dict)
    #: whether there were rows of both classes to learn from; if not, all texts have the same score
    learned: bool = False

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        """Leaf values by bin of a tree of `depth` levels over sums of gradients and curvatures by bin."""
        gain_of = lambda a, b: a * a / (b + self.ridge)
        if depth and len(g) > 1:
            cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gain = gain_of(cg, ch) + gain_of(g.sum() - cg, h.sum() - ch)
            k = int(np.argmax(gain)) + 1
            if gain[k - 1] > gain_of(g.sum(), h.sum()) + 1e-9:
                return np.concatenate([self._tree(g[:k], h[:k], depth - 1), self._tree(g[k:], h[k:], depth - 1)])
        return np.full(len(g), g.sum() / (h.sum() + self.ridge))

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Leaf values over a grid of bins: one split of its rows, then one of the columns on either side; and its gain."""
        best, out = 0.0, np.zeros_like(g)
        for k in range(1, len(g)):
            value, total = np.zeros_like(g), 0.0
            for part in (slice(0, k), slice(k, None)):
                leaf = self._tree(g[part].sum(0), h[part].sum(0), 1)
                value[part] = leaf
                total += float((leaf * g[part].sum(0)).sum())
            if total > best:
                best, out = total, value
        return out, best

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        n, width = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(share / (1 - share)))
        cut = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k)) if n else np.zeros(0)
        self.edges = [cut(x[:, j], self.bins) for j in range(width)]
        self.coarse = [cut(x[:, j], self.pair_bins) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables = {}
        self.learned = bool(0 < y.sum() < n)
        if not self.learned:
            return self
        at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        total = np.full(n, self.intercept)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(self.cycles):
            for j, b in enumerate(at):
                g, h = slopes()
                k = len(self.tables[j])
                step = self.rate * self._tree(np.bincount(b, g, k), np.bincount(b, h, k))
                self.tables[j] += step
                total += step[b]
        rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]

        def grid(i, j, v):
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            return np.bincount(rough[i] * shape[1] + rough[j], v, shape[0] * shape[1]).reshape(shape)

        g, h = slopes()
        gains = {(i, j): self._pair_tree(grid(i, j, g), grid(i, j, h))[1] for i in range(width) for j in range(i + 1, width)}
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[: self.pairs]
        self.pair_tables = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in chosen}
        for _ in range(self.cycles // 5):
            for i, j in chosen:
                g, h = slopes()
                step = self.rate * self._pair_tree(grid(i, j, g), grid(i, j, h))[0]
                self.pair_tables[i, j] += step
                total += step[rough[i], rough[j]]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in self.pair_tables.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def with_features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns of docs and an array of the text's features."""
    held = in_small_batches(docs.select(*columns, F.col("text").alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("__text").schema)

    def run(batches):
        for b in batches:
            found = [features(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "features"])

    return held.mapInArrow(run, f"{schema}, features array<double>")


def texts(batch: pa.RecordBatch):
    """The last column's texts as UTF-8, null as empty."""
    return (x.as_py() or b"" for x in batch.column(batch.num_columns - 1).cast(pa.large_binary()))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, limit: int = 20_000) -> PairwiseGam:
    """docs: doc_id, text; labels: doc_id, quality; learn_from: a condition on doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn_from).select("doc_id", F.col("quality").cast("double").alias("y"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `limit` rows of two numbers at most
    order = F.xxhash64("doc_id", F.col("__row"))
    named = joined.withColumn("__row", F.xxhash64("text"))
    got = with_features(named, ["doc_id", "y", "__row"]).orderBy(order, "doc_id", "__row", "y").limit(2 * limit).toPandas().sort_values(["doc_id", "y", "__row"], kind="stable")
    x = np.array(got["features"].tolist(), float).reshape(len(got), len(FEATURES))
    return PairwiseGam().fit(x, (got["y"].to_numpy() > 0.5).astype(float))


def scored(docs: DataFrame, model: PairwiseGam, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """columns of docs, score (how likely label 1 is) and predicted (1 if score >= threshold)."""
    held = in_small_batches(docs.select(*columns, F.col("text").alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("__text").schema)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in texts(b)], float).reshape(b.num_rows, len(FEATURES))
            score = model.predict(x)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"]
            )

    return held.mapInArrow(run, f"{schema}, score double, predicted int")
