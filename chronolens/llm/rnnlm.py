"""Language-model scores of whole documents by a gated recurrent network over words.

Method. The vocabulary is the most frequent words of the training documents and UNKNOWN stand-ins for all other words, chosen by a word's last two
bytes. Such a word has the stand-in's probability times its own given the stand-in: its share of the training counts there, mixed
with a spelling model of the words outside the vocabulary: each byte after the three behind it, from the word's end to its begin, so that the
stand-in is known after two bytes and its mass exactly; so
probabilities over all words sum to 1 (but for what the spelling model spends on words of the vocabulary and of other cases of its contexts). The output is factored: the
probability of the word's class (words of neighbouring frequency; the stand-ins are the first ones), then of the word in its class. Training is truncated backpropagation
through time in numpy: the state is carried from window to window, gradients aren't. Scoring carries the state through
each whole document, end token included.

Counts of words come from all training documents and stay distributed. Words of the highest counts, HOT at most, are read by every task from the
shared folder; the counts of all other words reach the documents by a join on the word, each of which is rare.
Texts are cut into words twice: to count these, and to write each row's ids, which both learning and scoring read.

The network learns from all training documents, whole texts, dealt to shards of about SHARD documents, of fewer where these would have
more than about SHARD_TOKENS tokens. A shard is read to its end, once at least. The first shard gives a start; from it every shard trains on,
TASK_SHARDS of them in a task, and their weights are averaged, those of the tasks sixteen at a time, weighted by tokens.

Nulls: a null text counts as empty: its one token is the end. A row with a null doc_id is learned from, by the network too, and not held out. Each row gets its
own result row, repeated ones too. Empty tables give empty results; without training documents all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, staged

#: The end token is held as a string that no word can be.
END = "\n"
HOT, VOCABULARY, CLASS, UNKNOWN = 300_000, 6_144, 64, 64
#: Tokens of texts that are scored in step, and states that are held until their probabilities are taken.
BLOCK_TOKENS, HELD_STATES = 500_000, 65_536
#: Rows of logits that are worked on at once, so that they stay in a processor's cache.
CACHED = 1_024
#: The share of the training documents that the network learns from, and documents and tokens of a shard.
SHARE, SHARD, SHARD_TOKENS = 1.0, 800, 320_000
#: So many shards are learned from and averaged in one task.
TASK_SHARDS = 4
#: Lanes that a shard is read in at most and tokens of a lane at least, and updates that the first shard makes at least (every shard makes those that one pass takes).
LANES, LANE_TOKENS, FIRST_UPDATES = 1_024, 256, 120


def tokens(text: bytes) -> list[bytes]:
    """Words of a text: runs without ASCII blanks (9 to 13, 32), A-Z in lower case."""
    return text.lower().split()


def _texts(column: pa.Array):
    return (x.as_py() or b"" for x in column.cast(pa.large_binary()))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: over all documents, the end token included."""

    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for text in _texts(b.column(0)):
                found.update(tokens(text))
            found[END.encode()] += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> DataFrame:
    """Words of the highest counts, HOT at most: counts from the least power of two on above which there are no more words."""
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    total, least = 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > HOT:
            break
        least = k
    return counts.where(F.col("c") >= F.lit(2.0) ** least)


#: The stand-in of each pair of last bytes; a word of one byte has a blank before it.
STAND_IN = (np.arange(256)[:, None] * 31 + np.arange(256)[None]) % UNKNOWN


def stand_ins(words: list[bytes]) -> np.ndarray:
    """Of each word."""
    last = np.frombuffer(b"".join([w[-2:].rjust(2) for w in words]), np.uint8).reshape(-1, 2)
    return STAND_IN[last[:, 0], last[:, 1]]


#: Contexts of one, two and three bytes; of the longer ones so many are told apart by a hash.
CONTEXTS = (256, 1 << 12, 1 << 14)
_BEGINS = np.cumsum((0, *CONTEXTS)) * 256


def backwards(words: list[bytes]) -> np.ndarray:
    """The words from the last to the first, each from its last byte to its first and closed by a blank, behind three blanks."""
    return np.frombuffer(b"   " + b" ".join(words)[::-1] + b" ", np.uint8)


def contexts(data: np.ndarray) -> list[np.ndarray]:
    """For each byte of data but the first three its context of one, two and three bytes behind it; blanks stand for what is before a word."""
    data = data.astype(np.int64)
    one = data[2:-1]
    two = np.where(one == 32, 32, data[1:-2])
    three = np.where(two == 32, 32, data[:-3])
    hashed = lambda x, n: (x * 2654435761 & 0xFFFFFFFF) >> (33 - n.bit_length())
    pair = one | two << 8
    return [one, hashed(pair, CONTEXTS[1]), hashed(pair | three << 16, CONTEXTS[2])]


class Spelling:
    """Of words outside the vocabulary: counts (contexts, 256) of bytes for each length of context, each distinct word once; counts of the stand-ins;
    and how many words occur once. Lengths are mixed by how many bytes follow a context (Witten and Bell's estimate)."""

    def __init__(self, counts: list[np.ndarray], stand_ins: np.ndarray, once: float):
        self.counts = stand_ins
        #: of the tokens outside the vocabulary, the share that was seen in training (Good and Turing's estimate)
        self.seen = float(np.clip(1 - once / max(1.0, stand_ins.sum()), 0.05, 0.99))
        p = counts[0].sum(0) + 0.05
        p[[9, 10, 11, 12, 13]] = 1e-12
        self.flat = (p / p.sum()).astype(np.float32)
        self.own, self.less = [], []
        for n in counts:
            kinds = np.maximum(1.0, (n > 0).sum(1))
            whole = n.sum(1) + kinds
            self.own.append((n / whole[:, None]).astype(np.float32).ravel())
            self.less.append((kinds / whole).astype(np.float32))
        pair = np.arange(65_536)  # last byte b, the one before it a (or a blank)
        b, a = pair >> 8, pair & 255
        blank = np.full_like(b, 32)
        ending = self.probabilities(np.stack([blank, blank, blank, b], 1).ravel().astype(np.uint8))[::4]
        more = self.probabilities(np.stack([blank, blank, b, a], 1).ravel().astype(np.uint8))[::4]
        mass = np.where(b == 32, 0.0, ending.astype(float) * more)
        self.mass = np.bincount(STAND_IN[a, b], mass, UNKNOWN)

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Of each byte of data but the first three."""
        byte = data[3:].astype(np.int64)
        p = self.flat[byte]
        for context, own, less in zip(contexts(data), self.own, self.less):
            p = own[context << 8 | byte] + less[context] * p
        return p

    def log(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' probabilities."""
        if not words:
            return np.zeros(0)
        data = backwards(words)
        along = np.cumsum(np.log(np.maximum(self.probabilities(data), 1e-30)), dtype=float)
        return np.diff(along[np.flatnonzero(data[3:] == 32)], prepend=0.0)[::-1]


def spelling(counts: DataFrame, known: set[bytes]) -> Spelling:
    """From the counts of all words but those in `known`."""
    size = int(_BEGINS[-1]) + UNKNOWN + 1

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            rows = [(w, c) for w, c in zip((x.as_py() for x in b.column(0)), b.column(1).to_pylist()) if w not in known and w != END.encode()]
            if rows:
                data = backwards([w for w, _ in rows])
                byte = data[3:].astype(np.int64)
                for begin, context in zip(_BEGINS, contexts(data)):
                    total[begin:] += np.bincount(context << 8 | byte, minlength=size - begin)
                each = np.array([c for _, c in rows])
                last = np.array([w[-1] for w, _ in rows])
                prior = np.array([w[-2] if len(w) > 1 else 32 for w, _ in rows])
                total[_BEGINS[-1] : -1] += np.bincount(STAND_IN[prior, last], each, UNKNOWN)
                total[-1] += (each == 1).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["place", "n"])

    n = np.zeros(size)
    found = counts.select("word", "c").mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # `size` rows of 12 bytes at most
    n[found["place"].to_numpy()] = found["n"].to_numpy()
    return Spelling([n[i:j].reshape(-1, 256) for i, j in zip(_BEGINS, _BEGINS[1:])], n[_BEGINS[-1] : -1], n[-1])


def sums_by_id(ids: np.ndarray, rows: np.ndarray, often: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids (small integers), and the sum of each one's rows. Ids of more than `often` rows are summed one by one, the others together: all their first rows, all their second ones, ..."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    own = ids[order]
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    counts = np.diff(begins, append=len(ids))
    falling = np.argsort(-counts, kind="stable")
    begins, counts = begins[falling], counts[falling]
    reach = np.searchsorted(-counts, -np.arange(often + 1), "left")  # how many ids have more than so many rows
    many, total = reach[often], np.empty((len(begins), rows.shape[1]), rows.dtype)
    one = np.ones(counts[0], rows.dtype)
    for i, (lo, n) in enumerate(zip(begins[:many].tolist(), counts[:many].tolist())):
        np.matmul(one[:n], rows.take(order[lo : lo + n], 0), out=total[i])
    total[many:] = rows.take(order[begins[many:]], 0)
    for k in range(1, often):
        total[many : reach[k]] += rows.take(order[begins[many : reach[k]] + k], 0)
    return own[begins], total


class GatedLm:
    """A gated recurrent layer over word ids with a class-factored softmax. Ids are by frequency: class i // CLASS."""

    def __init__(self, frequency: np.ndarray, hidden: int = 16, seed: int = 9):
        self.n, self.h = len(frequency), hidden
        self.classes = -(-self.n // CLASS)
        rng = np.random.default_rng(seed)
        f = np.zeros(self.classes * CLASS)
        f[: self.n] = (frequency + 0.5) / (frequency + 0.5).sum()
        grid = f.reshape(self.classes, CLASS)
        self.w = {
            "x": rng.normal(0, 0.1, (self.n, 3 * hidden)), "zr": rng.normal(0, 0.2, (hidden, 2 * hidden)), "c": rng.normal(0, 0.2, (hidden, hidden)),
            "oc": rng.normal(0, 0.05, (hidden, self.classes)), "bc": np.log(grid.sum(1)),
            "ow": rng.normal(0, 0.05, (self.classes, hidden, CLASS)), "bw": np.log(np.where(grid > 0, grid, 1e-30)),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def by_gate(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For step(), weights of the inputs (3, ids, hidden), of the state (2, hidden, hidden) in the two logistic gates and in the candidate, as exponents: of 1 / (1 + exp(-a)), and of tanh(a) = 2 / (1 + exp(-2a)) - 1."""
        h = self.h
        x = np.ascontiguousarray(self.w["x"].reshape(-1, 3, h).transpose(1, 0, 2))
        zr = np.ascontiguousarray(self.w["zr"].reshape(h, 2, h).transpose(1, 0, 2))
        x[:2] *= -1
        x[2] *= -2
        return x, -zr, -2 * self.w["c"]

    @staticmethod
    def step(x: np.ndarray, zr: np.ndarray, c: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after inputs x (3, lanes, hidden), and what leads to it: z, r, the candidate, r * state, state - candidate. An exponential that overflows gives the right limit."""
        gates = np.matmul(state, zr)
        gates += x[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.divide(1, gates, out=gates)
        z, r = gates
        carried = r * state
        cand = carried @ c
        cand += x[2]
        np.exp(cand, out=cand)
        cand += 1
        np.divide(2, cand, out=cand)
        cand -= 1
        gap = state - cand
        after = z * gap
        after += cand
        return after, z, r, cand, carried, gap

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator]:
        """The order of ids by class, their classes and places in these in that order, and parts of CACHED rows of it:
        begin, end, and (class, begin, end) of the classes' rows in the part."""
        kind = ids // CLASS
        order = np.argsort(kind.astype(np.int16), kind="stable")
        kind = kind[order]
        edges = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()

        def parts():
            begin, found = 0, []
            for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                while lo < hi:
                    stop = min(hi, begin + CACHED)
                    found.append((k, lo, stop))
                    lo = stop
                    if stop == begin + CACHED:
                        yield begin, stop, found
                        begin, found = stop, []
            if found:
                yield begin, edges[-1], found

        return order, kind, ids[order] - kind * CLASS, parts()

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of words in them, with the biases as one more row."""
        return np.concatenate([self.w["oc"], self.w["bc"][None]]), np.concatenate([self.w["ow"], self.w["bw"][:, None]], 1)

    def log_probabilities(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of ids after the states, row by row."""
        out, found = np.empty(len(ids)), np.empty(len(ids))
        order, kind, place, parts = self.by_class(ids)
        classes, words = self.outputs()
        s = np.ones((len(ids), self.h + 1), np.float32)
        s[:, : self.h] = states.take(order, 0)
        held = np.empty((CACHED, CLASS), np.float32)

        def logs(p, at):
            top = p.ravel().take(np.arange(0, p.size, p.shape[1]) + at).astype(float)
            np.exp(p, out=p)
            return top - np.log(p @ np.ones(p.shape[1], p.dtype))

        for begin, end, runs in parts:
            found[begin:end] = logs(s[begin:end] @ classes, kind[begin:end])
            p = held[: end - begin]
            for k, lo, hi in runs:
                np.matmul(s[lo:hi], words[k], out=p[lo - begin : hi - begin])
            found[begin:end] += logs(p, place[begin:end])
        out[order] = found
        return out

    @np.errstate(over="ignore")
    def score(self, texts: list[np.ndarray], end: int) -> list[np.ndarray]:
        """For each text (its ids, the last one being the end) the log probabilities of its ids. The state goes through the whole text."""
        lengths = np.array([len(t) for t in texts])
        by_length = np.argsort(-lengths, kind="stable")
        sizes = lengths[by_length]
        total, begins = int(sizes.sum()), np.cumsum(sizes) - sizes
        when = np.arange(total) - np.repeat(begins, sizes)
        active = np.bincount(when)
        # all first ids, all second ids, ...; within, longer texts first
        spot = (np.cumsum(active) - active)[when] + np.repeat(np.arange(len(texts)), sizes)
        flat = np.concatenate([texts[i] for i in by_length])
        ids, before = np.empty(total, np.int64), np.empty(total, np.int64)
        ids[spot] = flat
        flat = np.concatenate([[end], flat[:-1]])
        flat[begins] = end
        before[spot] = flat
        states, found = np.empty((HELD_STATES + len(texts), self.h), np.float32), np.empty(total)
        state, at, done = np.zeros((len(texts), self.h), np.float32), 0, 0
        x, *weights = self.by_gate()
        for n in active.tolist():
            state = self.step(x.take(before[at : at + n], 1), *weights, state[:n])[0]
            states[at - done : at - done + n] = state
            at += n
            if at - done >= HELD_STATES or at == total:
                found[done:at] = self.log_probabilities(states[: at - done], ids[done:at])
                done = at
        parts = np.split(found[spot], begins[1:])
        out: list = [None] * len(texts)
        for i, part in zip(by_length.tolist(), parts):
            out[i] = part
        return out

    @np.errstate(over="ignore")
    def gradients(self, ids: np.ndarray, before: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of one window: ids and before (steps, lanes), state (lanes, hidden). Also the state after it and the mean loss.

        Behind an end token the state is zero, within a window too, as it is where a text begins in score()."""
        w, h, (steps, lanes) = self.w, self.h, ids.shape
        n, kind_of = ids.size, w["x"].dtype
        x, *weights = self.by_gate()
        dead = [np.flatnonzero(b == UNKNOWN) for b in before]
        held, states = [], np.empty((steps, lanes, h), kind_of)
        for t in range(steps):
            if len(dead[t]):
                state = state.copy()
                state[dead[t]] = 0
            states[t], *rest = self.step(x.take(before[t], 1), *weights, state)
            held.append((state, *rest))
            state = states[t]
        order, kind, place, parts = self.by_class(ids.ravel())
        s = np.ones((n, h + 1), kind_of)
        s[:, :h] = states.reshape(n, h).take(order, 0)
        classes, words = self.outputs()
        of_classes, of_words = np.zeros_like(classes), np.zeros_like(words)
        turned, into = np.ascontiguousarray(w["oc"].T), np.ascontiguousarray(w["ow"].transpose(0, 2, 1))
        top, below, loss = np.empty((n, h), kind_of), np.empty((min(n, CACHED), h), kind_of), 0.0
        within = np.empty((min(n, CACHED), CLASS), kind_of)

        def slopes(p, at):
            """p, logits, becomes the loss's slopes by them; returns the rows' losses' sum."""
            at = np.arange(0, p.size, p.shape[1]) + at
            flat = p.ravel()
            own = float(flat.take(at).sum())
            np.exp(p, out=p)
            sums = p @ np.ones(p.shape[1], kind_of)
            flat[at] -= sums
            p *= (1 / (sums * n))[:, None]
            return float(np.log(sums).sum()) - own

        for begin, end, runs in parts:  # so that what is worked on stays in the processor's cache
            p = s[begin:end] @ classes
            loss += slopes(p, kind[begin:end])
            of_classes += s[begin:end].T @ p
            np.matmul(p, turned, out=top[begin:end])
            p = within[: end - begin]
            for k, lo, hi in runs:
                np.matmul(s[lo:hi], words[k], out=p[lo - begin : hi - begin])
            loss += slopes(p, place[begin:end])
            for k, lo, hi in runs:
                of_words[k] += s[lo:hi].T @ p[lo - begin : hi - begin]
                np.matmul(p[lo - begin : hi - begin], into[k], out=below[lo - begin : hi - begin])
            top[begin:end] += below[: end - begin]
        g = {"x": np.zeros_like(w["x"]), "oc": of_classes[:h], "bc": of_classes[h], "ow": np.ascontiguousarray(of_words[:, :h]), "bw": of_words[:, h].copy()}
        by_step = np.empty_like(top)
        by_step[order] = top
        top = by_step.reshape(steps, lanes, h)
        turned_c, turned_z, turned_r = (np.ascontiguousarray(m.T) for m in (w["c"], w["zr"][:, :h], w["zr"][:, h:]))
        back, inputs, slope = np.zeros((lanes, h), kind_of), np.empty((steps, lanes, 3 * h), kind_of), np.empty((3, lanes, h), kind_of)
        g["c"], of_z, of_r = np.zeros_like(w["c"]), np.zeros_like(turned_z), np.zeros_like(turned_r)
        for t in reversed(range(steps)):
            prior, z, r, cand, carried, gap = held[t]
            back += top[t]
            dz = back * z
            own_z, own_r, dc = slope
            np.multiply(cand, cand, out=dc)
            np.subtract(1, dc, out=dc)
            back -= dz
            dc *= back
            through = dc @ turned_c
            np.subtract(1, z, out=own_z)
            own_z *= dz
            own_z *= gap
            np.subtract(1, r, out=own_r)
            own_r *= carried
            own_r *= through
            g["c"] += carried.T @ dc
            of_z += prior.T @ own_z
            of_r += prior.T @ own_r
            inputs[t].reshape(lanes, 3, h)[:] = slope.transpose(1, 0, 2)
            through *= r
            back = dz
            back += through
            back += own_z @ turned_z
            back += own_r @ turned_r
            back[dead[t]] = 0
        g["zr"] = np.concatenate([of_z, of_r], 1)
        found, total = sums_by_id(before.ravel(), inputs.reshape(-1, 3 * h))
        g["x"][found] = total
        return g, state, loss / n

    def train(self, stream: np.ndarray, end: int, lanes: int = 64, window: int = 16, updates: int = 500, rate: float = 0.04) -> GatedLm:
        """stream: ids of texts in a row, each closed by the end. Lanes read on from window to window with their state, reset at a text's begin.

        Every id is read: there are as many updates as one pass takes, or `updates` if those are more. The last lane is filled up from the stream's begin."""
        if not len(stream):
            return self
        span = max(2, -(-len(stream) // lanes))
        grid = np.resize(stream, (lanes, span))
        updates = max(updates, -(-span // window))
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        state, at = np.zeros((lanes, self.h), np.float32), 0
        for i in range(1, updates + 1):
            if at >= span:
                state, at = np.zeros_like(state), 0
            stop = min(at + window, span)
            ids = grid[:, at:stop].T
            before = np.concatenate([grid[:, at - 1 : at].T if at else np.full((1, lanes), end), ids[:-1]])
            g, state, _ = self.gradients(ids, before, state)
            norm = max(1.0, np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
            # g /= norm, m += 0.1 * (g - m), v += 0.01 * (g * g - v), w -= rate * m / (sqrt(v) + 1e-6), m and v corrected for their start
            root = (1 - 0.99**i) ** 0.5
            pace = np.float32(rate * (1 - i / (updates + 1)) / (1 - 0.9**i) * root)
            for k in g:
                for own_w, own_m, own_v, x in zip(*(np.array_split(a.reshape(-1), -(-a.size // 16_384)) for a in (self.w[k], m[k], v[k], g[k]))):  # in place, as much as a cache holds
                    own_m *= np.float32(0.9)
                    own_m += np.float32(0.1 / norm) * x
                    own_v *= np.float32(0.99)
                    x *= x
                    x *= np.float32(0.01 / norm**2)
                    own_v += x
                    np.sqrt(own_v, out=x)
                    x += np.float32(1e-6 * root)
                    np.divide(own_m, x, out=x)
                    x *= pace
                    own_w -= x
            at = stop
        return self

    def packed(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in sorted(self.w))

    def unpacked(self, data: bytes) -> GatedLm:
        """Takes the weights that packed() gave."""
        flat, at = np.frombuffer(data, np.float32), 0
        for k in sorted(self.w):
            self.w[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape).copy()
            at += self.w[k].size
        return self


def _encoder(names: dict[bytes, int]):
    """Of batches (place, text): place, the text's ids with the end as two bytes each, and how many they are."""

    class Ids(dict):
        def __missing__(self, w: bytes) -> int:
            found = int(STAND_IN[w[-2] if len(w) > 1 else 32, w[-1]])
            if len(self) < HOT:
                self[w] = found
            return found

    def run(batches):
        known = Ids(names)
        for b in batches:
            ids = []
            for text in _texts(b.column(1)):
                words = tokens(text)
                ids.append(np.append(np.fromiter(map(known.__getitem__, words), np.uint16, len(words)), np.uint16(UNKNOWN)))
            arrays = [b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", "ids", "n"])

    return run


def shard_count(rows: int, n_tokens: int, shard: int = SHARD, shard_tokens: int = SHARD_TOKENS) -> int:
    """Shards of about `shard` documents, or of about `shard_tokens` tokens where documents are long."""
    return max(1, round(rows / shard), -(-n_tokens // shard_tokens))


def trained(train: DataFrame, model: GatedLm, names: dict[bytes, int], share: float = SHARE, shard: int = SHARD, shard_tokens: int = SHARD_TOKENS) -> GatedLm:
    """model after learning from train (doc_id, text), every row once; of less than all with share under 1, those of the smallest hashes."""
    rows = train.select(F.xxhash64("doc_id", "text").alias("place"), F.col("text").cast("binary").alias("text"))
    return learned(rows.mapInArrow(_encoder(names), "place long, ids binary, n long"), model, share, shard, shard_tokens)


def learned(rows: DataFrame, model: GatedLm, share: float = SHARE, shard: int = SHARD, shard_tokens: int = SHARD_TOKENS) -> GatedLm:
    """model after learning from rows (place: a hash of the document, ids: two bytes each, the end being the last, n: how many), as trained() does from texts."""
    if share < 1:
        rows = rows.where(F.pmod("place", F.lit(1_000_000_007)) < int(share * 1_000_000_007) + 1)
    # equal rows are counted and dealt apart by their number, lest they come to one shard
    texts = rows.groupBy("place", "ids", "n").agg(F.count("*").alias("times"))
    texts = texts.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).select(F.xxhash64("place", "copy").alias("place"), "ids", "n")
    texts = staged(texts, "lm-shards")
    sizes = texts.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    if not sizes.rows:
        return model
    shards = shard_count(sizes.rows, sizes.tokens, shard, shard_tokens)
    texts = texts.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("task", F.floor(F.col("shard") / TASK_SHARDS).cast("int"))
    kind = "shard int, tokens long, weights binary"

    def learn(start: bytes, updates: int, rate: float):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            total, read = 0.0, 0
            for _, own in rows.sort_values(["place", "ids"]).groupby("shard"):
                ids = np.frombuffer(b"".join(own["ids"]), np.uint16).astype(np.int64)
                weights = GatedLm(np.ones(model.n), model.h).unpacked(start).train(ids, UNKNOWN, lanes=min(LANES, max(16, len(ids) // LANE_TOKENS)), updates=updates, rate=rate).packed()
                total, read = total + len(ids) * np.frombuffer(weights, np.float32).astype(float), read + len(ids)
            return pd.DataFrame({"shard": [rows["task"].iloc[0]], "tokens": [read], "weights": [(total / read).astype(np.float32).tobytes()]})

        return run

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        share_of = rows["tokens"].to_numpy() / rows["tokens"].sum()
        total = sum(w * np.frombuffer(x, np.float32) for w, x in zip(share_of, rows["weights"]))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0]) // 16], "tokens": [int(rows["tokens"].sum())], "weights": [total.astype(np.float32).tobytes()]})

    least = texts.agg(F.min("shard")).first()[0]
    first = texts.where(F.col("shard") == least).groupBy("task").applyInPandas(learn(model.packed(), FIRST_UPDATES, 0.04), kind).first()
    if shards > 1:
        tasks = -(-shards // TASK_SHARDS)
        dealt = texts.repartition(tasks, "task").groupBy("task").applyInPandas(learn(bytes(first.weights), 0, 0.01), kind)
        parts = staged(dealt, "lm-weights")
        while tasks > 1:
            parts = parts.groupBy(F.floor(F.col("shard") / 16)).applyInPandas(mean, kind)
            tasks = -(-tasks // 16)
        first = parts.first()
    return model.unpacked(bytes(first.weights))


@functools.lru_cache(maxsize=2)
def hot_table(path: str) -> tuple[dict, np.ndarray]:
    """Of a Python worker, which Spark uses for many tasks: places of the frequent words by falling count, and their counts."""
    store, root = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    tables = [pq.read_table(f, filesystem=store, columns=["word", "c"]) for f in files]
    rows = [x for t in tables for x in zip(t["word"].to_pylist(), t["c"].to_pylist())]
    rows.sort(key=lambda x: (-x[1], x[0]))
    return {w: i for i, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], np.int64)


@functools.lru_cache(maxsize=2)
def hot_spellings(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of a Python worker: the frequent words by place, their stand-ins, and what their own probabilities add to a score, which whoever needs one fills in; the last is of all other words, 0."""
    words = list(hot_table(path)[0])
    return words, stand_ins(words), np.append(np.full(len(words), np.nan), 0.0)


def scores(docs: DataFrame, learn_from: Column, held_out: Column, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); learn_from and held_out are conditions on doc_id."""
    spark = docs.sparkSession
    train = docs.where(learn_from).select("doc_id", "text")
    counts = staged(word_counts(train), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, log_all = int(totals.n), np.log10(totals.n + 0.1 * (totals.v + 1))

    hot_path = fresh_path(spark, "frequent-words")
    frequent(counts).coalesce(4).write.parquet(hot_path)
    hot = spark.read.schema("word binary, c long").parquet(hot_path)
    best = [(bytes(r.word), r.c) for r in hot.orderBy(F.desc("c"), "word").limit(VOCABULARY - UNKNOWN - 1).collect()]
    # ids: the stand-ins, the end, then words by falling count
    names = {w: i + UNKNOWN + 1 for i, (w, _) in enumerate(x for x in best if x[0] != END.encode())}
    n_end = next((c for w, c in best if w == END.encode()), 0)
    in_vocabulary = [c for w, c in best if w != END.encode()]
    spelled = spelling(counts, set(names))
    frequency = np.array([*spelled.counts, n_end, *in_vocabulary], float)
    kind = docs.schema["doc_id"].dataType.simpleString()
    flag = lambda c: F.coalesce(c, F.lit(False))
    told = docs.select("doc_id", flag(held_out).alias("held_out"), flag(learn_from).alias("taught"), F.xxhash64("doc_id", "text").alias("place"), "text")

    cold_type = pa.list_(pa.struct([("word", pa.binary()), ("share", pa.float64()), ("spelt", pa.float64())]))

    def run(batches):
        place, c = hot_table(hot_path)
        by_place, hot_kind, hot_own = hot_spellings(hot_path)
        end = END.encode()
        # by place, and of words that aren't frequent: what the base gives, the id, and log10(count * share + 10 ** spelled) of those outside the vocabulary, each worked out once a worker
        in_base = np.append(np.log10(c + 0.1) - log_all, 0.0)
        to_id = np.array([names.get(w, -1) for w in by_place], np.int64)
        hot_own[:-1][to_id >= 0] = 0
        to_id = np.append(np.where(to_id < 0, hot_kind, to_id), 0).astype(np.uint16)
        base_end, known_end = (float(in_base[place[end]]), 1) if end in place else (float(-1 - log_all), 0)
        per_count = spelled.seen / np.maximum(1, spelled.counts)
        log_mass = np.log10(1 - spelled.seen) - np.log10(np.maximum(spelled.mass, 1e-300))

        def parts(words, kind):
            """share and spelled of words outside the vocabulary"""
            return per_count[kind], spelled.log(words) / np.log(10) + log_mass[kind]

        def block(texts):
            """Ids, n_tokens, n_known, base, the part of the score that the network doesn't tell, and number of words that aren't among the frequent ones of each, and these words."""
            words = [tokens(t) for t in texts]
            sizes = np.array([len(w) for w in words])
            joined = list(itertools.chain.from_iterable(words))
            at = np.fromiter(map(place.get, joined, itertools.repeat(-1)), np.int32, len(joined))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            ids, own = to_id[at], hot_own[at]
            new = np.unique(at[np.isnan(own)])
            if len(new):
                share, spelt = parts([by_place[i] for i in new.tolist()], hot_kind[new])
                hot_own[new] = np.log10(c[new] * share + 10.0**spelt + 1e-300)
                own = hot_own[at]
            rare = np.flatnonzero(at < 0)
            others = [joined[i] for i in rare.tolist()]
            kind = stand_ins(others)
            ids[rare] = kind
            share, spelt = parts(others, kind)  # the count of a rare word is joined later
            whole = np.insert(ids, edges[1:], UNKNOWN).tobytes()
            ends = ((edges + np.arange(len(edges))) * 2).tolist()
            coded = [whole[i:j] for i, j in zip(ends, ends[1:])]
            sums = lambda v: np.diff(np.append(0, np.cumsum(v))[edges])
            each = np.diff(np.searchsorted(rare, edges))
            cold = pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(share), pa.array(spelt)], fields=list(cold_type.value_type))
            return coded, sizes + 1, sizes - each + known_end, sums(in_base[at]) + base_end, sums(own), each, cold

        for b in batches:
            out, group, size = [], [], 0
            for text in _texts(b.column(4)):
                group.append(text)
                size += len(text)
                if size >= BLOCK_TOKENS * 6:
                    out.append(block(group))
                    group, size = [], 0
            if group or not out:
                out.append(block(group))
            mark = os.urandom(12)  # with its place, a name of the row; this frame is written once and read from there
            names_ = [mark + i.to_bytes(4, "big") for i in range(b.num_rows)]
            join = lambda k: pa.array(np.concatenate([o[k] for o in out]))
            begins = np.concatenate([[0], np.cumsum(np.concatenate([o[5] for o in out]))])
            cold = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.concat_arrays([o[6] for o in out]))
            coded = pa.array(itertools.chain.from_iterable(o[0] for o in out), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names_, pa.binary()), *b.columns[:4], coded, join(1), join(2), join(3), join(4), cold.cast(cold_type)],
                names=["row", "doc_id", "held_out", "taught", "place", "ids", "n", "hot_known", "hot_base", "hot_score", "cold"],
            )

    hot_columns = "hot_known long, hot_base double"
    rows = staged(told.mapInArrow(run, f"row binary, doc_id {kind}, held_out boolean, taught boolean, place long, ids binary, n long, {hot_columns}, hot_score double, cold array<struct<word: binary, share: double, spelt: double>>"), "lm-rows")
    model = learned(rows.where("taught").select("place", "ids", "n"), GatedLm(frequency), share)

    def read(batches):
        for b in batches:
            ids, out = b.column(6), np.empty(b.num_rows)
            sizes = b.column(3).to_numpy()
            order, group, size = np.argsort(-sizes, kind="stable"), [], 0  # texts of about one length are read in step
            for turn, i in enumerate(order.tolist(), 1):
                group.append(i)
                size += sizes[i]
                if size >= BLOCK_TOKENS or turn == len(order):
                    found = model.score([np.frombuffer(ids[k].as_buffer(), np.uint16).astype(np.int64) for k in group], UNKNOWN)
                    out[group] = [f.sum() for f in found]
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out / np.log(10) + b.column(7).to_numpy())], names=["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_base", "score"])

    scored = rows.select("row", "doc_id", "held_out", "n", "hot_known", "hot_base", "ids", "hot_score").mapInArrow(read, f"row binary, doc_id {kind}, held_out boolean, n_tokens long, {hot_columns}, score double")
    rare = rows.select("row", F.explode("cold").alias("cold")).select("row", "cold.*").join(counts, "word", "left")
    value = F.log10(F.coalesce("c", F.lit(0)) + 0.1) - float(log_all)
    own = F.when(F.col("c").isNull(), F.col("spelt")).otherwise(F.log10(F.col("c") * F.col("share") + F.pow(F.lit(10.0), "spelt")))
    rare = rare.groupBy("row").agg(F.sum(value).alias("cold_base"), F.sum(own).alias("cold_score"), F.count("c").alias("cold_known"))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("cold_score", F.lit(0.0))).alias("score"),
    )
