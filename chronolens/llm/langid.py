"""Language identification by a bidirectional gated recurrent network over bytes.

Method. A text's bytes, whole, go through two gated recurrent layers, one from the left and one from the right; from both states
together every position gets a probability of each language, and a document's probabilities are the means over its
positions. The states are carried from the text's first byte to its last, and from its last to its first, and start at zero there. Many texts
of about one length are read in step. Of a text longer than WINDOW bytes its windows are, each with WARM bytes more on either side that are read
but not counted: behind so many the states are those of the whole text but for rounding. The network is trained in numpy by backpropagation
through time over all steps of a piece of text, each position being taught its document's language.

Learning uses whole texts of a bounded sample: of each language of the training rows limit / languages documents, LEAST if that is fewer (those of the
smallest hashes; all of a language with fewer), up to a number of bytes and of languages that are parameters. A text is cut into pieces of 16, 32, 64 or 128 bytes, so that short texts are known too, and every
piece is taught once at least. Without any such row, every text is `und` with score 0.

Nulls: a text that is null or holds no letter is `und` with score 0. Repeated rows get a row each. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Documents sampled of each language at least.
LEAST = 50
#: Languages that are learned at most, those of most texts.
LANGUAGES = 1_000
#: Bytes of a window and those read before and behind it, and bytes whose states are held at once.
WINDOW, WARM, GROUP = 2_048, 192, 1_400_000
#: Sizes of the pieces that texts are cut into for learning.
PIECES = (16, 32, 64, 128)


class ByteBiGru:
    """Arrays are laid out feature by feature, sequences along the last axis. Gates: update z, reset r, candidate c."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        self.languages, self.hidden = languages, hidden
        rng, h, k = np.random.default_rng(seed), hidden, len(languages)
        self.w = {"out": rng.normal(0, 0.3, (k, 2 * h)), "bias": np.zeros((k, 1))}
        for d in "fb":
            self.w |= {f"{d}x": rng.normal(0, 0.3, (3 * h, 256)), f"{d}zr": rng.normal(0, 0.3, (2 * h, h)), f"{d}c": rng.normal(0, 0.3, (h, h))}
        self.w = {name: v.astype(np.float32) for name, v in self.w.items()}

    def _reader(self, d: str):
        """A function (bytes (n), state (h, n), out (h, n) or None) that gives the next state of one direction (in out), and its z, r and candidate."""
        h, half = self.hidden, np.float32(0.5)
        table = np.concatenate([self.w[d + "x"][: 2 * h] * half, self.w[d + "x"][2 * h :]])  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        zr, c = self.w[d + "zr"] * half, self.w[d + "c"]

        def step(data, state, out=None):
            x = np.take(table, data, axis=1, mode="clip")
            gates = np.matmul(zr, state)
            gates += x[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r = gates[:h], gates[h:]
            cand = np.matmul(c, r * state)
            cand += x[2 * h :]
            np.tanh(cand, out=cand)
            new = np.subtract(state, cand, out=out)
            new *= z
            new += cand
            return new, z, r, cand

        return step

    def gradients(self, data: np.ndarray, label: np.ndarray, real: np.ndarray | None = None) -> tuple[float, dict]:
        """data (steps, n), label (n), real (steps, n): false where a text has ended, which is neither read from the right nor taught."""
        h, (steps, n) = self.hidden, data.shape
        kind = self.w["out"].dtype
        live = np.ones((steps, n), kind) if real is None else real.astype(kind)
        taught = live.sum()
        held, both = {"f": [], "b": []}, np.empty((steps, 2 * h, n), kind)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            step, state = self._reader(d), np.zeros((h, n), kind)
            for t in order:
                new, z, r, cand = step(data[t], state)
                held[d].append((t, state, z, r, cand))
                state = new * live[t] if d == "b" else new
                both[t, slice(0, h) if d == "f" else slice(h, None)] = state
        logits = np.matmul(self.w["out"], both) + self.w["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(np.log(p[:, label, np.arange(n)] + 1e-9) * live).sum() / taught)
        p[:, label, np.arange(n)] -= 1
        p *= (live / taught)[:, None]
        grad = {"out": np.einsum("tkn,thn->kh", p, both), "bias": p.sum((0, 2))[:, None]}
        top = np.matmul(self.w["out"].T, p)
        for d in "fb":
            zr, c = self.w[d + "zr"], self.w[d + "c"]
            gzr, gc, inputs = np.zeros_like(zr), np.zeros_like(c), np.empty((steps, n, 3 * h), kind)
            back = np.zeros((h, n), kind)
            for t, before, z, r, cand in reversed(held[d]):
                dh = back + (top[t, :h] if d == "f" else top[t, h:])
                if d == "b":
                    dh = dh * live[t]
                dc = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (before - cand) * z * (1 - z)
                through = c.T @ dc
                dr = through * before * r * (1 - r)
                dgates = np.concatenate([dz, dr])
                gc += dc @ (r * before).T
                gzr += dgates @ before.T
                inputs[t, :, : 2 * h], inputs[t, :, 2 * h :] = dgates.T, dc.T
                back = dh * z + through * r + zr.T @ dgates
            order = np.argsort(data, axis=None, kind="stable")
            bytes_, begins = np.unique(data.ravel()[order], return_index=True)
            gx = np.zeros((256, 3 * h), kind)
            gx[bytes_] = np.add.reduceat(inputs.reshape(-1, 3 * h)[order], begins)
            grad |= {d + "x": gx.T, d + "zr": gzr, d + "c": gc}
        return loss, grad

    def train(self, texts: list[bytes], label: np.ndarray, least: int = 350, most: int = 800, rate: float = 0.02, seed: int = 3) -> ByteBiGru:
        """Steps of Adam over all pieces of texts (none of them empty), in passes until there were `least` steps; one pass takes about `most`, by larger steps where there is much to read."""
        rng = np.random.default_rng(seed)
        pieces: dict[int, list] = {size: [] for size in PIECES}
        for i, text in enumerate(texts):
            size = PIECES[i % len(PIECES)]
            pieces[size] += [(i, at, min(size, len(text) - at)) for at in range(0, len(text), size)]
        step_bytes = max(8_192, sum(map(len, texts)) // most)
        flat, begins = np.frombuffer(b"".join(texts) + bytes(max(PIECES)), np.uint8), np.cumsum([0, *map(len, texts)])
        held = {size: np.array(found).reshape(-1, 3) for size, found in pieces.items()}

        def batches():
            while True:
                rows = [(size, part) for size, x in held.items() if len(x) for part in np.array_split(rng.permutation(len(x)), max(1, len(x) * size // step_bytes))]
                for k in rng.permutation(len(rows)):
                    size, part = rows[k]
                    of, at, n = held[size][part].T
                    yield flat[(begins[of] + at)[None] + np.arange(size)[:, None]], label[of], np.arange(size)[:, None] < n[None]
                yield None

        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        one_pass = sum(max(1, len(x) * size // step_bytes) for size, x in held.items() if len(x))
        steps, source = -(-least // one_pass) * one_pass, batches()
        for i in range(1, steps + 1):
            while (batch := next(source)) is None:
                pass
            data, of, real = batch
            _, grad = self.gradients(np.where(real, data, 0), of, real)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1.0, 3 * (1 - i / (steps + 1)))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities over the positions of each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.languages)))
        pieces = [(max(0, at - WARM), min(len(t), at + WINDOW + WARM), i, at) for i, t in enumerate(texts) for at in range(0, len(t), WINDOW)]
        pieces.sort(key=lambda x: x[0] - x[1])  # so that those of about one length are read in step
        some, size = [], 0
        for piece in [*pieces, None]:
            if some and (piece is None or size + piece[1] - piece[0] > GROUP):
                owner = np.array([i for _, _, i, _ in some])
                begin = np.array([at - a for a, _, _, at in some])
                end = np.array([min(at + WINDOW, len(texts[i])) - a for a, _, i, at in some])
                np.add.at(total, owner, self._in_step([texts[i][a:b] for a, b, i, _ in some], begin, end))
                some, size = [], 0
            if piece:
                some.append(piece)
                size += piece[1] - piece[0]
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]

    def _in_step(self, texts: list[bytes], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Sums of the probabilities at positions first to stop - 1 of texts that get shorter and shorter: byte t of all texts that have one is one step."""
        h, k, out = self.hidden, len(self.languages), self.w["out"]
        length = np.array([len(t) for t in texts])
        steps = int(length[0])
        active = len(texts) - np.searchsorted(length[::-1], np.arange(steps), "right")  # texts longer than t
        begins = np.concatenate([[0], np.cumsum(active)])
        owner = np.arange(begins[-1]) - np.repeat(begins[:-1], active)
        counted = np.repeat(np.arange(steps), active)
        counted = (counted >= first[owner]) & (counted < stop[owner])
        data = np.empty(begins[-1], np.uint8)
        for i, text in enumerate(texts):
            data[begins[: len(text)] + i] = np.frombuffer(text, np.uint8)
        begins, active = begins.tolist(), active.tolist()
        states = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            step, held, state = self._reader(d), np.empty((h, len(data)), np.float32), np.zeros((h, len(texts)), np.float32)
            for t in order:  # from the right, a text that ends here comes in with the state zero
                a, b, n = begins[t], begins[t + 1], active[t]
                state[:, :n] = step(data[a:b], state[:, :n], held[:, a:b])[0]
            states[d] = held
        total = np.zeros((k, len(texts)))
        for a in range(0, len(data), 65_536):
            part = slice(a, a + 65_536)
            logits = out[:, :h] @ states["f"][:, part]
            logits += out[:, h:] @ states["b"][:, part]
            logits += self.w["bias"]
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= counted[part] / logits.sum(0)
            for j in range(k):
                total[j] += np.bincount(owner[part], logits[j], len(texts))
        return total.T


def fit(docs: DataFrame, learn_from: Column, limit: int = 2_000, limit_bytes: int = 64_000_000) -> ByteBiGru | None:
    """docs: doc_id, text, lang; learn_from: a condition on doc_id. `limit` whole texts (LEAST of each language, if those are more) come to the driver, where the network learns;
    of each language no more once they reach its share of limit_bytes. The LANGUAGES most frequent ones are learned."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learn_from & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    # repeated rows count once here too: a language of few texts that repeat is taken whole
    counted = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r.lang: r.n for r in counted.collect()}
    if not sizes:
        return None
    each = max(LEAST, limit // len(sizes))
    # repeated rows count once; about twice as many as wanted pass by their hashes, of which each language's smallest are taken
    below = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * each / n)) for lang, n in sizes.items()], "lang string, passing double")
    hashed = hashed.join(F.broadcast(below), "lang").where(F.pmod("h", F.lit(1_000_000_007)) <= F.col("passing") * 1_000_000_007)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000_007)), "doc_id"))
    before = Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    first = hashed.dropDuplicates(["h", "lang"]).withColumn("nth", nth).where(F.col("nth") <= each).withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    some = first.where(F.col("before") < limit_bytes // len(sizes)).select("lang", "doc_id", F.encode("text", "UTF-8").alias("text")).collect()
    some = sorted((r.doc_id, r.lang, bytes(r.text)) for r in some if LETTER.search(bytes(r.text).decode("utf-8", "ignore")))
    if not some:
        return None
    languages = sorted({lang for _, lang, _ in some})
    return ByteBiGru(languages).train([text for _, _, text in some], np.array([languages.index(lang) for _, lang, _ in some]))


def identified(docs: DataFrame, model: ByteBiGru | None, columns: list[str], block_bytes: int = 5_000_000) -> DataFrame:
    """columns of docs, lang_pred and score (the pooled probability of lang_pred)."""
    held = in_small_batches(docs.select(*columns, F.col("text").alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("__text").schema)

    def label(block):
        known = [bool(model) and bool(LETTER.search(t.decode("utf-8", "replace"))) for t in block]
        if model is None:
            return [(UNKNOWN, 0.0)] * len(block)
        p = model.pool(block)
        best = p.argmax(1)
        return [(model.languages[j], min(1.0, float(p[i, j]))) if ok else (UNKNOWN, 0.0) for i, (j, ok) in enumerate(zip(best.tolist(), known))]

    def run(batches):
        for b in batches:
            found, block, size = [], [], 0
            for x in b.column(b.num_columns - 1).cast(pa.large_binary()):
                block.append(x.as_py() or b"")
                size += len(block[-1])
                if size >= block_bytes:
                    found += label(block)
                    block, size = [], 0
            found += label(block) if block else []
            arrays = [*(b.column(i) for i in range(b.num_columns - 1)), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "lang_pred", "score"])

    return held.mapInArrow(run, f"{schema}, lang_pred string, score double")
