"""Robust outliers, spelling variants and fill-in-the-middle on odd rows and against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolens.llm import infill, outliers, variants

SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, kept string, own string, size long"
WORDS = "river stone cloud winter letter garden silver market candle window bridge forest meadow harbour thunder".split()


def frame(spark, rows):
    """(doc_id, text, lang, source) with extra columns called like the operators' own."""
    return spark.createDataFrame([(*r, 1, "w", "k", "o", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one line"), (2, "a\nb\n\nc"), (3, None), (4, ""), (5, "\n\n"), (6, "é\nü 😀\nñ\n"), (7, "holds <M> inside\nx\n"), (8, "l\n" * 30_000), (2, "a\nb\n\nc"), (None, "no id\n1"), (None, None)]
    return frame(spark, [(i, t, None, None) for i, t in rows])


# fill-in-the-middle


def test_ranked_bits():
    rng = random.Random(1)
    for size in (1, 2, 3, 64, 65, 1000):
        bits = rng.getrandbits(size) | 1
        places = [i for i in range(size) if bits >> i & 1]
        assert [infill.select(bits, k) for k in range(len(places))] == places


def test_infilled_equals_plain_cutting(spark, docs):
    def plain(doc_id, text):
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or "<M>" in text:
            return len(units), "plain", None, None, text
        spm = h[3] % 100 < 50
        return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"

    some = docs.union(frame(spark, [(100 + i, "\n".join(random.Random(i).choices(["x<P", "é>", "", "<", "S>", "ab c"], k=i)), "l", "s") for i in range(60)]))
    made = infill.infilled(some, ["doc_id", "text", "word"]).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert len(got) == some.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text) and r.back == (r.text or "") and r.word == "w"
    assert infill.infilled(docs.limit(0), ["doc_id"]).count() == 0


def test_infill_rates_and_sentinels(spark, docs):
    none = infill.infilled(docs, ["doc_id"], fim_percent=0).collect()
    assert {r.form for r in none} == {"plain"}
    other = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = infill.infilled(docs, ["doc_id", "text"], sentinels=other, spm_percent=0).withColumn("back", infill.restored(F.col("output"), F.col("form"), other))
    assert all(r.back == (r.text or "") and r.form == ("psm" if r.text else "plain") for r in made.collect())


def test_infill_batches_by_size(spark, monkeypatch):
    rows = frame(spark, [(i, f"line {i}\n" * 2_000, None, None) for i in range(40)]).coalesce(1)
    monkeypatch.setattr(infill, "BATCH_BYTES", 30_000)
    assert sorted((r.doc_id, r.n) for r in infill.infilled(rows, ["doc_id"]).collect()) == [(i, 2_000) for i in range(40)]


# spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(n: dict[str, int], ratio: int = 5) -> dict:
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(400)} | {"aaaaaa", "aaaaa", "aaaaaaa", "baaaaa", "aaaaab", "a", "b", "ab"}
    n = {w: rng.choice([5, 5, 6, 30, 31, 160, 900, 5_000, 30_000]) for w in sorted(words)}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_groups(n) and any(r[0] and r[0] != r[1] for r in got.values())


def test_variants_under_one_prefix(spark):
    """A third of all words in one subtree: pairs across and inside it are all met."""
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choices("abcd", k=5)) for _ in range(300)} | {"".join(rng.choices("prefixabcd", k=9)) for _ in range(500)} | {"refixabcda", "prefixabcda", "xprefixabcda"}
    n = {w: 1 + zlib.crc32(w.encode()) % 2_000 for w in words}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_groups(n)


def test_very_long_words(spark):
    """A run of letters as long as a book, beside long words that differ at their begin, middle and end, or are one another's beginnings."""
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefgh", k=700))
    words = [base, "z" + base[1:], base[:350] + "q" + base[351:], base[:-1] + "q", base[:-1], base + "x", base[:32], base[:33], base[:31], base[:64], base[:63] + "q", base[:100] + base[101:], "y" * 150_000, "v" * 150_000]
    n = {w: 5 * 6**i for i, w in enumerate(words[:12])} | {words[12]: 7, words[13]: 9}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    short = {w: k for w, k in n.items() if len(w) < 1_000}
    assert {w: v for w, v in got.items() if w in short} == plain_groups(short) and sum(v[3] for v in got.values()) > 12
    assert got[words[12]] == (None, words[12], 7, 0, None) and len(got) == 14


def test_word_counts(spark, docs):
    rows = [(i, "Winter WINTER wintér ÉCLAIRS éclairs short wint3rly thunder-thunder harbour" + "x" * (i % 2) * 5_000, None, None) for i in range(400)]
    some = frame(spark, [*rows, (3, None, None, None), (4, "", None, None), (None, "harbour thunder", None, None)])
    want: Counter = Counter()
    for i, text, *_ in [*rows, (None, "harbour thunder", None, None)]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] += 1
    got = {r.word: r.n for r in variants.word_counts(some, deletions=199).collect()}
    assert got == {w: k for w, k in want.items() if k >= 5} and len(got) < len(want) and {"Éclairs", "éclairs"} <= set(got)
    assert variants.variant_groups(variants.word_counts(docs.limit(0))).count() == 0


# robust outliers


def plain_statistics(text: str | None) -> tuple:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(outliers.BLANKS)]
    at: dict = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", " \t\n", "one", "a b c", "a b c a b c", "a a a a a a", "x y\n\n x y\nx y\n \x0b\nz", "é ü # | <b> ** 😀 $", "a b c d " * 2_000, " ".join(map(str, range(30_000))), "p q r s p q r t p q"]


@pytest.mark.parametrize("bits", [20, 4, 1])
def test_statistics_equal_plain_ones(spark, monkeypatch, bits):
    """With few bits for places most texts take the way of the words themselves, with few for hashes the packed windows clash."""
    if bits != 20:
        monkeypatch.setattr(outliers, "PACKED_BITS", bits)
        monkeypatch.setattr(outliers, "PACKED", 1 << bits)
    rng = random.Random(3)
    texts = [t for t in TEXTS if bits == 20 or len(t or "") < 1_000] + ["".join(rng.choices(["ab ", "b ", "c\n", "a | b\n", "\n"], k=rng.randrange(1, 90))) for _ in range(80)]
    got = outliers.statistics(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), ["doc_id", "word"]).collect()
    assert {r.doc_id: tuple(r)[2:] for r in got} == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_clashing_windows_are_told_apart(spark, monkeypatch):
    """So many places that only two bits of the hashes are left."""
    monkeypatch.setattr(outliers, "PACKED_BITS", 62)
    monkeypatch.setattr(outliers, "PACKED", 1 << 62)
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcde", k=rng.randrange(3, 40))) for _ in range(60)]
    got = outliers.statistics(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), ["doc_id"]).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: plain_statistics(t)[5] for i, t in enumerate(texts)}


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS)[: rng.randrange(3, 8)] + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.randrange(60, 400)), "en", "a" if i % 3 else "b") for i in range(300)]
    rows += [(1_000 + i, " ".join(w + "##" for w in prose(i, 120).split()), "en", "a") for i in range(40)]  # symbols
    rows += [(2_000 + i, " ".join(w * 4 for w in prose(i, 90).split()), "en", "b") for i in range(10)]  # words far too long
    rows += [(3_000 + i, prose(7, 100), "en", "a") for i in range(700)]  # one text, most rows of its source
    rows += [(4_000 + i, prose(4_000 + i, 150), lang, src) for i, (lang, src) in enumerate(itertools.product(["xx", None], ["c", "d", None]))]
    rows += [(5_000, None, "en", "a"), (5_001, "", None, None), (None, prose(12, 200), "en", "a"), (5_002, "\n".join(prose(10_000 + i, 12).replace("\n", "") for i in range(1_000)), "en", "a"), (1, rows[1][1], "en", "a")]
    got = outliers.quality_rules(frame(spark, rows), ["doc_id", "own"]).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(300)) and all(kept[3_000 + i] for i in range(700)) and kept[None] and kept[5_002]
    assert not any(kept[i] for i in [*range(1_000, 1_040), *range(2_000, 2_010), 5_000, 5_001]) and all(kept[4_000 + i] for i in range(6))
    assert all((r.distance is None) == r.base_failed for r in got)


def test_no_estimate_without_enough_vectors(spark):
    rows = [(i, prose(i, 80), "en", "a") for i in range(20)] + [(50, "# | " * 40, "en", "a"), (51, " ".join(w + "##" for w in prose(1, 90).split()), "en", "a")]
    got = {r.doc_id: (r.kept, r.distance) for r in outliers.quality_rules(frame(spark, rows), ["doc_id"]).collect()}
    assert got[0] == (True, None) and got[51] == (True, None) and got[50] == (False, None)
    assert outliers.quality_rules(frame(spark, rows).limit(0), ["doc_id"]).count() == 0


def test_estimate_is_the_covariance_of_the_nearest_share(spark):
    """The concentration of one group against numpy: same share, mean, covariance and distances at every step."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, outliers.P)) @ rng.normal(size=(outliers.P, outliers.P)) * 0.3
    x[:60] += 4.0
    vectors = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"{c} double" for c in outliers.X)).repartition(3)
    got = outliers.estimates(vectors, True).first()

    floors = np.diag(np.array(outliers.FLOORS) ** 2)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def concentrate(d2):
        for _ in range(outliers.STEPS):
            bins = np.floor(np.log2(d2 + 1e-12) * outliers.BINS)
            edge = np.sort(bins)[int(np.ceil(len(x) * outliers.H)) - 1]
            h = x[bins <= edge]
            m, c = h.mean(0), np.cov(h.T, bias=True) * outliers.H_FACTOR + floors
            d2 = far(m, c)
        return np.linalg.slogdet(c)[1], d2

    quarter = lambda q: np.sort(x, 0)[int(np.ceil(q * len(x))) - 1]
    scale = np.maximum((quarter(0.75) - quarter(0.25)) / 1.349, outliers.FLOORS)
    ends = [concentrate((((x - quarter(0.5)) / scale) ** 2).sum(1)), concentrate(far(x.mean(0), np.cov(x.T, bias=True) + floors))]
    inside = x[min(ends, key=lambda e: e[0])[1] <= outliers.QUANTILE]
    mean, cov = inside.mean(0), np.cov(inside.T, bias=True) * outliers.Q_FACTOR + floors
    assert [got[f"m{i}"] for i in range(outliers.P)] == pytest.approx(mean.tolist(), abs=1e-9)
    w = np.zeros((outliers.P, outliers.P))
    for i, j in outliers.LOWER:
        w[i, j] = got[f"w{i}_{j}"]
    assert w.T @ w == pytest.approx(np.linalg.inv(cov), rel=1e-6, abs=1e-6)
    assert not (far(mean, cov)[:60] <= outliers.CUTOFF).any() and (far(mean, cov)[60:] <= outliers.CUTOFF).all()
