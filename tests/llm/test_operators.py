"""Each training-data operator on odd rows, and against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolens.llm import ann, bpe, chat, decontamination, langid, licenses, neardup, quality, rnnlm, sstable
from chronolens.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, node string"
WORDS = "river stone cloud winter letter garden silver market candle window bridge forest meadow harbour thunder".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split()))
    rows = [
        (1, base), (2, base), (3, near), (4, prose(2, 80)), (5, None), (6, ""), (7, "   \n\t "), (8, "word"), (9, prose(3, 9_000)), (10, "Released under the MIT License.\nGNU - General  Public license; cc-by"),
        (11, prose(4, 50) + " " + prose(99, 30) + " " + prose(5, 50)), (12, "é ü ñ <|endoftext|> 中文 'll's\r\n x"), (None, "no id"), (None, None), (4, prose(2, 80)), (13, "1 2 3 !!"),
    ]
    return spark.createDataFrame([(i, t, "xx", None, None, "k", "l", "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(spark, docs, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).where("doc_id is not null").collect()}
    assert got[1].group_id == got[2].group_id == got[3].group_id == 1 and got[1].group_size == 3
    assert got[5].group_id == got[6].group_id == 5 and got[7].group_id == 7 and got[4].group_size == 2
    assert got[9].group_id == 9
    assert neardup.near_duplicates(docs).count() == docs.count()
    assert neardup.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in neardup.deduplicated(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 7, 8, 9, 10, 11, 12, 13] and kept.count(None) == 1


def test_bag_minhash_is_unbiased():
    rng, errors = np.random.default_rng(3), []
    for _ in range(40):
        x = np.unique(rng.integers(0, 2**63, 50, np.uint64))
        a = rng.integers(1, 12, len(x))
        b = np.maximum(1, a + rng.integers(-3, 4, len(x)))
        same = (neardup.bag_minhash(x, a, 256) == neardup.bag_minhash(x, b, 256)).mean()
        errors.append(same - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def linked_groups(texts, threshold=0.8):
    """Components of all pairs whose weighted Jaccard similarity reaches the threshold, by brute force: the smallest index of each."""
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (bags[i].total() + bags[j].total() - both) >= threshold:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return dict(enumerate(group))


@pytest.mark.parametrize("limits", [{"BLOCK": 8, "SMALL": 4}, {"WEIGHT": 600, "SMALL": 4}, {}])
def test_large_cluster_is_linked_by_blocks(spark, monkeypatch, limits):
    """Copies of copies, so that few are near the pivot: however blocks are cut, what brute force links is linked."""
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rng, texts = random.Random(12), []
    for g in range(2):
        words = prose(7 + g, 120).split()
        for i in range(40):
            words = list(words)
            for k in rng.sample(range(120), 2 if i % 10 else 9):
                words[k] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = linked_groups(texts)
    assert 3 < len(set(want.values())) < 40
    assert {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_of_thousands_and_of_long_texts(spark):
    base, long = prose(21, 60).split(), prose(22, 20_000).split()
    texts = [" ".join(f"edit{i}" if k == i % 60 else w for k, w in enumerate(base)) for i in range(3_000)]
    texts += [" ".join(f"edit{i}" if k % 997 == i else w for k, w in enumerate(long)) for i in range(6)] + [prose(23, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(df).groupBy("group_id").count().collect()
    assert {(r.group_id, r["count"]) for r in got} == {(0, 3_000), (3_000, 6), (3_006, 1)}


def test_deduplicated_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, prose(1, 30), 5, b"x", b"y"), (2, prose(1, 30), 6, b"x", b"y")], "doc_id long, text string, kept_id long, kept_node binary, node binary")
    assert neardup.deduplicated(df).collect() == df.where("doc_id = 1").collect()


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(4), []
    for g in range(12):
        base = prose(100 + g, 100).split()
        texts.append(" ".join(base))
        for n in (1, 2, 3, 5, 9):
            edited = list(base)
            for k in rng.sample(range(100), n):
                edited[k] = "zz" + str(rng.randrange(10**6))
            texts.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()} == linked_groups(texts)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(99, 30)), (2, prose(77, 40)), (3, None), (4, ""), (5, "word"), (6, prose(99, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(11, 1), (11, 6), (8, 5)} and got[11, 1].start == 50 and got[11, 1].similarity == 1.0
    clean = decontamination.decontaminate(docs, items)
    assert clean.count() == docs.count() - 2 and clean.columns == docs.columns
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_near_copies(spark):
    """Against brute force over all windows."""
    item = prose(50, 60).split()
    texts = {i: " ".join([*prose(200 + i, 30).split(), *item[i:], *prose(300 + i, 30).split()]) for i in range(0, 14, 2)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = {}
    for i, t in texts.items():
        w = t.split()
        best = 0
        for s in range(len(w) - 59):
            both = sum((grams(w[s : s + 60]) & grams(item)).values())
            best = max(best, both / (112 - both))
        if best >= 0.8:
            want[i] = best
    got = {r.doc_id: r.similarity for r in decontamination.contaminated(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == pytest.approx(want)


def test_forced_boundary_bpe(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for r in bpe.encoded(docs, path, ["doc_id", "text", "key"]).collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == whole.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encoded(empty, path, ["doc_id"]).count() == 0


def test_forced_boundaries_on_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine, rng = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path, cache=50), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", "'s", "'", "'re", "!", "?", "12", "<|endoftext|>", "<|", "|>", "😀", "中", "\x1c", "\x85", " ", "́", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    for lo in range(0, 3000, 100):
        for t, ids in zip(texts[lo : lo + 100], mine.encode([t.encode() for t in texts[lo : lo + 100]])):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_shards(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    manifest = sstable.write_shards(docs, path, 2, 49_408)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1, whole.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda x: x[0])
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id or -1, r.ids_crc32, r.n_tokens) for r in got) == sorted((i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for i, ids in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    found = sstable.lookup(manifest, spark.createDataFrame([(9,), (4,), (999,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {9: 1, 4: 2}
    assert next(r.ids for r in found if r.doc_id == 9) == dict(want)[9]
    assert sstable.read_shards(sstable.write_shards(empty, path, 2, 49_408)).count() == 0


def test_shard_lookup_by_bisection(tmp_path):
    import pyarrow.fs as pafs

    store = pafs.LocalFileSystem()
    keys = sorted(random.Random(1).sample(range(-(10**6), 10**6), 5000))
    with store.open_output_stream(str(tmp_path / "a.sst")) as out:
        w = sstable.ShardWriter(out, 4)
        for k in keys:
            w.add(sstable.key_of(k), np.full(abs(k) % 50 + 1, abs(k), "<u4").tobytes())
        w.close()
    shard = sstable.open_shard(f"file://{tmp_path}/a.sst")
    assert [sstable.id_of(k) for k, _ in shard] == keys and len(shard.blocks) > 3
    for k in keys[::37]:
        assert shard.get(sstable.key_of(k))[0].tolist() == [abs(k)] * (abs(k) % 50 + 1)
    absent = [k for k in range(-500, 500) if k not in set(keys)]
    assert not any(shard.get(sstable.key_of(k)) for k in absent)
    passed = sum(bool(shard.bloom[sstable.probes(sstable.key_of(k), len(shard.bloom))].all()) for k in absent)
    assert passed < 0.05 * len(absent)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, x[5].tolist(), "x") for i in range(20)] + [(5, x[5].tolist(), "x")]
    rows += [(2000, None, "x"), (2050, [0.0] * 16, "x"), (2100, [float("nan")] * 16, "x"), (2150, [None] * 16, "x"), (None, x[1].tolist(), "x"), (2200, [1.0], "x"), (2250, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    every = {**{i: v for i, v in enumerate(x)}, **{1000 + i: x[5] for i in range(20)}}
    ids, m = np.array(list(every)), np.stack(list(every.values()))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in [i for i in every if i % 50 == 0]:
        score = unit @ unit[list(every).index(q)]
        order = [i for i in np.lexsort((ids, -score.round(12))) if ids[i] != q][:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in mine} & set(ids[order].tolist()))
        total += 5
        if q == 1000:
            assert [v for _, v, _ in mine] == [5, 1001, 1002, 1003, 1004]
    assert hits / total >= 0.9 and {r.query_id for r in got} == {i for i in every if i % 50 == 0}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_license_scan(spark, docs, empty):
    got = {r.doc_id: r for r in licenses.license_scan(docs).where("doc_id is not null").collect()}
    assert got[10].base_labels == "cc-by,gpl,mit" and "mit-notice" in got[10].labels and got[10].n_base == 3
    assert (got[10].n_words, got[10].first_word, got[10].last_word, got[10].score) == (11, 3, 9, 1.0)
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, 0, None, "", 0.0)
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(empty).count() == 0
    twice = spark.createDataFrame([(1, "mit license mit license x MIT\nLICENSE")], "doc_id long, text string")
    r = licenses.license_scan(twice).first()
    assert (r.n_base, r.first_word, r.last_word) == (3, 0, 5)


def test_license_blocks_equal_brute_force(spark):
    rng, vocabulary = random.Random(8), [w for _, t in licenses.TEMPLATES for w in t.lower().replace(",", "").split()]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 25))) for _ in range(300)] + [" ".join(w for w in t.split() if rng.random() > 0.15) for _, t in licenses.TEMPLATES for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    import re

    words = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    want = {(i, label) for i, t in enumerate(lines) for label, x in licenses.TEMPLATES if len(words(t) & words(x)) >= 0.8 * len(words(x)) - 1e-9}
    assert {(r.doc_id, r.label) for r in licenses.license_blocks(df, spark).collect()} == want and len(want) > 20


def test_preference_pairs(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"), (1, 3, "user", None),
        (2, 0, "user", "alone"), (4, 0, None, None), (5, 0, None, None), (None, 0, "user", "x"), (7, None, "user", "a"), (7, None, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].shared == 2 and got[0].prompt.count("<|im_start|>") == 2 and "hello" in got[0].chosen and "go away" in got[0].rejected
    assert got[0].chosen_mask == "0x22,1x16" and got[0].rejected_mask.startswith("0x22,1x") and got[0].rejected_mask.endswith(",0x11")
    assert got[1].rejected_id is None and got[1].rejected == "" and got[1].shared == 0
    assert got[2].shared == 1 and got[2].chosen == "" and got[3].rejected_turns == 2
    assert chat.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_quality(spark, docs, empty):
    good = [(i, prose(i, 60) + "\n" + prose(i + 500, 40)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(60)] + [(2000 + i, "same " * 80) for i in range(60)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(train, labels, F.col("doc_id") % 3 != 0)
    got = quality.scored(train, model, ["doc_id"]).collect()
    held = [r for r in got if r.doc_id % 3 == 0]
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.97
    odd = quality.scored(docs, model, ["doc_id", "label"]).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.scored(empty, model, ["doc_id"]).count() == 0
    nothing = quality.fit(empty, labels.limit(0), F.lit(True))
    assert all(r.score == 0.5 for r in quality.scored(docs, nothing, ["doc_id"]).collect())


def test_language_id(spark, docs, empty):
    rng = random.Random(5)
    bits = {"aa": ["tion", "ing", "the", "er"], "bb": ["ung", "keit", "sch", "ein"], "cc": ["eau", "oux", "ê", "ment"]}
    word = lambda lang: "".join(rng.choices(bits[lang], k=rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(8, 60))), lang) for i, lang in enumerate(rng.choices(list(bits), k=240))]
    df = spark.createDataFrame([*rows, (9999, "thing", None), (9998, None, "aa")], "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in langid.identified(df, model, ["doc_id"]).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    odd = {r.doc_id: r for r in langid.identified(docs, model, ["doc_id", "lang"]).collect()}
    assert odd[5].lang_pred == odd[6].lang_pred == odd[13].lang_pred == "und" and odd[9].lang_pred != "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identified(empty, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, langid.fit(empty, F.lit(True)), ["doc_id"]).collect()} == {"und"}


def test_gru_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    net = langid.ByteBiGru(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, label = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    grad = net.gradients(data, label)[1]
    for name in ("out", "fzr", "bc", "fc"):
        at = tuple(0 for _ in net.w[name].shape)
        base = net.w[name].copy()
        losses = []
        for e in (1e-2, -1e-2):
            net.w[name] = base.copy()
            net.w[name][at] += e
            losses.append(net.gradients(data, label)[0])
        net.w[name] = base
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grad[name][at], rel=0.05, abs=1e-4)


def test_language_model(spark, docs, empty):
    learn, held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True)), F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = rnnlm.scores(docs, learn, held).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter()
    for r in docs.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (r.doc_id or -1, len(tokens(r.text)), sum(count[w] > 0 for w in tokens(r.text)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r.text)), 5)) for r in docs.collect()
    )
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert rnnlm.scores(empty, learn, held).count() == 0


def test_language_model_sums_to_one():
    model = rnnlm.GatedLm(np.arange(200.0))
    state = np.random.default_rng(1).normal(size=(1, model.h)).astype(np.float32)
    p = np.exp(model.log_probabilities(np.repeat(state, 200, 0), np.arange(200)))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    texts = [np.array([5, 7, 9, 64]), np.array([64]), np.array([1, 64])]
    alone = [model.score([t], 64)[0] for t in texts]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(alone, model.score(texts, 64)))


def test_spelling_masses(spark):
    """The stand-ins' masses sum to 1, as each word has one."""
    words = [f"{w}{i}".encode() for i, w in enumerate(WORDS * 4)]
    counts = spark.createDataFrame([(w, 1 + i % 5) for i, w in enumerate(words)], "word binary, c long")
    assert rnnlm.spelling(counts, set()).mass.sum() == pytest.approx(1, abs=0.02)


def test_language_model_learns_from_shards(spark, monkeypatch):
    """Several shards are averaged; the model beats the base on texts of the same kind, and more input gives more to learn from."""
    rows = [(i, " ".join(["red green blue yellow"] * (3 + i % 4))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, "red"), (7, None)], "doc_id long, text string")
    names = {w.encode(): i + rnnlm.UNKNOWN + 1 for i, w in enumerate(["red", "green", "blue", "yellow"])}
    start = rnnlm.GatedLm(np.ones(rnnlm.UNKNOWN + 5))
    before = start.packed()
    text = np.array([names[w] for w in (b"red", b"green", b"blue", b"yellow")] * 4 + [rnnlm.UNKNOWN])
    untaught = start.score([text], rnnlm.UNKNOWN)[0].sum()
    taught = rnnlm.trained(docs, start, names, share=1.0, shard=20)
    assert taught.packed() != before
    assert taught.score([text], rnnlm.UNKNOWN)[0].sum() > untaught + 10


def test_language_model_reads_whole_shards(monkeypatch):
    """However long a shard is, all its ids are taught, those behind the last full window and lane too."""
    taught = Counter()

    def gradients(self, ids, before, state):
        taught.update(ids.ravel().tolist())
        return {k: np.zeros_like(w) for k, w in self.w.items()}, state, 0.0

    monkeypatch.setattr(rnnlm.GatedLm, "gradients", gradients)
    for n in (5, 64 * 16 * 4, 64 * 16 * 40 + 64 + 37):
        taught.clear()
        rnnlm.GatedLm(np.ones(n)).train(np.arange(n), rnnlm.UNKNOWN, updates=3)
        assert set(taught) == set(range(n)) and sum(taught.values()) <= max(n + 64, 64 * 16 * 3)


def test_language_model_cuts_shards_by_tokens():
    """Few long documents are several shards."""
    assert rnnlm.shard_count(800, 800 * 400) == 1 and rnnlm.shard_count(8_000, 8_000 * 100) == 10
    assert rnnlm.shard_count(800, 800 * 4_000) == 10


def test_language_model_learns_from_all_documents(spark, monkeypatch):
    """Rows without an id, with an id of their own or not, and repeated ones are each dealt to a shard, at the default share."""
    held = []
    monkeypatch.setattr(rnnlm, "staged", lambda df, name: (held.append((name, df)), staged(df, name))[1])
    rows = [*((i, f"red green {i}") for i in range(3_000)), (None, "blue red"), (None, "blue"), (None, None), (7, "blue"), (7, "blue"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {w: i + rnnlm.UNKNOWN + 1 for i, w in enumerate((b"red", b"green", b"blue"))}
    rnnlm.trained(docs, rnnlm.GatedLm(np.ones(rnnlm.UNKNOWN + 4)), names)
    dealt = [r for name, df in held if name == "lm-shards" for r in df.collect()]
    assert len(dealt) == len(rows) and sum(r.n for r in dealt) == sum(len((t or "").split()) + 1 for _, t in rows)
    assert sum(np.frombuffer(r.ids, np.uint16).tolist().count(names[b"blue"]) for r in dealt) == 4


def test_language_model_cuts_texts_once(spark, docs, monkeypatch):
    """What the network learns from are the ids that are scored: texts are not encoded a second time, and each training row is dealt once."""
    held = {}
    monkeypatch.setattr(rnnlm, "staged", lambda df, name: held.setdefault(name, staged(df, name)))
    monkeypatch.setattr(rnnlm, "_encoder", lambda names: 1 / 0)
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = rnnlm.scores(docs, learn, ~learn).collect()
    ids = lambda rows: sorted((r.place, bytes(r.ids), r.n) for r in rows)
    rows = held["lm-rows"].collect()
    assert len(got) == len(rows) == docs.count() and sum(r.taught for r in rows) == docs.where(learn).count()
    assert sorted(x[1:] for x in ids(r for r in rows if r.taught)) == sorted(x[1:] for x in ids(held["lm-shards"].collect()))
    assert all(np.frombuffer(r.ids, np.uint16)[-1] == rnnlm.UNKNOWN and len(r.ids) == 2 * r.n for r in rows)


def test_sums_by_id():
    """Against additions one by one; ids that occur once, often and most often."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 33, 3_000):
        ids, rows = np.minimum(rng.zipf(1.4, n), 500), rng.normal(size=(n, 6))
        want = np.zeros((501, 6))
        np.add.at(want, ids, rows)
        found, total = rnnlm.sums_by_id(ids, rows)
        assert sorted(found) == sorted(set(ids)) and total == pytest.approx(want[found])


def test_decontamination_by_row(spark):
    """A contaminated text takes no clean text of the same or no doc_id with it."""
    item = prose(99, 30)
    bad = prose(1, 40) + " " + item
    rows = [(None, bad), (None, prose(2, 60)), (None, None), (7, bad), (7, prose(3, 60)), (8, prose(4, 60)), (8, prose(4, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = decontamination.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] != bad)
    assert clean.columns == df.columns


def test_language_id_learns_rare_languages(spark):
    rows = [(i, prose(i, 12), "aa") for i in range(1500)] + [(5000 + i, f"{chr(0x430 + i) * 9} {chr(0x430 + i) * 5}", f"r{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(True), limit=100).languages == ["aa", *(f"r{i}" for i in range(8))]


def test_language_model_gradients():
    """Truncated backpropagation against differences, with texts that begin and end inside the window."""
    rng = np.random.default_rng(2)
    model = rnnlm.GatedLm(np.arange(200.0))
    model.w = {k: v.astype(float) + (0 if k in ("bw", "bc") else rng.normal(0, 0.3, v.shape)) for k, v in model.w.items()}
    ids, state = rng.integers(0, 200, (7, 5)), rng.normal(size=(5, model.h))
    before = np.concatenate([np.full((1, 5), rnnlm.UNKNOWN), ids[:-1]])
    before[3, 2], before[0, 1] = rnnlm.UNKNOWN, 5
    grad = model.gradients(ids, before, state)[0]
    for name, w in model.w.items():
        at, losses = np.unravel_index(np.argmax(np.abs(grad[name])), w.shape), []
        base = w[at]
        for e in (1e-5, -1e-5):
            w[at] = base + e
            losses.append(model.gradients(ids, before, state)[2])
        w[at] = base
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[name][at], rel=1e-4)


def test_language_model_trains_as_it_scores():
    """The loss of a window over several texts is that of the texts scored one by one: states start anew behind an end."""
    model, end = rnnlm.GatedLm(np.arange(100.0)), rnnlm.UNKNOWN
    texts = [np.array([3, 70, 8, end]), np.array([end]), np.array([5, 90, end])]
    stream = np.concatenate(texts)
    loss = model.gradients(stream[:, None], np.concatenate([[end], stream[:-1]])[:, None], np.ones((1, model.h), np.float32))[2]
    assert -loss * len(stream) == pytest.approx(sum(s.sum() for s in model.score(texts, end)), rel=1e-4)


def test_spelling_is_a_distribution():
    """Over all bytes after any context the probabilities sum to 1, and a word's are those of its bytes, from its end, one by one."""
    words = [f"{w}{i}".encode() for i, w in enumerate(WORDS * 4)]
    data = rnnlm.backwards(words)
    byte = data[3:].astype(np.int64)
    counts = [np.bincount(c << 8 | byte, minlength=n * 256).reshape(n, 256).astype(float) for c, n in zip(rnnlm.contexts(data), rnnlm.CONTEXTS)]
    model = rnnlm.Spelling(counts, np.ones(rnnlm.UNKNOWN), 3)
    for context in (b"   ", b"  r", b" 7s", b"xyz"):
        every = np.frombuffer(b"".join(context + bytes([b]) for b in range(256)), np.uint8)
        assert model.probabilities(every)[::4].sum() == pytest.approx(1, abs=1e-3)
    one = lambda w: sum(math.log(model.probabilities(np.frombuffer((b"   " + w[::-1] + b" ")[i : i + 4], np.uint8))[0]) for i in range(len(w) + 1))
    assert model.log([b"stone7", b"x", b"rivers"]) == pytest.approx([one(b"stone7"), one(b"x"), one(b"rivers")], rel=1e-4)


def test_language_model_beats_the_base_on_held_out_documents(spark):
    from chronolens.llm import registry

    got = registry.QUERIES["op5_recurrent_lm"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 10 == 0)).all()
    for _, rows in got.groupby("held_out"):
        assert (rows.score.sum() - rows.base_score.sum()) / rows.n_tokens.sum() > 0.1


def best_windows(texts, items, threshold=0.8):
    """(doc, item): best similarity of a window of as many words as the item, by brute force over all windows."""
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = {}
    for d, t in texts.items():
        for i, item in items.items():
            w, x = t.split(), item.split()
            run = lambda s: w[s : s + len(x)]  # noqa: E731, B023
            for s in range(max(1, len(w) - len(x) + 1)):
                a, b = grams(run(s)), grams(x)
                both = (a & b).total()
                value = both / (a.total() + b.total() - both)
                if value >= threshold and value > out.get((d, i), 0):
                    out[d, i] = value
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_loses_no_window(spark, monkeypatch, broadcast):
    """Items moved about, cut, repeated, edited and mixed, against brute force; many items of one size share most of their words."""
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    rng = random.Random(31)
    base = prose(600, 60)
    items = {0: base, 1: prose(601, 60), 2: prose(602, 14), 3: "one two three", 4: prose(603, 9), 5: " ".join(["again"] * 30), 6: prose(604, 55)}
    for k in range(10, 40):  # boilerplate that all of these have in common
        items[k] = " ".join([*base.split()[:30], *prose(700 + k, 30).split()])
    texts, around = {}, lambda k: prose(900 + k, 40)
    halves = base.split()
    texts[0] = " ".join([around(0), *halves[30:], *halves[:30], around(1)])
    texts[1] = " ".join([*halves[30:], *halves[:30]])
    texts[2] = base
    texts[3] = " ".join(["again"] * 27)
    texts[4] = " ".join([around(2), *["again"] * 80, "one two three", around(3)])
    texts[5] = " ".join(halves[:50])
    for k in range(6, 70):
        item = items[rng.choice([0, 1, 2, 4, 6, 12, 13])].split()
        for _ in range(rng.randrange(4)):
            at, how = rng.randrange(len(item)), rng.randrange(5)
            if how == 0:
                item[at] = "zz"
            elif how == 1:
                item.insert(at, "zz")
            elif how == 2:
                del item[at]
            elif how == 3:
                item = item[at:] + item[:at]
            else:
                item = item[:at] + item[max(0, at - 6) :]
        texts[k] = " ".join([around(k), *item, around(k + 100)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = best_windows(texts, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs, table).collect()}
    assert got == pytest.approx(want) and (0, 0) in want and (1, 0) in want and (3, 5) in want and len(want) > 30


def test_decontamination_with_clashing_names_and_ties(spark):
    item = prose(99, 30)
    df = spark.createDataFrame([(1, f"{item} x {item}", 5, 6, 7), (2, prose(3, 40), 5, 6, 7)], "doc_id long, text string, bad_id long, bad_key long, item_id long")
    items = spark.createDataFrame([(1, item, 9)], "item_id long, text string, doc_id long")
    assert decontamination.decontaminate(df, items).collect() == df.where("doc_id = 2").collect()
    assert [(r.doc_id, r.item_id, r.start) for r in decontamination.contaminated(df, items).collect()] == [(1, 1, 0)]


def neighbours_found(spark, rows, **options):
    """Share of the true five nearest (by brute force, in double precision) that nearest() finds, and its rows."""
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0, **options).collect()
    hits = total = 0
    for q, v in rows:
        if q % 50 == 0:
            u = lambda x: x / np.linalg.norm(x)
            scores = sorted((-float(u(np.array(x)) @ u(np.array(v))), i) for i, x in rows if i != q and len(x) == len(v))[:5]
            hits += len({i for _, i in scores} & {r.vec_id for r in got if r.query_id == q})
            total += len(scores)
    return hits / total, got


def test_nearest_neighbours_recall_on_thousands(spark):
    """On vectors without structure and on clustered ones, of which a query probes a small share of the cells; with small blocks too."""
    rng = np.random.default_rng(8)
    plain = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4_000, 32)))]
    assert neighbours_found(spark, plain)[0] >= 0.9
    centres = rng.normal(size=(40, 32))
    clustered = [(i, (centres[i % 40] + rng.normal(0, 0.15, 32)).tolist()) for i in range(4_000)]
    model = ann.Index.fit(ann.unit(np.array([v for _, v in clustered])), 40_000)
    assert len(model.centres) == 50 and model.probes <= 8
    assert neighbours_found(spark, clustered)[0] >= 0.9


def test_nearest_neighbours_recall_on_uneven_vectors(spark):
    """In clusters that the codes cannot tell apart and for queries that lie elsewhere than the rows."""
    rng = np.random.default_rng(12)
    dense = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2, 32))[rng.integers(0, 2, 4_000)] + rng.normal(0, 0.01, (4_000, 32)))]
    assert neighbours_found(spark, dense)[0] >= 0.9
    centres = rng.normal(size=(10, 32))
    apart = [(i, (rng.normal(size=32) if i % 50 == 0 else centres[i % 10] + rng.normal(0, 0.1, 32)).tolist()) for i in range(4_000)]
    assert neighbours_found(spark, apart)[0] >= 0.9


def test_nearest_neighbours_of_odd_vectors(spark, monkeypatch):
    """Very small and very large components, several lengths, hot cells in many blocks."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 8))
    rows = [(i, (v * (1e-200 if i % 3 == 0 else 1e200 if i % 3 == 1 else 1)).tolist()) for i, v in enumerate(x)]
    rows += [(1_000 + i, rng.normal(size=5).tolist()) for i in range(60)] + [(2_000, [3.0])]
    share, got = neighbours_found(spark, [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows], shortlist=60)
    odd = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, shortlist=60).collect()
    assert share >= 0.9 and {r.query_id for r in got} == {i for i, v in rows if i % 50 == 0 and len(v) > 1}
    assert {(r.query_id, r.rank): round(r.score, 9) for r in odd} == {(r.query_id, r.rank): round(r.score, 9) for r in got}


def test_language_id_reads_whole_texts():
    """Against a plain forward pass, position by position, from both ends; long texts are windows with what warms them up."""
    net = langid.ByteBiGru(["a", "b", "c"], hidden=5, seed=2)
    rng = random.Random(6)
    texts = ["bonjour tout le monde".encode(), b"x", b"", prose(4, 2_000).encode(), bytes(rng.randrange(256) for _ in range(900)), prose(5, 12).encode()]

    def states(text, d):
        h, w, state, out = net.hidden, {k: v.astype(float) for k, v in net.w.items()}, np.zeros(net.hidden), []
        for byte in text if d == "f" else reversed(text):
            x = w[d + "x"][:, byte]
            z, r = 1 / (1 + np.exp(-(w[d + "zr"] @ state + x[: 2 * h]))).reshape(2, h)
            state = z * state + (1 - z) * np.tanh(w[d + "c"] @ (r * state) + x[2 * h :])
            out.append(state)
        return out if d == "f" else out[::-1]

    got = net.pool(texts)
    for text, p in zip(texts, got):
        if text:
            logits = np.array([net.w["out"] @ np.concatenate(x) + net.w["bias"][:, 0] for x in zip(states(text, "f"), states(text, "b"))])
            q = np.exp(logits - logits.max(1, keepdims=True))
            assert p == pytest.approx((q / q.sum(1, keepdims=True)).mean(0), abs=2e-4)
        else:
            assert not p.any()
    assert np.allclose(net.pool(texts[:1]), got[0])


def test_gru_gradients_behind_the_end_of_a_text():
    """What stands behind a text's end changes neither loss nor gradients."""
    rng = np.random.default_rng(1)
    net = langid.ByteBiGru(["a", "b"], hidden=3)
    data, label = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    real = np.arange(6)[:, None] < np.array([6, 2, 4, 1])
    one, other = net.gradients(data, label, real), net.gradients(np.where(real, data, 77), label, real)
    assert one[0] == pytest.approx(other[0]) and all(np.allclose(one[1][k], other[1][k]) for k in one[1])
    alone = [net.gradients(data[:n, i : i + 1], label[i : i + 1])[0] * n for i, n in enumerate((6, 2, 4, 1))]
    assert one[0] == pytest.approx(sum(alone) / 13, rel=1e-4)


def test_language_id_of_held_out_documents(spark):
    """The registered query on sf0.01: folds, columns and accuracy, that of short texts too."""
    from chronolens.llm import registry

    got = registry.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got.merge(docs, on="doc_id").query("held_out and text.notna() and lang.notna()")
    right = held.lang == held.lang_pred
    assert right.mean() > 0.97 and right[held.text.str.len() < 200].mean() > 0.85


def test_boilerplate_joins_nothing(spark):
    """Texts that share half of their words and nothing else: they share bands, but no rare shingle, so no block of them is compared."""
    shared = prose(60, 60)
    texts = [f"{shared} {prose(70_000 + i, 60)}" for i in range(2_000)]
    texts += [texts[i] + " more" for i in range(0, 2_000, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i if i < 2_000 else (i - 2_000) * 100 for i in range(len(texts))}

    bags = spark.createDataFrame([(str(i).encode(), neardup.pack(*neardup.shingles(t.encode()))) for i, t in enumerate(texts[:2_000])], "node binary, bag binary")
    one = bags.select("node", F.lit(b"all").alias("label"), F.col("node").alias("part"))
    assert neardup.narrowed(one, bags, 0.8).count() == 0


def test_rare_shingles_of_texts_at_the_threshold():
    """Any two multisets that reach the threshold share one of their rarest occurrences, whatever the counters say."""
    rng = np.random.default_rng(5)
    for k in range(300):
        x = np.unique(rng.integers(0, 2**63, 40, np.uint64))
        a, b = rng.integers(0, 4, len(x)), None
        b = np.maximum(0, a + rng.integers(-1, 2, len(x)) * (rng.random(len(x)) < 0.3))
        if not a.sum() or not b.sum() or np.minimum(a, b).sum() / np.maximum(a, b).sum() < 0.8:
            continue
        seen = rng.integers(2, 9, neardup.COUNTERS).astype(np.int32)
        left, right = (neardup.rarest(x[c > 0], c[c > 0], seen, 0.8) for c in (a, b))
        assert np.intersect1d(left, right).size


def test_language_of_few_texts_that_repeat(spark):
    rows = [(i, prose(i, 20), "fr") for i in range(600)] + [(10_000 + i, f"тихий лес {i} " * 5, "ru") for i in range(5)] * 4_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df, F.lit(True), limit=200)
    assert model.languages == ["fr", "ru"]


def test_sample_of_languages_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, prose(i, 2_000), "fr") for i in range(60)] + [(100 + i, prose(i, 20), "de") for i in range(60)] + [(200, "un", "es")]
    seen = {}
    monkeypatch.setattr(langid.ByteBiGru, "train", lambda self, texts, labels: seen.update(zip(self.languages, np.bincount(labels).tolist())) or self)
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), limit_bytes=60_000)
    assert seen["fr"] == 2 and seen["de"] == 60 and seen["es"] == 1
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).languages == ["de", "fr"]


def test_quality_equals_sums_of_table_entries(spark, docs):
    """The score is the logistic of the intercept, one table entry a feature and one a pair, found here by counting edges."""
    train = [(i, prose(i, 40 + i % 30)) for i in range(80)] + [(1_000 + i, "### " * (5 + i % 40)) for i in range(80)]
    frame = spark.createDataFrame([*train, *train[:20]], "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame([(i, int(i < 1_000)) for i, _ in train], "doc_id long, quality int"), F.lit(True))
    assert model.learned and model.pair_tables

    def plain(text):
        x = quality.features((text or "").encode())
        at = lambda edges, v: sum(e <= v for e in edges)
        total = model.intercept + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, x))
        total += sum(t[at(model.coarse[i], x[i]), at(model.coarse[j], x[j])] for (i, j), t in model.pair_tables.items())
        return 1 / (1 + math.exp(-total))

    rows = quality.scored(docs.union(docs.limit(0)), model, ["doc_id", "text"]).collect()
    assert [r.score for r in rows] == pytest.approx([plain(r.text) for r in rows]) and all(r.predicted == (r.score >= 0.3) for r in rows)


WRAPPED = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

Licensed under the Apache License,
Version 2.0
"""


def test_wrapped_notices(spark):
    """As published, with lines that end in the middle of a notice; and behind much other text."""
    texts = {1: WRAPPED, 2: WRAPPED.replace("\n", " "), 3: prose(1, 700) + "\n" + WRAPPED + prose(2, 300), 4: prose(3, 50) + "\nlicensed " + prose(4, 90) + "\nunder the " + prose(5, 90) + "\napache license version 2.0"}
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all({"mit", "bsd", "apache-2"} <= set(got[i].labels.split(",")) and got[i].score >= 0.9 for i in (1, 2, 3))
    assert "apache-2" not in got[4].labels.split(",") and "apache" in got[4].labels.split(",")


def test_runs_of_words_equal_brute_force(spark):
    """Every window of as many words as a template has is held against it, wherever lines end."""
    import re

    rng, notices = random.Random(4), [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) < 40]
    texts = []
    for i in range(60):
        label, notice = rng.choice(notices)
        words = [w for w in notice.split() if rng.random() > 0.12]
        at = rng.randrange(0, 120)
        words = prose(i, at).split() + words + prose(900 + i, 60).split()
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words) + "\n")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    got = {(r.doc_id, r.label) for r in licenses.license_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark).collect()}
    for i, t in enumerate(texts):
        w = find(t)
        for label, notice in licenses.TEMPLATES:
            own = find(notice)
            least = math.ceil(0.8 * len(set(own)) - 1e-9)
            if any(len(set(w[k : k + len(own)]) & set(own)) >= least for k in range(max(1, len(w) - len(own) + 1))):
                assert (i, label) in got, (i, label)
    assert len(got) > 40


def test_other_answers(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"), (1, 0, "user", "s"), (1, 1, "assistant", "c"),
        (2, 0, "user", "alone"), (3, 0, "assistant", "d"), (4, None, None, None), (5, 1, "assistant", None), (None, 0, "assistant", "x"), (6, 0, "assistant", "e"), (6, 0, "assistant", "e"), (7, 0, "assistant", "e"),
    ]
    df = spark.createDataFrame([(*r, "k", "p") for r in rows], "conv_id long, turn long, role string, text string, pair string, answer string")
    made = chat.with_other_answers(df, F.col("conv_id").bitwiseXOR(1))
    got = {r.pair_id: r for r in chat.preference_pairs(made, F.col("pair"), F.col("is_chosen")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 7}
    assert got[0].shared == 3 and got[0].prompt.count("<|im_start|>") == 3 and "b" in got[0].chosen and "bye" in got[0].chosen and got[0].rejected == "<|im_start|>assistant\nc<|im_end|>\n" and got[0].rejected_id == 1
    assert got[1].shared == 1 and got[1].rejected == "<|im_start|>assistant\nb<|im_end|>\n"
    assert [got[i].rejected_id for i in (2, 3, 4, 5)] == [None] * 4 and got[2].prompt == "" and got[3].rejected_turns == 0
    assert got[6].shared == 1 and got[7].chosen == "" and chat.with_other_answers(df.limit(0), F.col("conv_id")).count() == 0


def test_language_model_scores_by_a_plain_forward_pass():
    """Step by step in double precision, with the softmaxes written out, against score()'s batches of texts read in step."""
    rng = np.random.default_rng(2)
    model = rnnlm.GatedLm(np.arange(1.0, 200.0))
    for k in model.w:
        model.w[k] = (model.w[k] + rng.normal(0, 0.1, model.w[k].shape) * (model.w[k] > -60)).astype(np.float32)
    w, h = {k: v.astype(float) for k, v in model.w.items()}, model.h
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(ids):
        state, before, out = np.zeros(h), 64, []
        for i in ids:
            x = w["x"][before]
            gates = sigmoid(x[: 2 * h] + state @ w["zr"])
            z, r = gates[:h], gates[h:]
            cand = np.tanh(x[2 * h :] + (r * state) @ w["c"])
            state = (1 - z) * cand + z * state
            kind, place = divmod(int(i), rnnlm.CLASS)
            a, b = state @ w["oc"] + w["bc"], state @ w["ow"][kind] + w["bw"][kind]
            out.append(a[kind] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum()))
            before = i
        return out

    texts = [np.append(rng.integers(0, 199, n), 64) for n in (0, 1, 7, 40, 40, 300)]
    for ids, got in zip(texts, model.score(texts, 64)):
        assert got == pytest.approx(plain(ids), abs=2e-4)


def test_codebooks_by_conjugate_gradients():
    """Against the dense normal equations; and at 768 components, where these would take gigabytes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n, m, width, eta = 400, 9, 2, 3.0
    codes, parts, way, inner = rng.integers(0, 16, (n, m)), rng.normal(size=(n, m, width)), rng.normal(size=(n, m, width)), rng.normal(size=n)
    z, sums = np.zeros((n, m, 16, width)), np.zeros((m, 16, width))
    for i in range(n):
        for k in range(m):
            z[i, k, codes[i, k]] = way[i, k]
            sums[k, codes[i, k]] += parts[i, k]
    z, used = z.reshape(n, -1), np.stack([np.bincount(codes[:, k], minlength=16) for k in range(m)])
    normal = (eta - 1) * z.T @ z + np.diag(np.repeat(used.ravel(), width) + 1e-6)
    want = np.linalg.solve(normal, sums.ravel() + (eta - 1) * inner @ z).reshape(m, 16, width)
    assert ann.least_squares(codes, parts, way, inner, eta, np.zeros((m, 16, width))) == pytest.approx(want, abs=1e-6)

    x = ann.unit(rng.normal(size=(1_000, 768)))
    tracemalloc.start()
    q = ann.AnisotropicQuantiser.fit(x, x, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * x.nbytes and q.books.shape == (384, 16, 2)


def test_vectors_of_many_lengths(spark):
    """Lengths beyond those that have an index are scanned whole, and every length keeps to itself."""
    rng = np.random.default_rng(8)
    rows = [(100 * n + i, rng.normal(size=n).tolist()) for n in range(2, 14) for i in range(12)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect()
    for n in range(2, 14):
        own = {i: ann.unit(np.array([v]))[0] for i, v in rows if i // 100 == n}
        q = 100 * n
        order = sorted((i for i in own if i != q), key=lambda i: (-round(float(own[i] @ own[q]), 12), i))[:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order


def test_equal_language_probabilities():
    """Ties go to the first language by name."""
    model = langid.ByteBiGru(["aa", "bb", "cc"])
    model.w = {k: np.zeros_like(v) for k, v in model.w.items()}
    assert model.pool([b"some text"]).argmax(1).tolist() == [0] and model.pool([b"some text"])[0] == pytest.approx([1 / 3] * 3)


def test_languages_read_hundreds_of_windows_in_step(monkeypatch):
    """Five hundred windows of a text are one group of steps, so that a step's fixed cost is shared by all of them."""
    model, read = langid.ByteBiGru(["a", "b"]), []
    whole = model._in_step
    monkeypatch.setattr(model, "_in_step", lambda texts, *at: read.append(len(texts)) or whole(texts, *at))
    model.pool([b"some words " * (500 * langid.WINDOW // 11)])
    assert max(read) >= 500
