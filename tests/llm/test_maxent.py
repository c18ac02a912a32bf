import collections
import math
import random
import zlib

import numpy as np
import pytest

from tidegrid.llm import maxent


def tokens(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()] + [None]


def brute(rows, learn):
    count = collections.Counter(t for r in rows if learn(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    return n, [(len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t))) for _, t in rows]


def fixture():
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        # Two languages, each with an order of its own.
        lang = ["the", "cat", "sat", "on", "a", "mat."] if i % 2 else ["der", "Hund", "lief", "um", "ein", "Haus."]
        rows.append((i, " ".join(lang[(k + (rnd.random() < 0.1)) % 6] + ("" if rnd.random() < 0.9 else str(rnd.randrange(500))) for k in range(rnd.randrange(80)))))
    return rows + [(None, "the Cat"), (7, None), (8, ""), (9, " \t"), (9, "x\x1fy É " * 3), (9, "x\x1fy É " * 3), (10, "the cat " * 30_000)]


def learn(i):
    return not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)


def test_counts_equal_brute_force_and_model_beats_them(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, part string, n int").repartition(3)
    out, model = maxent.score_documents(df, ~maxent.held_out(), ["doc_id", "text"])
    n, want = brute(rows, learn)
    assert model.n == n
    got = out.withColumn("h", maxent.held_out()).collect()
    key = lambda r: tuple(map(str, r))
    for a, b in zip(sorted(((r.doc_id, r.text, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted([(*x, *y) for x, y in zip(rows, want)], key=key)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) <= 1e-9 * max(1, abs(b[4]))
    held = [r for r in got if r.h]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def random_model(seed, n_words=40, rows=64, width=4):
    """A model of small tables with arbitrary weights, and its words with their counts."""
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 2**63, n_words).astype(np.uint64))
    counts = rng.integers(1, 50, len(keys))
    classes = maxent.Classes(keys[np.argsort(-counts, kind="stable")][: width * width // 2], width)
    place = classes.of(keys)
    model = maxent.Model(rng.standard_normal((2 * rows, width)).astype(np.float32), classes, np.bincount(place, counts, classes.n).astype(int), np.bincount(place, minlength=classes.n))
    return model, keys, counts


def brute_probability(model, context, key, count):
    """By the definition: both softmaxes in full, term by term."""
    width, rows = model.classes.width, len(model.weights) // 2
    place = int(model.classes.of(np.array([key], np.uint64))[0])
    text = np.array([*context, key], np.uint64)
    doc = np.zeros(len(text), int)
    p = 1.0
    for half, target, k in ((0, place // width, 0), (1, place % width, 1)):
        r = maxent._features(text, doc, rows, model.classes.of(text) // width, width)[k][:, -1]
        z = [sum(float(model.weights[half * rows + int(i), c]) for i in r) for c in range(width)]
        p *= math.exp(z[target]) / sum(map(math.exp, z))
    return p if place < model.classes.own else p * (count + 1) / (model.tokens[place] + model.kinds[place] + 1)


def test_scores_equal_brute_force_and_share_all_probability():
    model, keys, counts = random_model(0)
    count = dict(zip(keys.tolist(), counts.tolist()))
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.choice(keys, 60), np.array([12345, 999], np.uint64), rng.choice(keys, 5)])
    doc = np.repeat([0, 1, 2], [20, 1, 46])
    got = model.log10(text, doc, np.array([count.get(k, 0) for k in text.tolist()]))
    for i, k in enumerate(text.tolist()):
        assert got[i] == pytest.approx(math.log10(brute_probability(model, text[np.flatnonzero(doc == doc[i])[0] : i].tolist(), k, count.get(k, 0))), rel=1e-4)
    # After any context all known words, and each shared cell's last share, add up to one.
    context = text[:3].tolist()
    known = sum(brute_probability(model, context, k, c) for k, c in count.items())
    width, rows = model.classes.width, len(model.weights) // 2
    spare = 0.0
    for place in range(model.classes.own, model.classes.n):
        z = maxent.np.zeros(width)
        some = next((k for k in rng.integers(0, 2**63, 4000).tolist() if int(model.classes.of(np.array([k], np.uint64))[0]) == place and k not in count))
        spare += brute_probability(model, context, some, 0)
    assert known + spare == pytest.approx(1, rel=1e-4)


def test_gradient_steps_equal_plain_sums():
    rng = np.random.default_rng(2)
    rows, target = rng.integers(0, 30, (5, 300)).astype(np.uint16), rng.integers(0, 4, 300)
    rows[0] = 0
    w = rng.standard_normal((32, 4)).astype(np.float32)
    got, squares = w.copy(), np.full(32, 1e-3, np.float32)
    maxent._train_slice(got, squares, rows, target, 0.4)
    z = w[rows].sum(axis=0)
    g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    g[np.arange(300), target] -= 1
    g /= 300
    want, sq = w.astype(float), np.full(32, 1e-3)
    for own in rows:
        for r in np.unique(own):
            grad = g[own == r].sum(axis=0)
            sq[r] += (grad**2).mean()
            want[r] -= 0.4 * grad / np.sqrt(sq[r])
    assert np.allclose(got, want, atol=1e-4)


def test_words_of_one_class_depend_on_context(spark):
    """Which of two words of one class comes next is told by the word before it alone."""
    rnd = random.Random(3)
    rows = [(i, " ".join(w for _ in range(30) for w in rnd.choice((("red", "fox"), ("tall", "oak"))))) for i in range(1500)]
    out, model = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ~maxent.held_out(), ["doc_id", "text"])
    held = [r for r in out.withColumn("h", maxent.held_out()).collect() if r.h]
    # Every other word is certain, the rest are one of two: 0.15 a token, where counts alone give 0.6.
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.25
    assert sum(r.base_score for r in held) / sum(r.n_tokens for r in held) < -0.55


def test_sizes_grow_with_the_tokens():
    sizes = [maxent.sizes_for(1 << k) for k in (0, 20, 26, 30, 34, 44)]
    assert sizes == sorted(sizes) and sizes[0] == (4096, 32) and sizes[-1] == (65536, 64)
    assert all(rows * width * 8 <= 32 << 20 and rows % maxent.BLOCK_ROWS == 0 for rows, width in sizes)


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out, model = maxent.score_documents(df, maxent.F.lit(False), ["doc_id"])
    assert model.n == 0 and {r.n_known for r in out.collect()} == {0} and {r.base_score for r in out.collect()} == {0.0}
    out, _ = maxent.score_documents(df.limit(0), ~maxent.held_out(), ["doc_id"])
    assert out.count() == 0
