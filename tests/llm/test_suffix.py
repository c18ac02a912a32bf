import random
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import common, rounds, suffix, textbytes


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11])
def test_difference_cover(q):
    v, places = suffix.difference_cover(q)
    assert len(places) == q + 1
    chosen = set(places.tolist())
    assert all(any((i + d) % v in chosen and (j + d) % v in chosen for d in range(v)) for i in range(v) for j in range(v))


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def fixture():
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefghij é\n") for _ in range(n))
    passages = [text(rnd.choice([150, 199, 200, 201, 260, 700])) for _ in range(9)]
    rows = []
    for i in range(120):
        t = text(rnd.choice([0, 10, 250, 900]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + rnd.choice(passages) + t[at:]
        rows.append((i, t))
    rows += [(1000 + i, rows[i % 9][1]) for i in range(30)] + [(None, None), (5, rows[5][1]), (7, ""), (8, "z" * 500), (9, text(300) * 2), (None, "k" * 150), (11, "k" * 150)]
    long = text(60_000)
    return rows + [(12, long), (13, long[:30_000] + "!" + long[30_001:])]


@pytest.mark.parametrize("length", [200, 9, 2])
def test_equals_brute_force(spark, length):
    rows = fixture() if length == 200 else [(i, (t or "")[:120]) for i, t in fixture()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, level string").repartition(4)
    got = suffix.remove_repeats(df, ["doc_id", "text", "level"], length).collect()
    want = brute([t for _, t in rows], length)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.text, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got], key=key) == sorted([(*a, *b) for a, b in zip(rows, want)], key=key)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def colliding(rng, length=190, letters=b"abcdefghijklmnopqrstuvwxyz ,."):
    """Two texts of one sum over byte values times powers modulo 2**64, found by merging lists of parts of them (Wagner, 2002)."""
    letters = np.frombuffer(letters, np.uint8)
    up = textbytes._powers(length)[0]
    base = np.full(length, letters[0], np.uint8)
    cuts = np.linspace(0, length, 9).astype(int)
    lists = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        x = rng.choice(letters, (1 << 18, b - a))
        lists.append((((textbytes._BYTE[x] - textbytes._BYTE[base[a:b]]) * up[a:b]).sum(axis=1, dtype=np.uint64), x))
    for bits in (16, 32, 64):
        merged = []
        for (s, x), (t, y) in zip(lists[::2], lists[1::2]):
            mask = np.uint64((1 << bits) - 1)
            need = (np.uint64(0) - t) & mask
            order = np.argsort(need, kind="stable")
            lo, hi = np.searchsorted(need[order], s & mask, "left"), np.searchsorted(need[order], s & mask, "right")
            i = np.repeat(np.arange(len(s)), hi - lo)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            i, j = i[: 1 << 20], j[: 1 << 20]
            merged.append((s[i] + t[j], np.concatenate([x[i], y[j]], axis=1)))
        lists = merged
    return base.tobytes().decode(), lists[0][1][0].tobytes().decode()


def test_texts_of_one_sum_are_not_taken_for_equal(spark):
    """Other bytes of one polynomial fingerprint pass every filter that rests on it, and must still stay."""
    x, y = colliding(np.random.default_rng(1))
    assert x != y
    x, y = "0123456789" + x, "0123456789" + y
    a, b = (textbytes.Prefix(np.frombuffer(t.encode(), np.uint8)) for t in (x, y))
    assert a.fixed(np.array([0]), 200) == b.fixed(np.array([0]), 200)
    rows = [(0, "q" + x + "A"), (1, "rr" + y + "B"), (2, x[:199]), (3, y[:199])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert [r.n_removed for r in sorted(got)] == [w[1] for w in brute([t for _, t in rows], 200)] == [0, 0, 0, 0]


def test_checks_part_equal_keys():
    """Keys that agree in one fingerprint only are kept apart by parts and by buckets."""
    keys, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    asked = rounds.Asked(keys, 64, check)
    assert asked.keys.tolist() == [5, 5, 9] and asked.check.tolist() == [1, 2, 1] and asked.which.tolist() == [0, 1, 0, 2] and asked.count.tolist() == [2, 1, 1]
    other = rounds.Asked(np.array([5, 9], np.uint64), 64, np.array([2, 3], np.uint64))
    table = common.packets(asked.requests(0, 11, 1, np.zeros(3, np.uint8)) + other.requests(1, 11, 1, np.zeros(2, np.uint8)))
    back = rounds.answer_bits(rounds.repeated, "u1", True)(table)
    assert asked.answers(back.slice(0, 1), 11).tolist() == [False, True, False, False] and other.answers(back.slice(1, 1), 11).tolist() == [True, False]
