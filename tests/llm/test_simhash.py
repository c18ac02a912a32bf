import random

import pytest
import xxhash

from tidegrid.llm import simhash


def brute_fp(text, n=3):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and (a ^ b).bit_count() <= 2:
                up[find(b)] = find(a)
    return {f: find(f) for f in up}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(60)] + ["Été", "ÄÖ", "A" * 40]
    out = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 30, 200])))) for i in range(120)]
    out += [(200 + i, out[i][1] + " x%d" % i) for i in range(40)] + [(300, None), (301, ""), (302, " \t"), (None, out[3][1]), (5, out[5][1]), (5, out[5][1])]
    return out + [(400, "The\x0bCat\x1fsat on it " * 5), (401, "z " * 70000)]


def test_fingerprints_and_components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp2", simhash.F.lit(1))
    got = {}
    n = 0
    for r in simhash.near_duplicates(df, ["doc_id", "text"]).collect():
        assert r.fp & (2**64 - 1) == brute_fp(r.text), r.text
        got[r.text] = r.component_id
        n += 1
    assert n == len(rows)
    fps = {t: brute_fp(t) for _, t in rows}
    roots = brute_components(set(fps.values()))
    for t, f in fps.items():
        assert got[t] == min(i for i, x in rows if i is not None and roots[fps[x]] == roots[f])


@pytest.mark.parametrize("pair_group", [0, 4, 64])
def test_links_equal_brute_force(spark, pair_group):
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(60):
            fps.add(s ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4]))))
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, pair_group)
    m = 2**64 - 1
    assert all(0 < ((r.a ^ r.b) & m).bit_count() <= 2 for r in edges.collect())
    got = {r.node & m: r.root & m for r in simhash.connected_components(edges).collect()}
    want = brute_components(fps)
    groups = lambda d: sorted(sorted(k for k in fps if d.get(k, k) == v) for v in {d.get(k, k) for k in fps})
    assert groups(got) == groups(want)


def test_keep_one_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df).collect()
    fps = {t: brute_fp(t) for _, t in rows}
    roots = brute_components(set(fps.values()))
    assert len(kept) == len({roots[f] for f in fps.values()}) and kept[0].asDict().keys() == {"doc_id", "text"}
    assert simhash.near_duplicates(df.limit(0), ["doc_id"]).count() == 0


def test_no_join_goes_through_the_driver(spark, rows, monkeypatch):
    """64 variants of each fingerprint come from few bytes of scratch files, so Spark would broadcast them."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(simhash, "written", lambda df, name, f=simhash.written: (plan(df), f(df, name))[1])
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    plan(out)
    assert sum("SortMergeJoin" in p for p in plans) == 3 and not any("Broadcast" in p for p in plans)


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_copies_go(spark):
    rnd = random.Random(3)
    text = {}
    for k in range(150):
        words = ["w%d" % rnd.randrange(5000) for _ in range(200)]
        text[2 * k] = " ".join(words)
        # Words changed far apart cost five shingles each: three leave about 0.86, eight about 0.66.
        for at in range(10, 200, 70 if k % 3 else 25):
            words[at] = "x%d" % rnd.randrange(5000)
        text[2 * k + 1] = " ".join(words)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(sorted(text.items()), "doc_id long, text string"), shingle=5, similarity=0.8).collect()}
    near = [k for k in range(150) if jaccard(text[2 * k], text[2 * k + 1]) >= 0.8]
    assert len(near) == 100 and {2 * k for k in range(150)} <= got
    assert {2 * k + 1 for k in range(150) if k not in near} <= got
    assert sum(2 * k + 1 not in got for k in near) >= 0.98 * len(near)


def test_long_fingerprints_are_simhash():
    """Candidates of the stage come from majorities of hash bits, not from minima."""
    import numpy as np

    texts = ["a b c d e f g h i", "the " * 9 + "end", None, " ".join("w%d" % k for k in range(1500))]
    _, n, words = simhash._long_fingerprints(simhash.pa.array(texts), 5)
    salt = simhash.textbytes.mix64(np.arange(1, simhash.LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for t, size, row in zip(texts, n, words, strict=True):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in shingle_set(t)], np.uint64)
        assert size == len(h)
        for k in range(simhash.LONG):
            mixed = [int(x) for x in simhash.textbytes.mix64(h ^ salt[k])]
            assert int(row[k]) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))


def test_similar_large_group_and_odd_rows(spark):
    rnd = random.Random(4)
    base = ["w%d" % rnd.randrange(5000) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):  # each close to the first, but not to each other
        words = list(base)
        for at in rnd.sample(range(10, 190, 12), 3):
            words[at] = "x%d" % rnd.randrange(10**9)
        rows.append((i, " ".join(words)))
    odd = [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE "), (None, "one"), (1004, "one two"), (1004, "one two")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(df, shingle=5, similarity=0.8).collect())
    assert kept == [0, 1000, 1002, 1004]
    assert simhash.keep_one(df.limit(0), shingle=5, similarity=0.8).count() == 0


def test_links_of_near_copies_in_proportion(spark, monkeypatch):
    """Copies that are all alike are one group by a few links each, not by all pairs."""
    rnd = random.Random(6)
    base = ["w%d" % rnd.randrange(5000) for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(200)] = "x%d" % i
        rows.append((i, " ".join(words)))
    made = {"candidates": 0, "similar": 0}

    def counted(df, name, f=simhash.written):
        out = f(df, name)
        if name in made:
            made[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()
    assert [r.doc_id for r in kept] == [0]
    # 79,800 pairs, all of them links.
    assert 399 <= made["similar"] <= made["candidates"] <= 40 * len(rows)


@pytest.mark.parametrize("pair_group", [2, 64])
def test_similar_chains_equal_brute_force(spark, pair_group):
    """Families whose members are alike only along chains, several of them sharing most of their words."""
    rnd = random.Random(7)
    stem = ["w%d" % rnd.randrange(5000) for _ in range(300)]
    rows = []
    for family in range(6):
        words = [*stem[:200], *("f%d" % rnd.randrange(5000) for _ in range(100))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            for at in rnd.sample(range(5, 290, 12), 3):
                words[at] = "x%d" % rnd.randrange(10**9)
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    want = sorted(set(root))
    assert 6 <= len(want) < len(rows)
    keyed = simhash.with_row_key(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {}
    for r in simhash.similar(keyed, shingle=5, similarity=0.8, pair_group=pair_group).collect():
        groups.setdefault(r.group_fp, []).append(r.doc_id)
    assert sorted(min(g) for g in groups.values()) == want
