import numpy as np

from tidegrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>, id string, v int"


def brute(rows, k, every):
    data = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v in data])
    ids = np.array([i for i, _ in data])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        s = m[ids == q][0] @ m.T
        order = np.lexsort([ids, -s])
        out[q] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != q][:k]
    return out


def test_hilbert_visits_neighbours():
    side = 8
    pts = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = ann.hilbert(pts, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32) * rng.uniform(0.5, 2, (600, 1)).astype(np.float32)
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    hot = x[10].tolist()
    out += [(1000 + i, hot) for i in range(300)]  # one vector many times, some of them queries
    return out + [(2000, None), (2005, [0.0] * 16), (2010, [None] + [1.0] * 15), (2015, [float("nan")] * 16), (2020, [1.0]), (None, x[3].tolist()), (2025, [float("inf")] * 16)]


def test_exact_when_everything_is_in_reach(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in data], SCHEMA)
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 5 == 0, k=7, curves=2, reach=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(data, 7, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_and_few_rows(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, "", 1) for i, v in data], SCHEMA)
    want = {q: {i for i, _ in v} for q, v in brute(data, 20, 20).items()}
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0, curves=12, reach=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & want[q]) / len(want[q]) for q in want]) >= 0.9
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), ann.F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), ann.F.lit(True)).count() == 0 and ann.nearest(df, ann.F.lit(False)).count() == 0


def test_reach_grows_with_the_table(spark, monkeypatch):
    assert ann.reach_for(500) == ann.reach_for(51_282) == 800 and ann.reach_for(200_000) == 3_121
    monkeypatch.setattr(ann, "REACH", 10)
    monkeypatch.setattr(ann, "REACH_POINTS", 100)
    data = rows()
    df = spark.createDataFrame([(i, v, "", 1) for i, v in data], SCHEMA)
    want = {q: {i for i, _ in v} for q, v in brute(data, 20, 20).items()}
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0, curves=12).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & want[q]) / len(want[q]) for q in want]) >= 0.9


def recall(spark, x, ids=None, **options):
    """Share of the 20 nearest of every 20th row that are found."""
    data = [(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    df = spark.createDataFrame([(i, v, "", 1) for i, v in data], SCHEMA)
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    m = x.astype(float)
    found = []
    for q in range(0, len(x), 20):
        s = m @ m[q]
        s[q] = -np.inf
        found.append(len(got[q] & set(np.lexsort([np.arange(len(x)), -s])[:20].tolist())) / 20)
    return np.mean(found)


def clusters(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + 0.35 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_where_a_quarter_of_the_table_is_compared(spark, monkeypatch):
    """24 curves times three blocks of 20 places are 1,440 of 6,000 points, at most."""
    x = clusters(6000, 32, 150, 5)
    assert recall(spark, x, reach=20) >= 0.9
    # The same in small blocks, whose queries come in parts.
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    assert recall(spark, x, reach=20) >= 0.9


def test_long_vectors_do_not_press_the_rest_together(spark):
    x = clusters(4000, 32, 100, 6)
    x[17] *= 1000
    x[[5, 400, 401]] *= 30
    x[2000:2010] *= 1e-9
    assert recall(spark, x, reach=14) >= 0.9


def test_lengths_of_any_size(spark):
    df = spark.createDataFrame([([3e200, 4e200],), ([3e-200, 4e-200],), ([3.0, -4.0],)], "v array<double>")
    assert np.allclose([r[0] for r in df.select(ann._length(ann.F.col("v"))).collect()], [5e200, 5e-200, 5.0], rtol=1e-12)
