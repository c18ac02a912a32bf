import random

import duckdb
import pyarrow as pa

from tidegrid.llm import mixing


def waterfill(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


def fixture():
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(60))), "hot" if i % 3 else rnd.choice(["a", "b", "é", "Z", None])) for i in range(400)]
    return rows + [(7, "x y", "hot"), (7, "x y", "hot"), (None, "a\x1fb c", "a"), (None, None, None), (900, "", "empty"), (901, "q " * 30000, "big")]


def test_mix(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    got = mixing.mix(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = waterfill(sizes, [3, 1, 2], 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": pa.array([r[2] for r in rows])}))
    sql = con.sql(mixing.OP1_SQL).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.size, r.source_size, r.taken) for r in got], key=key) == sorted([(r[0], r[1], r[2], r[4]) for r in sql], key=key)


def test_mixed_documents(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(mixing.F.sum(mixing.n_words(mixing.F.col("text"))).alias("n")).collect()}
    want = {r.source: round(r.target) for r in mixing.mix(df, ["doc_id"]).collect() if round(r.target)}
    assert words == want
    assert mixing.mix(df.limit(0), ["doc_id"]).count() == 0
