import collections
import itertools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as cp
from test_decontamination import brute
from tidegrid.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def first_of_each_group(texts, width=5, similarity=0.8):
    """The smallest id of each group that links of shingle similarity make, all pairs compared."""
    sets = {}
    for d, t in texts.items():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[d] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= similarity * len(x | y):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return sorted(d for d in root if root[d] == d)


def test_each_stage_against_brute_force(spark, steps):
    raw, tame, one, clean, mixed, final = steps
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    low = {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).where("score < 0.3").collect()}
    assert sorted(r.doc_id for r in tame) == sorted(low)
    assert sorted(r.doc_id for r in one) == first_of_each_group({r.doc_id: r.text for r in tame})
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pairs = lambda t: list(zip(w := t.lower().split(), w[1:]))
    grams = {p for t in items for p in pairs(t)}
    # Only documents that share word pairs with an item can overlap one; the slow test is for these.
    slow = lambda r: sum(p in grams for p in pairs(r.text)) >= 5 and len(r.text.split()) < 1500
    for r in one:
        if slow(r):
            assert (r.doc_id in {x.doc_id for x in clean}) != any(brute(r.text, t) for t in items)
    words = lambda rows: collections.Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    had, got = words(clean), words(mixed)
    assert all(got[s] <= 2 * had[s] for s in had) and abs(sum(got.values()) - 1.5 * sum(had.values())) <= len(had)
    assert sorted((r.doc_id, r.text) for r in mixed) == sorted((r.doc_id, r.text) for r in final)
    assert all(r.shard for r in final) and [len(x[0]) for x in (raw, tame, one, clean, mixed)] == [5] * 5


def test_run(spark, steps):
    assert sorted((r.doc_id, r.text) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.text) for r in steps[-1])


def test_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    """Rows without id, text, source; a row twice; one very long; columns that stages make themselves."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (None, "a text of no id, long enough to have some shingles", "en", "web", 3), (9001, "", "en", None, 0), (9002, "word%d " * 3 % (1, 2, 3), "en", "web", 1), (9002, "word%d " * 3 % (1, 2, 3), "en", "web", 1), (9003, " ".join(f"w{k}" for k in range(60_000)), "en", "web", 9)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    both.selectExpr("*", "1 AS shard", "'x' AS part", "2 AS _id", "doc_id AS group_fp").write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path))
    rows = out.collect()
    assert {"part", "_id", "group_fp", "shard"} <= set(out.columns) and all(r.shard for r in rows)
    # One of the two equal rows is left; the mix may take it again, and nothing else of its id.
    assert {r.text for r in rows if r.doc_id == 9002} <= {"word1 word2 word3 ", "word1 word2", "word1"}
    assert all(len(r.text.split()) <= 60_000 for r in rows if r.text)
