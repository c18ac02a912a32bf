import pytest
from py4j.protocol import Py4JJavaError

from tidegrid.llm.sharding import Shard, ShardStore, plan, shard, tier


def test_plan_merges_similar_sizes_up_to_target():
    mb = 1 << 20
    shards = [Shard(f"s{i}", 1, 2 * mb, 0) for i in range(70)] + [Shard("big", 1, 120 * mb, 3), Shard("mid", 1, 40 * mb, 1)]
    groups = plan(shards)
    names = [s.name for g in groups for s in g]
    assert len(names) == len(set(names)) and "big" not in names
    assert all(len(g) > 1 and sum(s.bytes for s in g) <= 128 * mb for g in groups)
    assert max(sum(s.bytes for s in g) for g in groups) > 64 * mb
    assert plan(shards[:3]) == [] and plan([]) == []
    assert [tier(x * mb) for x in (0, 1, 3, 4, 16, 70)] == [0, 0, 0, 1, 2, 3]
    huge = [Shard(f"h{i}", 1, 90 * mb, 0) for i in range(9)]
    assert plan(huge) == []  # no two fit together


def rows(n):
    return [(i if i % 7 else None, None if i % 5 == 0 else "text %d " % i * (i % 50), "clash", i) for i in range(n)] + [(3, "same", "c", 0), (3, "same", "c", 0), (4, "", None, None), (5, "x" * 2_000_000, "c", 1)]


def test_every_row_ends_in_one_shard(spark, tmp_path):
    data = rows(500)
    df = spark.createDataFrame(data, "doc_id long, text string, shard string, n long").repartition(9)
    out = shard(df, f"file://{tmp_path}/a", target=400_000, least=2_000)
    got = out.collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.doc_id, r.text, r.n) for r in got), key=key) == sorted(((d, t, n) for d, t, _, n in data), key=key)
    store = ShardStore(spark, f"file://{tmp_path}/a")
    version, shards = store.read_manifest()
    assert version > 4 and store.versions() == [version]  # compacted after more than one arrival
    assert sum(s.rows for s in shards) == len(data) and {r.shard for r in got} == {s.name for s in shards}
    assert len(shards) < 27 and any(s.merges for s in shards)


def test_commit_is_atomic_and_versions_read_whole(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/b")
    assert store.read() is None and store.compact() == 0
    df = spark.createDataFrame([(i, "t") for i in range(10)], "doc_id long, text string")
    assert store.append(df) == 1 and store.append(df) == 2
    with pytest.raises(Py4JJavaError):
        store.commit(1, [])
    assert store.read(version=1).count() == 10 and store.read().count() == 20
    assert store.compact(fanout=2) == 3 and store.read().count() == 20 and store.read(version=2).count() == 20
    assert len(store.read_manifest()[1]) == 1
    store.vacuum()
    assert store.versions() == [3] and store.read().count() == 20


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = shard(df, f"file://{tmp_path}/c")
    assert out.count() == 0 and out.columns == ["doc_id", "text", "shard"]


def test_versions_that_others_may_read_stay(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/d")
    first = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, text string").repartition(6)
    store.append(first)
    rest = spark.createDataFrame([(i, "b") for i in range(20, 60)], "doc_id long, text string").repartition(6)
    assert shard(rest, f"file://{tmp_path}/d", least=1).count() == 60
    versions = store.versions()
    assert versions[0] == 1 and len(versions) == 2 and store.read(version=1).count() == 20
    # Similar sizes were merged, and merged again with what came later.
    assert max(s.merges for s in store.read_manifest()[1]) >= 1 and len(store.read_manifest()[1]) < 12
