import random

import pytest

from tidegrid.llm import substring


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    ident = [float("inf") if i is None else i for i, _ in rows]
    low = {}
    for w, i in zip(words, ident):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            low[g] = min(low.get(g, i), i)
    out = []
    for w, i in zip(words, ident):
        gone = set()
        for k in range(len(w) - width + 1):
            if low[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def fixture():
    rnd = random.Random(4)
    vocab = ["v%d" % i for i in range(500)] + ["é%d" % i for i in range(20)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [text(rnd.choice([5, 12, 13, 14, 30, 90])) for _ in range(12)]
    rows = []
    for i in range(150):
        t = text(rnd.choice([0, 1, 12, 13, 60, 200]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            t[at:at] = rnd.choice(passages)
        rows.append((rnd.randrange(10_000), "".join(w + rnd.choice([" ", "\n", "\t ", " \x0c"]) for w in t)))
    rows += [(20_000 + i, rows[i % 7][1]) for i in range(40)] + [(1, "a " * 50), (2, "a " * 20), (2, "a " * 20), (3, "a b " * 30)]
    return rows + [(None, rows[3][1]), (None, rows[3][1]), (rows[5][0], rows[5][1]), (-4, None), (9, ""), (None, "q " * 40_000), (77, "only\x1fone\xa0word")]


@pytest.mark.parametrize("width", [13, 3])
def test_equals_brute_force(spark, width):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, fk int").repartition(5)
    got = substring.remove_repeats(df, ["doc_id", "text", "part"], width).collect()
    want = brute(rows, width)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed, r.kept) for r in got], key=key) == sorted([(*a, *b) for a, b in zip(rows, want)], key=key)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


def test_levels_and_empty(spark):
    assert substring.levels(13) == [4, 8, 13] and substring.levels(3) == [3] and substring.levels(50) == [4, 8, 16, 32, 50]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
