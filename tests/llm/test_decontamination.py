import itertools
import random

from tidegrid.llm import decontamination as dc


def test_masks_hold_under_substitutions():
    for n in range(dc.LEAST, dc.WINDOW + 1):
        masks = dc.MASKS if n == dc.WINDOW else dc.SHORT
        for subs in itertools.combinations(range(n), int(n - dc.SHARE * n + 1e-9)):
            assert any(all(o + p not in subs for p in m) for m in masks for o in range(n - m[-1]))


def norm(text):
    import string

    out = []
    for w in (text or "").encode().split():
        bare = w.strip(string.punctuation.encode()) or w
        out.append(bytes(c + 32 if 65 <= c <= 90 else c for c in bare))
    return out


def brute(doc, item, least=1):
    d, t = norm(doc), norm(item)
    w = min(dc.WINDOW, len(t))
    if len(t) < max(least, 1):
        return False
    share = dc.SHARE if len(t) >= dc.LEAST else 1
    return any(sum(a == b for a, b in zip(d[i : i + w], t[j : j + w])) >= share * w for i in range(len(d) - w + 1) for j in range(len(t) - w + 1))


def fixture():
    rnd = random.Random(2)
    vocab = ["v%d" % i for i in range(300)] + ["the", "of"] * 40
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([8, 12, 15, 30, 55])))) for i in range(25)] + [(90, "the of"), (91, None), (None, ""), (3, "the of the of the")]
    docs = []
    for i in range(160):
        d = text(rnd.choice([5, 40, 300]))
        if i % 2:
            p = items[rnd.randrange(25)][1].split()
            for k in rnd.sample(range(len(p)), min(len(p), rnd.choice([0, 1, 2, len(p) // 5, len(p) // 2]))):
                p[k] = "changed%d" % k
            p = p[rnd.choice([0, 0, 2]) :]
            at = rnd.randrange(len(d))
            d[at:at] = [w.upper() + "," if rnd.random() < 0.3 else w for w in p]
        docs.append((i, " ".join(d)))
    return docs + [(500, None), (501, ""), (None, docs[1][1]), (7, docs[7][1]), (502, items[0][1]), (503, "x " * 40000 + items[5][1])], items


def test_overlaps_equal_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [any(brute(t, i, dc.LEAST_TO_REJECT) for _, i in items) for _, t in docs[:-1]] + [True]
    for block in (dc.BLOCK_TOKENS, 100):
        clean = dc.clean(df, bench, block_tokens=block).collect()
        left = [r.doc_id for r in clean]
        assert [w for w in sorted(str(d[0]) for d, y in zip(docs, want) if not y)] == sorted(map(str, left))
        assert clean[0].asDict().keys() == {"doc_id", "text", "item_id"}
    found = dc.overlaps(df.drop("item_id"), bench, ["doc_id"]).collect()
    text = {d: t for d, t in docs}
    # Every item that a document overlaps with is named, short ones too.
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id != 503} == {(d, i) for d, t in docs[:-1] for i, item in items if brute(t, item)}
    assert {5} <= {r.item_id for r in found if r.doc_id == 503}
    for r in found:
        assert r.first_word + r.n_words <= len(norm(text[r.doc_id])) and 0.8 * min(13, r.n_words) <= r.n_same <= r.n_words


def test_empty(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.overlaps(df.limit(0), bench, ["doc_id"]).count() == 0
    assert dc.overlaps(df, bench.limit(0), ["doc_id"]).count() == 0
    assert dc.clean(df, bench.limit(0)).count() == len(docs)


def test_many_hits_of_one_seed_go_in_pieces(monkeypatch):
    """Items that all share a seed: the same regions, however few hits are looked at together."""
    import numpy as np
    import pyarrow as pa

    items = [" ".join(f"s{k}" for k in range(13)) + f" own{i} own{i}x" for i in range(40)]
    block = dc.TestBlock(list(range(40)), items)
    buf, offsets = dc.textbytes.flat(pa.array([items[3], "a b c " + items[7], "q"]))
    tokens, doc = dc._tokens(buf, offsets)
    want = sorted(block.overlaps(tokens, doc))
    assert len(want) == 80 and {k for d, _, _, k, _ in want if d == 0} == set(range(40))
    monkeypatch.setattr(dc, "_HITS", 7)
    assert sorted(block.overlaps(tokens, doc)) == want and np.all([n <= 15 for _, _, n, _, _ in want])
