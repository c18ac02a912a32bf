import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import textbytes, toxicity


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = ["w%03d" % i for i in range(400)]
    bad = ["zorgle%s" % s for s in ("a", "bb", "ccc", "dd", "ee", "ff", "gg", "hh", "ii", "jj")]
    rows = []
    for i in range(n):
        text = [rnd.choice(plain) for _ in range(rnd.randrange(20, 80))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad[: 7 if i % 4 else 10]).capitalize() + ",")
        rows.append((i, " ".join(text), toxic))
    return rows


def test_learns_from_allowed_rows_only_and_scores_all(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7, ""), (9001, "zorglezz " * 9), (9002, "x " * 60000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    out = toxicity.score(docs, model, ["doc_id"]).withColumn("h", toxicity.held_out()).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.score) for r in out if r.h and r.doc_id in truth]
    pos, neg = np.array([s for y, s in held if y]), np.array([s for y, s in held if not y])
    assert np.mean([(neg < s).mean() for s in pos]) > 0.97
    assert np.mean(pos >= 0.3) > 0.9 and np.mean(neg < 0.3) > 0.9
    # A form never seen, of a beginning that is.
    assert next(r.score for r in out if r.doc_id == 9001) > 0.5
    # Labels that may not be learned from change nothing.
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = toxicity.fit(docs, flipped.where(~toxicity.held_out()))
    assert np.allclose(model.weights, again.weights)


class Brute:
    """The same two models from plain dictionaries of strings."""

    def __init__(self, train, d):
        self.d, self.pairs, self.context, self.follow = d, Counter(), Counter(), Counter()
        before = {}
        for y, words in train:
            for u, w in zip(["", *words], words):
                self.pairs[y, u, w] += 1
                before.setdefault(w, set()).add((y, u))
        for (y, u, _), n in self.pairs.items():
            self.context[y, u] += n
            self.follow[y, u] += 1
        self.kinds = {y: {w: sum(1 for z, _ in b if z == y) for w, b in before.items()} for y in (0, 1)}
        either = {w: len({u for _, u in b}) for w, b in before.items()}
        self.stems = {w[:k] for w in before for k in toxicity.STEMS if len(w) > k or k == 4}
        everything = sum(either.values()) + len(before) + len(self.stems) + 1
        # An event is a known word, or what an unknown word begins with.
        self.shared = {("word", w): (n + 1) / everything for w, n in either.items()} | {("new", s): 1 / everything for s in (*self.stems, "")}
        self.rho = {y: self.ratios(y) for y in (0, 1)}

    def under(self, event, k):
        kind, x = event
        return x[:k] if (len(x) > k if kind == "word" else len(x) >= k) or (k == 4 and x) else None

    def ratios(self, y):
        rho = dict.fromkeys(self.shared, 1.0)
        for k in toxicity.STEMS:
            groups = {}
            for e in self.shared:
                if (s := self.under(e, k)) is not None:
                    groups.setdefault(s, []).append(e)
            own = {s: sum(self.kinds[y][x] for kind, x in es if kind == "word") for s, es in groups.items()}
            total, types = sum(own.values()), sum(v > 0 for v in own.values())
            mass = {s: sum(self.shared[e] * rho[e] for e in es) for s, es in groups.items()}
            all_ = sum(mass.values())
            for s, es in groups.items():
                p = all_ * (max(own[s] - self.d, 0) + self.d * types * mass[s] / all_) / total if total else mass[s]
                for e in es:
                    rho[e] *= p / mass[s]
        return rho

    def probability(self, y, u, e):
        kinds = self.kinds[y]
        total, types = sum(kinds.values()), sum(v > 0 for v in kinds.values())
        low = self.shared[e] * self.rho[y][e]
        if total:
            low = (max(kinds.get(e[1], 0) * (e[0] == "word") - self.d, 0) + self.d * types * low) / total
        if not self.context[y, u]:
            return low
        seen = self.pairs[y, u, e[1]] if e[0] == "word" else 0
        return (max(seen - self.d, 0) + self.d * self.follow[y, u] * low) / self.context[y, u]

    def event(self, w):
        if ("word", w) in self.shared:
            return "word", w
        return "new", max((w[:k] for k in toxicity.STEMS if (len(w) > k or k == 4) and w[:k] in self.stems), key=len, default="")


def model_of(train, discount):
    batch = pa.record_batch([pa.array([y for y, _ in train], pa.int32()), pa.array([" ".join(w) for _, w in train])], ["y", "t"])
    got = pa.Table.from_batches(list(toxicity._pair_counts(iter([batch])))).to_pandas()
    stems = toxicity._STEM_COLS
    g = got.groupby(["u", "w", *stems], as_index=False)[["t", "o"]].sum()
    g = g.assign(bt=g.t > 0, bo=g.o > 0, one=1)
    word = g.groupby(["w", *stems], as_index=False)[["bt", "bo", "one"]].sum()
    words = {"key": word.w.to_numpy().view(np.uint64), "nt": word.bt.to_numpy(), "no": word.bo.to_numpy(), "ns": word.one.to_numpy()} | {c: word[c].to_numpy().view(np.uint64) for c in stems}
    table = lambda key, cols: {"key": np.sort(key)} | {c: np.append(x.to_numpy()[np.argsort(key)], 0) for c, x in cols.items()}
    ctx = g.groupby("u", as_index=False)[["t", "o", "bt", "bo"]].sum()
    contexts = table(ctx.u.to_numpy().view(np.uint64), {"ct": ctx.t, "co": ctx.o, "ft": ctx.bt, "fo": ctx.bo})
    pairs = table(toxicity._pair(g.u.to_numpy().view(np.uint64), g.w.to_numpy().view(np.uint64)), {"t": g.t, "o": g.o})
    return toxicity.KneserNey(words, contexts, pairs, discount)


@pytest.mark.parametrize("classes, discount", [((0, 1), toxicity.DISCOUNT), ((0, 1), 0.75), ((0,), 0.75), ((1,), 1.0)])
def test_probabilities_equal_brute_force_and_sum_to_one(classes, discount):
    rnd = random.Random(4)
    vocabulary = ["abcd", "abcdef", "abcdefgh", "abcdefgi", "abcxyzuvw", "q", "zorgle", "zorglebb", "zorgleccc", "the", "of"]
    train = [(rnd.choice(classes), [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 9))]) for _ in range(30)]
    model, brute = model_of(train, discount), Brute(train, discount)
    for words in (["the", "zorgle"], ["abcd", "q", "abcdefgz", "zorglex", "neverseen", "abcxyzuvq", "hm", "the"]):
        buf, offsets = textbytes.flat(pa.array([" ".join(words)]))
        kinds, which, before, _, stems = toxicity._tokens(buf, offsets)
        toxic, ordinary = model.probabilities(kinds, which, before, stems)
        for i, (u, w) in enumerate(zip(["", *words], words)):
            e = brute.event(w)
            # A word never seen is no context.
            assert toxic[i] == pytest.approx(brute.probability(1, u, e)) and ordinary[i] == pytest.approx(brute.probability(0, u, e))
    for u in ("", "the", "abcd", "neverseen"):
        for y in (0, 1):
            assert sum(brute.probability(y, u, e) for e in brute.shared) == pytest.approx(1)


def test_clashing_columns_nulls_and_repeats(spark):
    """Columns named as those the operator makes; a row without text or id; a row twice."""
    rows = [(i, t, i, 0.5, "u") for i, t, _ in corpus(60, 2)] + [(None, None, 1, 0.5, "u"), (3, "", 1, 0.5, "u"), (3, "", 1, 0.5, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _y int, _h double, w string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in corpus(60, 2)] + [(1, 1, "x"), (1, 0, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model, ["doc_id", "_y", "_h", "w"]).collect()
    assert len(out) == 63 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.reject(docs, model).columns == docs.columns


def test_degenerate_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model, ["doc_id"]).collect())
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    assert len(textbytes.flat(pa.array([None, "é"]))[0]) == 2
