"""Toxicity by class-conditional Kneser-Ney models over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import dropped, modest_batches, written

#: Labelled rows that a model is fitted to, at most; among more, those of the smallest hash of the id.
MAX_LABELLED = 12_000
#: What an expression met once says is left wholly to the backoff: on held-out labels that beats smaller discounts.
DISCOUNT = 1.0
#: Ratios (ln) are held within this; a word stands out above the one and the other of the levels.
MOST = 8.0
LEVELS = (2.0, 4.0)
FEATURES = 8
THRESHOLD = 0.3
_PAIR = np.uint64(0x9FB21C651E98DF25)
_START = np.uint64(0x2545F4914F6CDD1D)


#: Lengths in bytes of the word beginnings that stand between a word and the shared counts. Every word has one of the first
#: length, if need be itself; of the other lengths words that are longer.
STEMS = (4, 5, 6, 7)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a slice: the distinct words, lower-cased and bare of punctuation; which of them each token is; the word before each
    token; its document; and for each length in STEMS the beginnings of the distinct words, 0 for words without one."""
    starts, ends, doc = textbytes.words(buf, offsets, strip=True)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return none, np.empty(0, np.int64), none, doc, []
    token = textbytes.word_hash(buf, starts, ends, lower=True)
    before = np.empty_like(token)
    before[0], before[1:] = _START, token[:-1]
    before[np.flatnonzero(np.diff(doc)) + 1] = _START
    kinds, first, which = np.unique(token, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    stems = [np.where((e - s > k) | (k == STEMS[0]), textbytes.word_hash(buf, s, np.minimum(s + k, e), lower=True), np.uint64(0)) for k in STEMS]
    return kinds, which, before, doc, stems


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textbytes.mix64(before * _PAIR + word)


_STEM_COLS = [f"p{k}" for k in STEMS]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns toxic, text to u, w, toxic and ordinary counts of each pair of adjacent words, summed over a slice, and w's beginnings."""
    for x in batches:
        labels = x.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, offsets = textbytes.flat(x.column(1))
        for a, b, part, offs in textbytes.slices(buf, offsets):
            kinds, which, before, doc, stems = _tokens(part, offs)
            if not len(which):
                continue
            word = kinds[which]
            _, first, back = np.unique(_pair(before, word), return_index=True, return_inverse=True)
            toxic = labels[a:b][doc] == 1
            one = np.bincount(back[toxic], minlength=len(first))
            rest = np.bincount(back[~toxic], minlength=len(first))
            yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(one), pa.array(rest), *(pa.array(q[which[first]].view(np.int64)) for q in stems)], ["u", "w", "t", "o", *_STEM_COLS])


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        key = _pair(*(x.column(i).to_numpy().view(np.uint64) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), x.column(2).cast(pa.int32()), x.column(3).cast(pa.int32())], ["key", "t", "o"])


def _looked_up(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns by key, in as few bytes as they need; a row of zeros is added for what isn't there."""
    got = df.toArrow()
    key = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    out = {"key": key[order]}
    for c in got.column_names[1:]:
        x = got[c].to_numpy()
        out[c] = np.append(x.astype(np.min_scalar_type(int(x.max(initial=0))))[order], 0)
    return out


class KneserNey:
    """Two interpolated models, toxic and ordinary: pairs of words back off to words, these to ever shorter beginnings of words,
    so that a rare form of an expression draws on its kin, and those to counts shared by both.

    Each model's probabilities after any word add up to one over the words it has met, one event for unknown words under
    each beginning, and one for all others.
    """

    def __init__(self, words: dict[str, np.ndarray], contexts: dict[str, np.ndarray], pairs: dict[str, np.ndarray], discount: float = DISCOUNT) -> None:
        """words: key, nt, no (kinds before, by class), ns (in either), and the beginnings, 0 for none; in any order.
        contexts: sorted key, ct, co (tokens that follow), ft, fo (kinds that follow). pairs: sorted key, t, o. A place for what isn't there ends each of the latter two."""
        self.contexts, self.pairs, self.discount = contexts, pairs, discount
        d, levels = discount, []
        for stem in (words[c] for c in _STEM_COLS):
            at = np.flatnonzero(stem)
            keys, first, which = np.unique(stem[at], return_index=True, return_inverse=True)
            levels.append((keys, at[first], at, which))
        # An unknown word under each beginning and one under none, each met as if once.
        everything = float(words["ns"].sum() + len(words["key"]) + sum(len(x[0]) for x in levels) + 1)
        under = [np.ones(len(x[0])) for x in levels]
        parents = []
        for k in range(1, len(levels)):
            place = np.full(len(words["key"]), -1)
            place[levels[k - 1][2]] = levels[k - 1][3]
            parents.append(place[levels[k][1]])
        for k in range(len(levels) - 1, 0, -1):
            np.add.at(under[k - 1], parents[k - 1], under[k])
        shared = (words["ns"] + 1.0) / everything
        low, unknown, ratios = [], [], []
        for c in "to":
            n = words["n" + c].astype(float)
            rho, per = np.ones(len(n)), []  # this class's probability over the shared one, by the longest beginning so far
            for k, (keys, _, at, which) in enumerate(levels):
                q = (np.bincount(which, words["ns"][at] + 1.0, len(keys)) + under[k]) / everything
                base = q * (per[k - 1][parents[k - 1]] if k else 1.0)
                own = np.bincount(which, n[at], len(keys))
                if own.sum():
                    base = base.sum() * (np.maximum(own - d, 0) + d * (own > 0).sum() * base / base.sum()) / own.sum()
                per.append(base / q)
                rho[at] = per[k][which]
            total, types = n.sum(), (n > 0).sum()
            low.append((np.maximum(n - d, 0) + d * types * shared * rho) / total if total else shared * rho)
            unknown.append((d * types / total if total else 1.0) / everything)
            ratios.append(np.concatenate([*per, [1.0]]))
        order = np.argsort(words["key"])
        self.words = {"key": words["key"][order]} | {c: np.append(x[order], 0).astype(np.float32) for c, x in zip("to", low, strict=True)}
        keys = np.concatenate([x[0] for x in levels])
        order = np.argsort(keys)
        self.stems = {"key": keys[order]} | {c: np.append(x[:-1][order], 1.0).astype(np.float32) for c, x in zip("to", ratios, strict=True)}
        self.unknown = dict(zip("to", unknown, strict=True))
        self.weights: np.ndarray | None = None
        self.scale: np.ndarray | None = None

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of each x in keys, one past the end where it isn't there."""
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, at, len(keys))

    def probabilities(self, kinds: np.ndarray, which: np.ndarray, before: np.ndarray, stems: list[np.ndarray]) -> list[np.ndarray]:
        """Of each token after the word before it, by the toxic and by the ordinary model."""
        d = self.discount
        w, u, p = self._find(self.words["key"], kinds), self._find(self.contexts["key"], before), self._find(self.pairs["key"], _pair(before, kinds[which]))
        new = np.flatnonzero(w == len(self.words["key"]))
        begun = np.full(len(new), len(self.stems["key"]))
        for x in stems:
            at = self._find(self.stems["key"], x[new])
            begun = np.where(at < len(self.stems["key"]), at, begun)
        out = []
        for c in "to":
            low = self.words[c][w].astype(float)
            low[new] = self.unknown[c] * self.stems[c][begun]
            low = low[which]
            context = self.contexts["c" + c][u]
            high = (np.maximum(self.pairs[c][p] - d, 0) + d * self.contexts["f" + c][u] * low) / np.maximum(context, 1)
            out.append(np.where(context > 0, high, low))
        return out

    def ratios(self, kinds: np.ndarray, which: np.ndarray, before: np.ndarray, stems: list[np.ndarray]) -> np.ndarray:
        """ln of toxic over ordinary probability of each token after the word before it."""
        toxic, ordinary = self.probabilities(kinds, which, before, stems)
        return np.log(toxic) - np.log(ordinary)

    def features(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """Of each whole text: length-normalised log-likelihood ratios of the text and of its most toxic runs of 1 and 3 words,
        how many words stand out and in what share, at two levels, and how long it is."""
        buf, offsets = textbytes.flat(column)
        out = np.zeros((len(offsets) - 1, FEATURES))
        for a, b, part, offs in textbytes.slices(buf, offsets):
            kinds, which, before, doc, stems = _tokens(part, offs)
            if not len(which):
                continue
            r = np.clip(self.ratios(kinds, which, before, stems), -MOST, MOST)
            n = np.bincount(doc, minlength=b - a)
            have = np.flatnonzero(n)
            heads = np.concatenate([[0], np.cumsum(n)[:-1]])[have]
            run = np.cumsum(np.concatenate([[0.0], r]))
            start = np.maximum(np.arange(len(r)) - 2, np.repeat(heads, n[have]))
            three = (run[1:] - run[start]) / 3
            out[a:b, 0] = np.bincount(doc, r, b - a) / np.maximum(n, 1)
            out[a + have, 1] = np.maximum.reduceat(r, heads)
            out[a + have, 2] = np.maximum.reduceat(three, heads)
            for j, level in enumerate(LEVELS):
                above = np.bincount(doc, r > level, b - a)
                out[a:b, 3 + 2 * j] = np.log1p(above)
                out[a:b, 4 + 2 * j] = np.log1p(above / np.maximum(n, 1) * 100)
            out[a:b, 7] = np.log1p(n)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of labels on the features, by Newton steps with a ridge."""
        mean, std = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.scale = np.stack([mean, np.where(std > 1e-9, std, 1.0)])
        z = np.column_stack([np.ones(len(x)), (x - self.scale[0]) / self.scale[1]])
        w = np.zeros(z.shape[1])
        ridge = np.diag([1e-3, *[0.1] * (z.shape[1] - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - ridge @ w
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge
            step = np.linalg.solve(h, g)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.scale[0]) / self.scale[1]])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> KneserNey:
    """The models of the labelled rows of docs. labels holds id and label, and only rows that may be learned from.

    Ids or labels that are null teach nothing; of an id that is labelled twice the higher label counts, and of
    one that has several texts the first in order. Two of three
    labelled rows, chosen by hash, give the counts; the rest calibrate. Where no row of one label is left, the models
    are equal and the score is the share of label 1 there is.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.withColumn("_h", F.xxhash64("_id", F.lit("toxicity"))).orderBy("_h", "_id").limit(max_labelled)
    # At most max_labelled pairs of an id and a label, so they may be sent to every task.
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id", "_y", "_h").agg(F.min("_text").alias("_text"))
    pairs = rows.where("pmod(_h, 3) < 2").select("_y", "_text").mapInArrow(_pair_counts, "u long, w long, t long, o long, " + ", ".join(f"{c} long" for c in _STEM_COLS)).groupBy("u", "w", *_STEM_COLS).agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    pairs = written(pairs, "pairs")
    as_context = pairs.groupBy(F.col("u").alias("key")).agg(F.sum("t").alias("ct"), F.sum("o").alias("co"), F.count_if(F.col("t") > 0).alias("ft"), F.count_if(F.col("o") > 0).alias("fo"))
    as_word = pairs.groupBy(F.col("w").alias("key"), *_STEM_COLS).agg(F.count_if(F.col("t") > 0).alias("nt"), F.count_if(F.col("o") > 0).alias("no"), F.count("*").alias("ns"))
    if DISCOUNT == 1:
        # After a word that nothing follows twice, a discount of one leaves all to the backoff, as after an unknown word.
        as_context = as_context.where("ct > ft or co > fo")
    # A pair that the discount leaves nothing of counts by its context and its word only.
    as_pair = pairs.where(F.greatest("t", "o") > DISCOUNT).select("u", "w", "t", "o").mapInArrow(_pair_keys, "key long, t int, o int")
    # All of these are bounded by the words of max_labelled texts.
    words = as_word.toArrow()
    words = {c: words[c].to_numpy().view(np.uint64) if c in ("key", *_STEM_COLS) else words[c].to_numpy() for c in words.column_names}
    model = KneserNey(words, _looked_up(as_context), _looked_up(as_pair))
    del words
    dropped(pairs)
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = shared.value.features(x.column(1))
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c) for c in f.T)], ["y", *(f"f{i}" for i in range(f.shape[1]))])

    held = rows.where("pmod(_h, 3) = 2").select(F.col("_y").alias("y"), "_text").mapInArrow(measure, "y int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toArrow()
    shared.destroy()  # what is scored later gets the model with its calibration
    x = np.column_stack([held[f"f{i}"].to_numpy() for i in range(FEATURES)]) if held.num_rows else np.zeros((0, FEATURES))
    y = held["y"].to_numpy().astype(float) if held.num_rows else np.zeros(0)
    order = np.lexsort([*x.T, y])
    model.calibrate(x[order], y[order])
    return model


def score(docs: DataFrame, model: KneserNey, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and score double, 0 to 1, for every row, in one pass without a shuffle.

    A null text counts as empty; an empty one gets the score of no evidence. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    modest_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(keep))), pa.array(shared.value.scores(shared.value.features(x.column(len(keep)))))], [*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def reject(docs: DataFrame, model: KneserNey, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches threshold; nothing is shuffled, and nulls count as in score()."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(shared.value.scores(shared.value.features(x.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
