"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import by_bucket, layout, modest_batches, pack_sorted, part_of, shuffles_released, text_bytes, unpack_sorted, with_row_key, written

#: Rounds of distributed updates; each round learns from one share of the training documents, so that together they see each once.
ROUNDS = 3
#: Rows of weights that travel together, and task results that meet in one group on the way to their mean.
BLOCK_ROWS = 512
FAN = 1024
_BATCH = 4096
_END = np.uint64(0xE5D0FD0C0FFEE000)
_START = np.uint64(0x57A127C0FFEE0001)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each token, its document, and its shape: 0 to 1023 from how it ends. Every document ends with one end token."""
    starts, ends, doc = textbytes.words(buf, offsets)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    place = np.arange(len(doc)) + doc  # each document before has one end more
    out = np.full(len(doc) + n, _END, np.uint64)
    shape = np.zeros(len(out), np.uint64)
    if len(doc):
        out[place] = textbytes.word_hash(buf, starts, ends, lower=True)
        shape[place] = textbytes.word_hash(buf, np.maximum(starts, ends - 3), ends, lower=True, seed=1) >> np.uint64(54)
    return out, np.repeat(np.arange(n), size + 1), shape


def _keyed(tokens: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The fingerprint with the shape in its lowest ten bits, so that counts alone tell a word's class and cell."""
    return (tokens & ~np.uint64(1023)) | shape


def sizes_for(tokens: int) -> tuple[int, int]:
    """Rows of each of the two weight tables, and how many classes there are and cells in each, for so many training tokens.

    Both grow with the tokens, up to a model of 32 MB, which every task holds.
    """
    return 1 << min(16, max(12, tokens.bit_length() - 13)), 32 if tokens < 1 << 33 else 64


class Classes:
    """The class of each word, and its cell there. The most frequent words have a cell each, in half of the classes; the other words
    share the cells of the rest, those of one ending the same."""

    def __init__(self, frequent: np.ndarray, width: int) -> None:
        self.width, self.n = width, width * width
        order = np.argsort(frequent)
        self.frequent, self.rank = frequent[order], order

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Class times width plus cell."""
        w = self.width
        shape, rest = (keys & np.uint64(1023)).astype(np.int64), w - w // 2
        rest = (w // 2 + shape % rest) * w + shape // rest % w
        if not len(self.frequent):
            return rest
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, self.rank[at], rest)

    @property
    def own(self) -> int:
        """Places below this belong to one word each."""
        return self.width * (self.width // 2)


def _features(keys: np.ndarray, doc: np.ndarray, rows: int, classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the rows of the first table, which its class is predicted from, and of the second, which its cell is.

    Both begin with the constant's; then come the word before, the pair before, and the words two and three back (skips); for
    the cell, together with the class, the word before and the one two back. A context never reaches into another document.
    """
    n = len(keys)
    back = []
    for k in range(1, 4):
        x = np.full(n, _START, np.uint64)
        if n > k:
            x[k:] = np.where(doc[k:] == doc[:-k], keys[:-k], _START)
        back.append(x)
    kinds = [back[0], back[1], textbytes.mix64(back[0]) * np.uint64(3) + back[1], back[2]]
    first, second = np.zeros((5, n), np.uint16), np.empty((3, n), np.uint16)  # at most 1 << 16 rows, which sort by radix
    second[0] = classes
    salt = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j, x in enumerate(kinds, 1):
        h = textbytes.mix64(x + np.uint64(j * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        first[j] = np.uint64(1) + h % np.uint64(rows - 1)
        if j < len(second):
            second[j] = np.uint64(width) + textbytes.mix64(h ^ salt) % np.uint64(rows - width)
    return first, second


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each token the sum of its rows."""
    z = weights.take(rows[0], axis=0)
    for own in rows[1:]:
        z += weights.take(own, axis=0)
    return np.clip(z, -80, 80, out=z)  # where float32 has exponentials


def log_softmax(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln of each target's probability."""
    out, one = np.empty(len(target)), np.ones(weights.shape[1], np.float32)
    for s in range(0, len(target), _BATCH):
        z, y = _sums(weights, rows[:, s : s + _BATCH]), target[s : s + _BATCH]
        out[s : s + _BATCH] = z[np.arange(len(y)), y] - np.log(np.exp(z) @ one)
    return out


def _train_slice(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """Adaptive gradient steps over minibatches, in place."""
    one = np.ones(weights.shape[1], np.float32)
    for s in range(0, len(target), _BATCH):
        r, y = rows[:, s : s + _BATCH], target[s : s + _BATCH]
        g = _sums(weights, r)
        np.exp(g, out=g)
        g /= (g @ one)[:, None]
        g[np.arange(len(y)), y] -= 1
        g /= np.float32(len(y))
        for own in r:
            order = np.argsort(own, kind="stable")
            own = own[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            # Most rows are met once or twice; only the others need sums over runs.
            grad, size = g.take(order[first], axis=0), np.diff(np.append(first, len(own)))
            more = np.flatnonzero(size > 1)
            for k in (1, 2, 3):
                grad[more] += g.take(order[first[more] + k], axis=0)
                more = more[size[more] > k + 1]
            if len(more):
                rest = size[more] - 4
                ends = np.cumsum(rest)
                runs = np.arange(ends[-1]) + np.repeat(first[more] + 4 - ends + rest, rest)
                grad[more] += np.add.reduceat(g.take(order[runs], axis=0), ends - rest, axis=0)
            at = own[first]
            squares[at] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            grad *= (-rate / np.sqrt(squares[at]))[:, None]
            weights[at] += grad


def token_counts(docs: DataFrame, text_col: str, n_buckets: int) -> DataFrame:
    """bucket, n, keys, counts: how often each token occurs, in sorted packed form. The vocabulary stays spread over buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            buf, offsets = textbytes.flat(x.column(0))
            found = [np.unique(_keyed(*_pick(part, offs)), return_counts=True) for _, _, part, offs in textbytes.slices(buf, offsets)]
            if not found:
                continue
            keys, counts = _summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
            lo, hi = by_bucket(keys, n_buckets)
            rows = [(b, int(h - l), pack_sorted(keys[l:h]), counts[l:h].astype("<i8").tobytes()) for b, (l, h) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) if h > l]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COUNT_TYPES, strict=True)], ["bucket", "n", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys, counts = _unpacked(table)
        keys, counts = _summed(keys, counts)
        return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["bucket", "n", "keys", "counts"])

    schema = "bucket int, n long, keys binary, counts binary"
    return docs.select(F.col(text_col)).mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema)


_COUNT_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _pick(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tokens, _, shape = _tokens(part, offs)
    return tokens, shape


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(which, counts, len(kinds)).astype(np.int64)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    n = table["n"].to_pylist()
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *(unpack_sorted(k, m) for k, m in zip(table["keys"].to_pylist(), n, strict=True))]), np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c, "<i8") for c in table["counts"].to_pylist())])


class Model:
    """What scoring needs beside the counts: weights of both softmaxes, one table above the other, the places of words, how many
    tokens and kinds of word each place has, and so the totals of the training tokens."""

    def __init__(self, weights: np.ndarray, classes: Classes, tokens: np.ndarray, kinds: np.ndarray) -> None:
        self.weights, self.classes, self.tokens, self.kinds = weights, classes, tokens, kinds
        self.n, self.v = int(tokens.sum()), int(kinds.sum())

    def log10(self, keys: np.ndarray, doc: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Of each token given those before it: its class, its cell among the class, and itself among the words of the cell, where
        what has a cell of its own is certain and other cells keep their last share for words never seen."""
        place, width = self.classes.of(keys), self.classes.width
        of_class, cell = place // width, place % width
        first, second = _features(keys, doc, len(self.weights) // 2, of_class, width)
        within = np.where(place < self.classes.own, 0.0, np.log10((seen + 1) / (self.tokens[place] + self.kinds[place] + 1)))
        upper, lower = np.split(self.weights, 2)
        return (log_softmax(upper, first, of_class) + log_softmax(lower, second, cell)) / np.log(10) + within


def _mean(table: pa.Table) -> pa.Table:
    """Of one block of rows of weights, from several tasks: a row moves as those that met it say, each by how often it did."""
    n, delta = 0, 0
    for t, d in zip(table["n"].to_pylist(), table["delta"].to_pylist(), strict=True):
        t = np.frombuffer(t, "<f4").astype(float)
        n, delta = n + t, delta + np.frombuffer(d, np.float16).reshape(len(t), -1) * t[:, None]
    delta = (delta / np.maximum(n, 1)[:, None]).astype(np.float16)
    return pa.table([pa.array([table["task"][0].as_py()], pa.int32()), pa.array([table["block"][0].as_py()], pa.int32()), pa.array([n.astype("<f4").tobytes()], pa.binary()), pa.array([delta.tobytes()], pa.binary())], ["task", "block", "n", "delta"])


_MOVED = "task int, block int, n binary, delta binary"


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", rounds: int = ROUNDS, rate: float = 0.1) -> Model:
    """Learns the class of each next token, and its cell in the class, from its context, over all of docs.

    counts: token_counts() of the same docs. Each round starts its tasks from the same weights, lets each take gradient
    steps over its documents, and moves the weights by the mean of their steps. What is broadcast is bounded by sizes_for().
    Means are taken block by block, first of up to FAN tasks each, then of those means, so that no group grows with the tasks
    until they are more than FAN * FAN.
    """
    spark = docs.sparkSession

    def total(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([int(_unpacked(table)[1].sum())])], ["n"])

    n_tokens = counts.groupBy("bucket").applyInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0
    n_rows, width = sizes_for(n_tokens)
    own = Classes(np.empty(0, np.uint64), width).own

    def top(table: pa.Table) -> pa.Table:
        keys, c = _unpacked(table)
        at = np.lexsort([keys, -c])[:own]
        return pa.table([pa.array(keys[at].view(np.int64)), pa.array(c[at])], ["key", "n"])

    # At most so many rows a bucket, then so many.
    frequent = counts.groupBy("bucket").applyInArrow(top, "key long, n long").orderBy(F.desc("n"), "key").limit(own).toArrow()
    classes = Classes(frequent["key"].to_numpy().view(np.uint64) if frequent.num_rows else np.empty(0, np.uint64), width)

    def sizes(table: pa.Table) -> pa.Table:
        keys, c = _unpacked(table)
        place = classes.of(keys)
        return pa.table([pa.array(np.arange(classes.n)), pa.array(np.bincount(place, c, classes.n).astype(np.int64)), pa.array(np.bincount(place, minlength=classes.n))], ["c", "t", "k"])

    per = counts.groupBy("bucket").applyInArrow(sizes, "c long, t long, k long").groupBy("c").agg(F.sum("t").alias("t"), F.sum("k").alias("k")).toArrow()
    tokens, kinds = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
    if per.num_rows:
        tokens[per["c"].to_numpy()], kinds[per["c"].to_numpy()] = per["t"].to_numpy(), per["k"].to_numpy()
    weights = np.zeros((2 * n_rows, width), np.float32)
    cells = tokens.reshape(width, width)
    weights[0] = np.log((cells.sum(axis=1) + 0.5) / (n_tokens + 0.5 * width))
    weights[n_rows : n_rows + width] = np.log((cells + 0.5) / (cells.sum(axis=1, keepdims=True) + 0.5 * width))
    for r in range(rounds):
        start = spark.sparkContext.broadcast((weights, classes))

        def learn(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            before, c = start.value
            w, squares, touched = before.copy(), np.full(len(before), 1e-8 if r == 0 else 1e-7, np.float32), np.zeros(len(before), np.int64)
            for x in batches:
                buf, offsets = textbytes.flat(x.column(0))
                for _, _, part, offs in textbytes.slices(buf, offsets, 1 << 17):
                    token, doc, shape = _tokens(part, offs)
                    keys = _keyed(token, shape)
                    place = c.of(keys)
                    of_class, cell = place // width, place % width
                    for half, rows, target in zip((slice(n_rows), slice(n_rows, None)), _features(keys, doc, n_rows, of_class, width), (of_class, cell), strict=True):
                        _train_slice(w[half], squares[half], rows, target, rate / (1 + r))
                        touched[half] += np.bincount(rows.ravel(), minlength=n_rows)
            if touched.any():
                w -= before
                n_blocks, task = len(w) // BLOCK_ROWS, TaskContext.get().partitionId()
                cut = [slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS) for b in range(n_blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n_blocks, task, np.int32)), pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array([touched[k].astype("<f4").tobytes() for k in cut], pa.binary()), pa.array([w[k].astype(np.float16).tobytes() for k in cut], pa.binary())], ["task", "block", "n", "delta"])

        moved = docs.where(part_of(rounds, F.col(text_col), F.lit("round")) == r).select(text_col).mapInArrow(learn, _MOVED)
        for _ in range(2):
            moved = moved.withColumn("task", F.expr(f"task div {FAN}").cast("int")).groupBy("task", "block").applyInArrow(_mean, _MOVED)
        # One row a block, of a table of bounded size.
        moved = moved.groupBy("block").applyInArrow(_mean, _MOVED).toArrow()
        for b, d in zip(moved["block"].to_pylist(), moved["delta"].to_pylist(), strict=True):
            weights[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS] += np.frombuffer(d, np.float16).reshape(BLOCK_ROWS, width)
        start.unpersist()
        del moved
        shuffles_released(spark)
    return Model(weights, classes, tokens, kinds)


def score(docs: DataFrame, counts: DataFrame, model: Model, keep: list[str], n_parts: int, n_buckets: int, text_col: str = "text") -> DataFrame:
    """The columns in keep and, for every row, n_tokens long, n_known long (tokens that counts hold), base_score double and
    score double: log10 probability of the whole text, by counts alone and by the model.

    The model's probability of a token is that of its class given the words before it, times that of its cell among the class
    given those words, times that of the token among the cell: one in a cell of its own, else
    (count + 1) / (the cell's tokens + kinds + 1), so that the last share is for tokens never seen.
    Texts are dealt into parts, each part asks the buckets that hold the vocabulary for the counts of its distinct tokens,
    and scores its documents in sparse batches when the answers meet it. The vocabulary is never in one place.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keyed = with_row_key(docs.select(*dict.fromkeys([*keep, text_col])), "fk", "rk")
    texts = keyed.select(part_of(n_parts, F.col("fk"), F.col("rk")).alias("part"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def distinct(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        buf, offsets = textbytes.flat(table["_text"])
        keys = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(_keyed(*_pick(p, o))) for _, _, p, o in textbytes.slices(buf, offsets))]))
        lo, hi = by_bucket(keys, n_buckets)
        rows = [(part, b, int(h - l), pack_sorted(keys[l:h])) for b, (l, h) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) if h > l]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "bucket", "n", "keys"])

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys, c = _unpacked(held)
        out = []
        for n, k in zip(asked["n"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            mine = unpack_sorted(k, n)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1) if len(keys) else None
            out.append((np.where(keys[at] == mine, c[at], 0) if len(keys) else np.zeros(n, np.int64)).astype("<i8").tobytes())
        return pa.table([asked["part"], asked["bucket"], asked["n"], pa.array(out, pa.binary())], ["part", "bucket", "n", "counts"])

    asked = texts.select("part", "_text").groupBy("part").applyInArrow(distinct, "part int, bucket int, n long, keys binary")
    answers = written(asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(look_up, "part int, bucket int, n long, counts binary"), "counts")
    del asked
    shuffles_released(spark)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        right = right.sort_by("bucket")
        c = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, "<i8") for x in right["counts"].to_pylist())])
        buf, offsets = textbytes.flat(left["_text"])
        cuts = list(textbytes.slices(buf, offsets, 1 << 17))
        met = []
        for _, _, part, offs in cuts:
            token, doc, shape = _tokens(part, offs)
            met.append((_keyed(token, shape), doc))
        kinds = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(k) for k, _ in met)]))
        out = [[np.empty(0)] for _ in range(4)]
        for (a, b, _, _), (keys, doc) in zip(cuts, met, strict=True):
            seen = c[np.searchsorted(kinds, keys)]
            n = b - a
            for o, x in zip(out, (None, seen > 0, np.log10((seen + 1) / (m.n + m.v + 1)), m.log10(keys, doc, seen)), strict=True):
                o.append(np.bincount(doc, x, n))
        n_tokens, n_known, base, model_score = (np.concatenate(x) for x in out)
        return pa.table([*(left[f"k{i}"] for i in range(len(keep))), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(model_score)], [f.name for f in schema])

    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(measure, schema)


def score_documents(docs: DataFrame, learn, keep: list[str], text_col: str = "text") -> tuple[DataFrame, Model]:
    """Scores every row of docs by a model of those rows for which the condition learn holds.

    A null text is empty and still has its end token; so has a text without words. Repeated rows count as often as they
    occur. With no row to learn from, every token is unseen. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    train = docs.where(learn)
    n_parts, n_buckets = layout(text_bytes(docs, text_col))
    counts = written(token_counts(train, text_col, n_buckets), "vocabulary")
    shuffles_released(spark)
    model = fit(train, counts, text_col)
    return score(docs, counts, model, keep, n_parts, n_buckets, text_col), model
