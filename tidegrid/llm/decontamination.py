"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import modest_batches, part_of

#: Token positions that a seed looks at; the others between them may differ. Every run of 13 tokens with two substitutions
#: anywhere holds one of these two seeds at some offset (tests/llm/test_decontamination.py goes through all of them).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: For items of 8 to 12 tokens: with a fifth of them substituted, three in a row are left.
SHORT = ((0, 1, 2),)
#: Items of fewer tokens match only where all their tokens stand one after another.
LEAST = 8
#: Items of fewer tokens are ordinary words and phrases, so they condemn no document; overlaps() reports them all the same.
LEAST_TO_REJECT = 4
#: An overlap is a run of so many tokens, or a whole shorter item, of which this share is the same.
WINDOW = 13
SHARE = 0.8
#: Test tokens that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_TOKENS = 500_000
_FILTER_BITS = 23
#: Hits that are looked at together: a seed that many items share is met by many documents.
_HITS = 1 << 20


def _seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k, p in enumerate(mask):
        x = (x ^ tokens[p : p + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        x ^= x >> np.uint64(29)
    return textbytes.mix64(x ^ np.uint64(sum(1 << p for p in mask)))


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, doc = textbytes.words(buf, offsets, strip=True)
    return textbytes.word_hash(buf, starts, ends, lower=True), doc


class TestBlock:
    """A block of benchmark items, ready for lookup. Items of fewer than least tokens match nothing."""

    __test__ = False

    def __init__(self, ids: list[int | None], texts: list[str | None], least: int = 1) -> None:
        buf, offsets = textbytes.flat(pa.array(texts, pa.string()))
        tokens, doc = _tokens(buf, offsets)
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        items: dict[bytes, int | None] = {}
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)):
            if bounds[i + 1] - bounds[i] >= max(least, 1):
                items.setdefault(tokens[bounds[i] : bounds[i + 1]].tobytes(), ids[i])
        self.ids = list(items.values())
        self.items = [np.frombuffer(x, np.uint64) for x in items]
        hashes, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, x in enumerate(self.items):
            for m in self.masks_of(x):
                h = _seeds(x, m)
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.place = h[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

        self.masks = sorted({m for x in self.items for m in self.masks_of(x)})

    @staticmethod
    def masks_of(item: np.ndarray) -> tuple[tuple[int, ...], ...]:
        return MASKS if len(item) >= WINDOW else SHORT if len(item) >= LEAST else (tuple(range(len(item))),)

    def overlaps(self, tokens: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Of a slice: document, first word, words, item and equal words of each maximal region that overlaps with one item cover."""
        found = [np.empty((3, 0), np.int64)]
        for m in self.masks:
            h = _seeds(tokens, m)
            if not len(h):
                continue
            inside = doc[: len(h)] == doc[m[-1] :]
            at = np.flatnonzero(inside & self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            ends = np.cumsum(hi - lo)
            s = 0
            while s < len(at):
                done = ends[s - 1] if s else 0
                e = max(s + 1, int(np.searchsorted(ends, done + _HITS, "right")))
                count = hi[s:e] - lo[s:e]
                rows = np.repeat(lo[s:e] - (ends[s:e] - count - done), count) + np.arange(int(count.sum()))
                i = np.repeat(at[s:e], count)
                found.append(np.unique(np.stack([doc[i], self.owner[rows], i - self.place[rows]]), axis=1))
                s = e
        hits = np.unique(np.concatenate(found, axis=1), axis=1)
        if not hits.shape[1]:
            return []
        head = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
        good: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for d, k, diagonal in hits.T.tolist():
            item = self.items[k]
            a, b = max(int(head[d]), diagonal), min(int(head[d + 1]), diagonal + len(item))
            width = min(WINDOW, len(item))
            if b - a < width:
                continue
            same = np.concatenate([[0], np.cumsum(tokens[a:b] == item[a - diagonal : b - diagonal])])
            ok = np.flatnonzero(same[width:] - same[:-width] >= (SHARE if len(item) >= LEAST else 1) * width)
            if len(ok):
                s, e = a + int(ok[0]), a + int(ok[-1]) + width
                good.setdefault((d, k), []).append((s, e, int(same[e - a] - same[s - a])))
        out = []
        for (d, k), spans in good.items():
            spans.sort()
            s, e, best = spans[0]
            for x in [*spans[1:], (1 << 62, 0, 0)]:
                if x[0] >= e:
                    out.append((d, s - int(head[d]), e - s, k, best))
                    s, e, best = x
                else:
                    e, best = max(e, x[1]), max(best, x[2])
        return out


def test_blocks(benchmark: DataFrame, text_col: str, id_col: str, block_tokens: int, least: int = 1) -> Iterator[TestBlock]:
    from .mixing import n_words

    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(n_words(F.col("t")))).first()[0] or 0
    n = -(-total // block_tokens)
    for k in range(n):
        got = (rows if n == 1 else rows.where(part_of(n, F.col("t")) == k)).toArrow()
        yield TestBlock(got["i"].to_pylist(), got["t"].to_pylist(), least)


test_blocks.__test__ = False


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", test_text_col: str = "text", test_id_col: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each region of a document that overlaps a benchmark item, item by item: the columns in keep, item_id,
    first_word, n_words and n_same (of several ways to lay the item on the region, that with most equal words).

    Tokens are words in lower case (A-Z) and bare of leading and trailing ASCII punctuation. Test and training seeds that
    hash alike are joined where the documents are read; around each hit the two texts are laid on each other, and an
    overlap is a run of 13 tokens, or a whole shorter item, of which 80% are the same. Documents are never shuffled.
    The benchmark goes to the tasks in blocks of at most about block_tokens tokens, so what is broadcast is bounded, and
    every block meets all documents. Items of fewer than 8 tokens match only as they are; null texts count as empty. Of items with
    the same tokens the smallest id stands for all. Repeated documents are reported each; empty tables give no rows.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("item_id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("first_word", "n_words", "n_same")])
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    out = None
    for block in test_blocks(benchmark, test_text_col, test_id_col, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                buf, offsets = textbytes.flat(x.column(len(keep)))
                found = []
                for a, _, part, offs in textbytes.slices(buf, offsets):
                    tokens, doc = _tokens(part, offs)
                    found += [(a + d, shared.value.ids[k], s, n, same) for d, s, n, k, same in shared.value.overlaps(tokens, doc)]
                if found:
                    at, item, first, n, same = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([*(x.column(i).take(pa.array(at)) for i in range(len(keep))), pa.array(item, pa.int64()), *(pa.array(c, pa.int32()) for c in (first, n, same))], [f.name for f in schema])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", test_text_col: str = "text", test_id_col: str = "item_id", block_tokens: int = BLOCK_TOKENS, least: int = LEAST_TO_REJECT) -> DataFrame:
    """docs without the rows that overlap a benchmark item of at least `least` tokens anywhere. A row's text alone decides, so
    nothing is shuffled."""
    spark, cols = docs.sparkSession, docs.columns
    modest_batches(spark)
    for block in test_blocks(benchmark, test_text_col, test_id_col, block_tokens, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                buf, offsets = textbytes.flat(x.column(cols.index(text_col)))
                keep = np.ones(x.num_rows, bool)
                for a, _, part, offs in textbytes.slices(buf, offsets):
                    tokens, doc = _tokens(part, offs)
                    for d, *_ in shared.value.overlaps(tokens, doc):
                        keep[a + d] = False
                yield x.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
