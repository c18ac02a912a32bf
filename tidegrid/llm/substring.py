"""Substring dedup by level-wise doubling over word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes
from .rounds import Asked, Parts, copies, repeated

#: Words of the windows that the first level looks at; every level after it looks at twice as many, up to the length asked for.
FIRST = 4
_NO_ID = np.iinfo(np.int64).max


def levels(width: int, first: int = FIRST) -> list[int]:
    out = [min(first, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


class _Slice:
    """The words of a slice of a part, and where windows of a width start."""

    def __init__(self, row: int, n_rows: int, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.row, self.n_rows, self.buf = row, n_rows, buf
        self.starts, self.ends, self.doc = textbytes.words(buf, offsets)
        self.tokens = textbytes.word_hash(buf, self.starts, self.ends)

    def check(self, at: np.ndarray, width: int) -> np.ndarray:
        """Another fingerprint of the windows that start at the words in at, from other fingerprints of their words."""
        return textbytes.windows(textbytes.word_hash(self.buf, self.starts, self.ends, seed=1), width, 0xC4EC)[at] if len(at) else np.empty(0, np.uint64)

    def whole(self, width: int) -> np.ndarray:
        """Positions whose window stays in one document."""
        n = max(0, len(self.doc) - width + 1)
        return self.doc[:n] == self.doc[width - 1 :] if n else np.zeros(0, bool)


def _slices(left: pa.Table) -> Iterator[_Slice]:
    buf, offsets = textbytes.flat(left["_text"])
    for a, b, part, offs in textbytes.slices(buf, offsets):
        yield _Slice(a, b - a, part, offs)


def _ids(left: pa.Table) -> np.ndarray:
    return left["_id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class _Walk:
    """Candidates of a part at each level, rebuilt from the answers so far."""

    def __init__(self, left: pa.Table, side: pa.Table, widths: list[int], bits: int) -> None:
        self.left, self.side, self.widths, self.bits = left, side, widths, bits
        self.slices = list(_slices(left))
        # Copies with a larger id lie wholly in the first one's windows, so they ask nothing.
        kind = copies(left, side)
        self.kind, self.ids = kind, _ids(left)
        self.live = [(kind[s.row + s.doc] != 3) if len(s.doc) else np.zeros(0, bool) for s in self.slices]
        self.seen = kind != 0

    def candidates(self, level: int) -> list[np.ndarray]:
        """Positions, slice by slice, whose windows of the level's width may be repeated."""
        width = self.widths[level]
        if level == 0:
            return [np.flatnonzero(s.whole(width) & live[: len(s.whole(width))]) for s, live in zip(self.slices, self.live, strict=True)]
        before = self.widths[level - 1]
        good = self.repeats(level - 1)
        out = []
        for s, g in zip(self.slices, good, strict=True):
            ok = s.whole(width)
            # Both halves, which overlap if the width is less than double.
            out.append(np.flatnonzero(ok & g[: len(ok)] & g[width - before :][: len(ok)]))
        return out

    def asked(self, level: int) -> tuple[list[np.ndarray], Asked]:
        at = self.candidates(level)
        none, width = np.empty(0, np.uint64), self.widths[level]
        keys = np.concatenate([none, *(textbytes.windows(s.tokens, width, level + 1)[a] if len(a) else none for s, a in zip(self.slices, at, strict=True))])
        if level < len(self.widths) - 1:
            return at, Asked(keys, self.bits)
        return at, Asked(keys, 64, np.concatenate([none, *(s.check(a, width) for s, a in zip(self.slices, at, strict=True))]))

    def repeats(self, level: int) -> list[np.ndarray]:
        """For every word of each slice, whether the window of the level's width that starts there got a yes."""
        at, asked = self.asked(level)
        bits = asked.answers(self.side, 10 + level)
        out, done = [], 0
        for s, a in zip(self.slices, at, strict=True):
            x = np.zeros(len(s.doc), bool)
            x[a] = bits[done : done + len(a)]
            done += len(a)
            out.append(x)
        return out

    def rows_of(self, at: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([s.row + s.doc[a] for s, a in zip(self.slices, at, strict=True)]) if at else np.empty(0, np.int64)


def _smaller_elsewhere(starts: np.ndarray, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where another packet names the key with a smaller id."""
    return ids > np.minimum.reduceat(ids, starts)[of] if len(of) else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, keep: list[str], width: int = 13, text_col: str = "text", id_col: str = "doc_id", first: int = FIRST) -> DataFrame:
    """The columns in keep and, for every row, n_words long, n_removed long, removed (array of struct start, end: runs of
    removed words) and kept string (the other words, one space apart).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller id, as the input is.
    Level by level, windows of 4, 8, ... words are counted over all documents, and only those found more than once are
    extended to twice the length, so few are left when the full length is reached; where none is, the rest of the levels is
    left out. There, each window learns the smallest id it occurs under. Whole texts that occur several times are asked for once.
    A null text has no words. A null id counts as larger than all others; rows of one id never remove from each other.
    Windows of the full length are told apart by two 64-bit fingerprints made from different ones of their words. Empty tables give no rows.
    """
    widths = levels(width, first)
    parts = Parts(docs, keep, text_col, id_col)
    n_buckets, bits = parts.n_buckets, parts.bits

    for level in range(len(widths)):
        last = level == len(widths) - 1

        def request(part: int, left: pa.Table, side: pa.Table, level: int = level, last: bool = last) -> list[tuple]:
            walk = _Walk(left, side, widths, bits)
            at, asked = walk.asked(level)
            rows = walk.rows_of(at)
            if last:
                low = np.full(len(asked.keys), _NO_ID, np.int64)
                np.minimum.at(low, asked.which, walk.ids[rows])
                return asked.requests(part, 10 + level, n_buckets, low)
            mark = asked.count > 1
            mark[asked.which[walk.seen[rows]]] = True
            return asked.requests(part, 10 + level, n_buckets, mark.astype(np.uint8))

        # A part answers itself about windows that it alone holds, so at the last level only the parts know what is left.
        survivors = parts.ask(10 + level, request, _smaller_elsewhere if last else repeated, "<i8" if last else "u1", checked=last) or last
        if not survivors:
            break

    def finish(left: pa.Table, side: pa.Table) -> pa.Table:
        walk = _Walk(left, side, widths, bits)
        if not survivors:
            return cut(walk, [np.empty(0, np.int64)] * len(walk.slices))
        at, asked = walk.asked(len(widths) - 1)
        rows = walk.rows_of(at)
        low = np.full(len(asked.keys), _NO_ID, np.int64)
        np.minimum.at(low, asked.which, walk.ids[rows])
        gone, done = asked.answers(side, 10 + len(widths) - 1) | (walk.ids[rows] > low[asked.which]), np.cumsum([0, *map(len, at)])
        return cut(walk, [a[gone[d : d + len(a)]] for a, d in zip(at, done[:-1].tolist(), strict=True)])

    def cut(walk: _Walk, hits: list[np.ndarray]) -> pa.Table:
        """The rows of a part without the windows that start at hits, slice by slice."""
        n_words, n_removed, spans, kept = [], [], [], []
        for s, hit in zip(walk.slices, hits, strict=True):
            n = np.bincount(s.doc, minlength=s.n_rows)
            edge = np.bincount(hit, minlength=len(s.doc) + 1) - np.bincount(hit + width, minlength=len(s.doc) + 1)
            removed = np.cumsum(edge)[: len(s.doc)] > 0
            # A copy of a smaller id's text goes whole, if it has a window at all.
            removed |= ((walk.kind[s.row : s.row + s.n_rows] == 3) & (n >= width))[s.doc]
            stay = ~removed
            text, offs = textbytes.join_words(s.buf, s.starts[stay], s.ends[stay], s.doc[stay], s.n_rows)
            kept += [text[x:y].tobytes().decode() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            spans += runs(removed, s.doc, s.n_rows)
            n_words.append(n)
            n_removed.append(np.bincount(s.doc[removed], minlength=s.n_rows))
        none = np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *n_words]), pa.int64()), pa.array(np.concatenate([none, *n_removed]), pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.string())], ["n_words", "n_removed", "removed", "kept"])

    return parts.finish(finish, [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), SPANS_FIELD, T.StructField("kept", T.StringType())])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS_FIELD = T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))


def runs(removed: np.ndarray, doc: np.ndarray, n_docs: int) -> list[list[dict[str, int]]]:
    """Of each document, the maximal runs of removed places, counted from the document's first."""
    out: list[list[dict[str, int]]] = [[] for _ in range(n_docs)]
    if removed.any():
        new = np.concatenate([[True], (doc[1:] != doc[:-1])])
        start = np.flatnonzero(removed & (new | ~np.concatenate([[False], removed[:-1]])))
        last = np.concatenate([new[1:], [True]])
        end = np.flatnonzero(removed & (last | ~np.concatenate([removed[1:], [False]]))) + 1
        head = np.searchsorted(doc, doc[start])
        for d, a, b in zip(doc[start].tolist(), (start - head).tolist(), (end - head).tolist(), strict=True):
            out[d].append({"start": a, "end": b})
    return out


#: DuckDB's version of op6's rows.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
hit AS (SELECT win.r, win.i FROM win JOIN low USING (k) WHERE low.lo < win.doc_id OR (win.doc_id IS NULL AND low.lo IS NOT NULL)),
gone AS (SELECT DISTINCT r, i + o AS p FROM (SELECT r, i, unnest(generate_series(0, 12)) AS o FROM hit)),
words AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM d)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
