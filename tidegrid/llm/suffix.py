"""Suffix-array dedup by difference-cover blockwise construction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes
from .rounds import Asked, Parts, copies, repeated
from .substring import SPANS, SPANS_FIELD, runs

COVER, SUFFIXES = 10, 11
#: Blocks of suffixes, by what they begin with; one is sorted at a time, so that only its keys are on the disks.
BLOCKS = 2


@cache
def difference_cover(order: int) -> tuple[int, np.ndarray]:
    """Period v = q*q + q + 1 and q + 1 places of it, for a prime q, such that any two places of the period, each moved on
    by the same number below v, both fall on chosen ones (Singer, 1938).

    The places are the powers of x, modulo a cubic over the integers mod q, that have no square term.
    """
    q = order
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, places = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        places.append(i)
                    x = ((c * x[2]) % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(places) == q + 1 and len({(s - t) % v for s in places for t in places}) == v:
                    return v, np.array(places)
    raise ValueError(f"no cover for {order}")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The sparsest cover whose period is at most two thirds of the length, so that a third of it is left to compare."""
    fits = [q for q in (11, 7, 5, 3, 2) if 3 * (q * q + q + 1) <= 2 * length]
    return difference_cover(fits[0]) if fits else (1, np.array([0]))


class _Walk:
    """The suffixes of a part that are still in question."""

    def __init__(self, left: pa.Table, side: pa.Table, length: int, bits: int) -> None:
        self.side, self.length, self.bits = side, length, bits
        self.period, places = cover_for(length)
        self.chosen = np.zeros(self.period, bool)
        self.chosen[places] = True
        self.buf, self.offsets = textbytes.flat(left["_text"])
        self.kind = copies(left, side)
        # All copies of a text but the first would only say again what that says.
        self.live = self.kind <= 1
        self.cuts = [(a, b, part, offs, np.repeat(np.arange(b - a), np.diff(offs))) for a, b, part, offs in textbytes.slices(self.buf, self.offsets)]

    def _starts(self, a: int, offs: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
        """Places of a slice where a string of the length starts that stays in its document."""
        at = np.arange(max(0, len(doc) - length + 1))
        return at[(doc[: len(at)] == doc[length - 1 :][: len(at)]) & self.live[a + doc[: len(at)]]]

    def samples(self) -> tuple[list[np.ndarray], Asked, np.ndarray]:
        """Cover samples, slice by slice; the fingerprints of what every repeated string has to repeat from there on; their rows."""
        length, places, keys, rows = self.length - self.period + 1, [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for a, _, part, offs, doc in self.cuts:
            at = self._starts(a, offs, doc, length)
            at = at[self.chosen[(at - offs[doc[at]]) % self.period]] if len(at) else at
            places.append(at)
            keys.append(textbytes.Prefix(part).fixed(at, length) if len(at) else keys[0])
            rows.append(a + doc[at])
        return places, Asked(np.concatenate(keys), self.bits), np.concatenate(rows)

    def suffixes(self, blocks: range) -> Iterator[tuple[list[np.ndarray], Asked, np.ndarray]]:
        """Block by block, suffixes with a cover sample in their first period that has an equal one elsewhere: their places,
        slice by slice; two fingerprints of their first `length` bytes; their rows."""
        sampled, asked, _ = self.samples()
        equal = asked.answers(self.side, COVER)
        del asked
        found, done = [], 0
        for (a, _, part, offs, doc), at in zip(self.cuts, sampled, strict=True):
            met = np.zeros(len(doc) + self.period + 1, np.int32)
            met[at + 1] = equal[done : done + len(at)]
            done += len(at)
            np.cumsum(met, out=met)
            start = self._starts(a, offs, doc, self.length)
            start = start[met[start + self.period] > met[start]]
            key = textbytes.span_hash(part, start, self.length) if len(start) else np.empty(0, np.uint64)
            if len(blocks) < BLOCKS:
                start, key = (x[key % np.uint64(BLOCKS) == blocks[0]] for x in (start, key))
            found.append((start, key, textbytes.Prefix(part).fixed(start, self.length) if len(start) else key, a + doc[start]))
        for block in blocks:
            mine = found if len(blocks) < BLOCKS else [tuple(x[f[1] % np.uint64(BLOCKS) == block] for x in f) for f in found]
            none = np.empty(0, np.uint64)
            yield [f[0] for f in mine], Asked(np.concatenate([none, *(f[1] for f in mine)]), 64, np.concatenate([none, *(f[2] for f in mine)])), np.concatenate([np.empty(0, np.int64), *(f[3] for f in mine)])


def _marked(asked: Asked, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Keys that a part knows to be repeated: it holds two, or the text they are from has copies."""
    mark = asked.count > 1
    mark[asked.which[kind[rows] == 1]] = True
    return mark.astype(np.uint8)


def remove_repeats(docs: DataFrame, keep: list[str], length: int = 200, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The columns in keep and, for every row, n_bytes long, n_removed long, removed (array of struct start, end: maximal runs
    of removed bytes) and kept binary (the other bytes of the UTF-8 text).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in another text or in the same.
    Suffixes are ordered by fingerprints of what they begin with, which brings equal beginnings together as the
    alphabet would. First the suffixes at a difference cover's places (12 of every 133) are ranked: each learns whether
    its first length - period + 1 bytes are equal to another sample's. Any two suffixes reach such places after one and the
    same number of bytes, less than a period; if the suffixes tie over the length, those two samples rank alike. So a
    suffix whose first period holds no sample that ranks with another is settled: it ties with none. The rest are sorted
    block by block, in buckets of bounded memory each. Ties are told apart by two 64-bit fingerprints of the whole
    length, made in different ways, and whole texts that occur several times by MD5 and length: these go wholly
    (if they have `length` bytes) and are sorted once.
    A null text is empty. Ids and other columns play no part. Empty tables give no rows.
    """
    parts = Parts(docs, keep, text_col, id_col)
    n_buckets, bits = parts.n_buckets, parts.bits

    def rank(part: int, left: pa.Table, side: pa.Table) -> list[tuple]:
        walk = _Walk(left, side, length, bits)
        _, asked, rows = walk.samples()
        return asked.requests(part, COVER, n_buckets, _marked(asked, rows, walk.kind))

    if parts.ask(COVER, rank, repeated, "u1"):
        for block in range(BLOCKS):

            def sort(part: int, left: pa.Table, side: pa.Table, block: int = block) -> list[tuple]:
                walk = _Walk(left, side, length, bits)
                _, asked, rows = next(walk.suffixes(range(block, block + 1)))
                return asked.requests(part, SUFFIXES + block, n_buckets, _marked(asked, rows, walk.kind))

            parts.ask(SUFFIXES + block, sort, repeated, "u1", checked=True)

    def finish(left: pa.Table, side: pa.Table) -> pa.Table:
        walk = _Walk(left, side, length, bits)
        hits: list[list[np.ndarray]] = [[] for _ in walk.cuts]
        for block, (places, asked, _) in enumerate(walk.suffixes(range(BLOCKS))):
            again, done = asked.answers(side, SUFFIXES + block), 0
            for own, at in zip(hits, places, strict=True):
                own.append(at[again[done : done + len(at)]])
                done += len(at)
        n_removed, spans, kept = [np.empty(0, np.int64)], [], []
        size = np.diff(walk.offsets)
        whole = (walk.kind > 0) & (size >= length)
        for (a, b, part, _, doc), own in zip(walk.cuts, hits, strict=True):
            hit = np.concatenate(own)
            edge = np.zeros(len(doc) + 1, np.int32)
            edge[hit] += 1
            edge[hit + length] -= 1
            removed = (np.cumsum(edge)[: len(doc)] > 0) | whole[a:b][doc]
            spans += runs(removed, doc, b - a)
            left_over, owner = part[~removed], doc[~removed]
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            kept += [left_over[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n_removed.append(np.bincount(doc[removed], minlength=b - a))
        return pa.table([pa.array(size, pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "removed", "kept"])

    return parts.finish(finish, [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), SPANS_FIELD, T.StructField("kept", T.BinaryType())])


#: DuckDB's version of op5's rows; bytes are pairs of hex digits there.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(generate_series(0, n - 200)) AS i FROM d)),
hit AS (SELECT r, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
isl AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit)),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM isl GROUP BY r, g),
per AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
pieces AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS t FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
