"""Vectorised work on UTF-8 text: words, fingerprints of words and of spans, and XXH64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text is taken in slices of whole documents of about so many bytes, to stay in the processor's cache.
SLICE = 1 << 19


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _splitmix(256, 0x5EED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE + (SLICE >> 1))
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(buf: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document, bytes and offsets of each slice."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, strip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and 09 to 0D, and its document; a run never crosses documents.

    strip: leading and trailing ASCII punctuation is left out, unless nothing would be left.
    """
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out = ~_SPACE[buf]
    before = np.empty(len(out), bool)
    before[0], before[1:] = False, out[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(buf)]
    before[edge] = False
    starts = np.flatnonzero(out & ~before)
    after = np.empty(len(out), bool)
    after[-1], after[:-1] = False, out[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(out & ~after) + 1
    if strip and len(starts):
        s, e = starts.copy(), ends.copy()
        todo = np.arange(len(s))
        while len(todo := todo[(e[todo] > s[todo]) & _PUNCT[buf[np.maximum(e[todo] - 1, 0)]]]):
            e[todo] -= 1
        todo = np.arange(len(s))
        while len(todo := todo[(e[todo] > s[todo]) & _PUNCT[buf[np.minimum(s[todo], len(buf) - 1)]]]):
            s[todo] += 1
        bare = e > s
        starts, ends = np.where(bare, s, starts), np.where(bare, e, ends)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; past the end they are zero."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value of two: multiplications and shifts by turns, so that no sum over the places of a text is left to play with."""
    x = a * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(29)
    return x


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A fingerprint of each span, for spans as short as words are; different words of up to 8 bytes and one length never share one.

    lower: as if A-Z were a-z. Other seeds give fingerprints of their own.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    buf = _LOWER[buf] if lower else buf
    eight, size = _eight(buf), ends - starts
    h = _fold(mix64(size.astype(np.uint64) + np.uint64(1 + (seed << 32))), eight[starts] & _MASKS[np.minimum(size, 8)])
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < 64:
        h[more] = _fold(h[more], eight[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)])
        k += 8
        more = more[size[more] > k]
    if len(more):
        rest = [xxhash.xxh3_64_intdigest(buf[s + 64 : e].tobytes(), seed=seed) for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True)]
        h[more] = _fold(h[more], np.array(rest, np.uint64))
    return mix64(h)


def span_hash(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A fingerprint of each span of one length, by doubling from eight bytes on."""
    x = mix64(_eight(buf)[: len(buf)] & _MASKS[min(length, 8)])
    have = min(length, 8)
    while have < length:
        step = min(have, length - have)
        x = _fold(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return mix64(x[starts]) if len(starts) else np.empty(0, np.uint64)


class Prefix:
    """Fingerprints of spans of one length from one running sum, modulo 2**64. Equal bytes give equal values in every slice, but
    different ones may be made to collide, so a yes by these alone proves nothing."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _powers(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        x = _BYTE[buf]
        x *= up[:-1]
        np.cumsum(x, out=self.sum[1:])

    def fixed(self, starts: np.ndarray, length: int) -> np.ndarray:
        x = self.sum[starts + length] - self.sum[starts]
        x *= self.down[starts]
        return mix64(x)


def windows(tokens: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A fingerprint of each run of width values, by doubling; position i holds that of tokens[i : i + width]."""
    if len(tokens) < width:
        return np.empty(0, np.uint64)
    x, have = mix64(tokens ^ np.uint64(seed)), 1
    while have < width:
        step = min(have, width - have)
        x = mix64(x[:-step] * np.uint64(0xA24BAED4963EE407) + x[step:] + np.uint64(have * 2 + 1))
        have += step
    return x


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of buf."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    s, at = np.uint64(seed), starts.astype(np.int64)
    h = np.full(len(starts), s + _P5, np.uint64)
    stripes = lengths >> 5
    if len(stripes) and (top := int(stripes.max())):
        long = np.flatnonzero(stripes)
        acc = [np.full(len(long), x, np.uint64) for x in ((seed + int(_P1) + int(_P2)) & _M64, (seed + int(_P2)) & _M64, seed, (seed - int(_P1)) & _M64)]
        for k in range(top):
            live = np.flatnonzero(stripes[long] > k)
            base = at[long[live]] + 32 * k
            for j in range(4):
                acc[j][live] = _rotl(acc[j][live] + eight[base + 8 * j] * _P2, 31) * _P1
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            x = (x ^ (_rotl(a * _P2, 31) * _P1)) * _P1 + _P4
        h[long] = x
    h += lengths.astype(np.uint64)
    at = at + (stripes << 5)
    rest = lengths & 31
    for k in range(3):
        live = np.flatnonzero((rest >> 3) > k)
        if len(live):
            x = h[live] ^ (_rotl(eight[at[live] + 8 * k] * _P2, 31) * _P1)
            h[live] = _rotl(x, 27) * _P1 + _P4
    at = at + (rest & ~7)
    live = np.flatnonzero(rest & 4)
    if len(live):
        h[live] = _rotl(h[live] ^ (four[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at = at + (rest & 4)
    for k in range(3):
        live = np.flatnonzero((rest & 3) > k)
        if len(live):
            h[live] = _rotl(h[live] ^ (padded[at[live] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each document one space apart: bytes, and n_docs + 1 offsets."""
    size = ends - starts
    step = size + 1
    to = np.cumsum(step) - step
    total = int(step.sum())
    out = np.full(total, 32, np.uint8)
    if total:
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        out[to[word] + at] = buf[starts[word] + at]
    per = np.bincount(doc, step, n_docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(per - 1, 0))])
    if total:
        keep = np.ones(total, bool)
        keep[np.cumsum(per)[per > 0] - 1] = False  # no space after a document's last word
        out = out[keep]
    return out, offsets
