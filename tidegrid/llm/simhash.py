"""SimHash near-duplicates by deletion-variant signatures, and near-duplicates by verified similarity of shingles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes
from .common import by_merge, dropped, modest_batches, with_row_key, written
from .components import connected_components

#: Signature groups up to this size are compared pair by pair; the fingerprints of larger ones go by two-wildcard variants.
PAIR_GROUP = 64
#: Words of 64 bits in the long fingerprint of a set of shingles, and the share of pairs at the similarity that its tables may miss.
LONG, MISSED = 16, 0.002
#: The tables by which large groups of copies are brought together before others are compared pair by pair.
FIRST = ((0, 4), (4, 20))
_BLOCK = 1 << 15
_SLICE = 1 << 18


def _shingles(column: pa.ChunkedArray | pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts its first and last, how many shingles each text has, and of every shingle its text and XXH64."""
    buf, offsets = textbytes.flat(column)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for a, b, part, offs in textbytes.slices(buf, offsets, _SLICE):
        starts, ends, doc = textbytes.words(part, offs)
        if not len(starts):
            continue
        # The words of a slice, lower-cased and one space apart, in one run of bytes.
        size = ends - starts
        to = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(int(to[-1]), 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = lower[part[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]]
        n_words = np.bincount(doc, minlength=b - a)
        first_word = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        n = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
        owner = np.repeat(np.arange(b - a), n)
        word = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + first_word[owner]
        last = word + np.minimum(n_words[owner], shingle) - 1
        yield a, b, n, owner, textbytes.xxh64(joined, to[word], to[last] + size[last] - to[word])


def _fingerprints(column: pa.ChunkedArray | pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text, as int64."""
    out = np.zeros(len(column), np.uint64)
    for a, b, n, owner, h in _shingles(column, shingle):
        counts = np.zeros((b - a, 64), np.int64)
        for i in range(0, len(h), _BLOCK):
            bits = np.unpackbits(h[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[i : i + _BLOCK]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            for s, e in zip(heads, [*heads[1:], len(own)], strict=True):
                counts[own[s]] += bits[s:e].sum(axis=0, dtype=np.int32)
        over = counts * 2 > n[:, None]
        out[a:b] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns in keep plus fp long, in one pass without a shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(keep))), pa.array(_fingerprints(x.column(len(keep)), shingle))], [*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _variants(fps: DataFrame) -> DataFrame:
    """64 signatures of each fingerprint: for either half, one for each bit left out."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    bit = F.col("b").cast("int")
    half = F.when(bit < 32, low).otherwise(high)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int"))
    # The half without the bit, with the bit's number above it.
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).select("fp", F.call_function("shiftleft", F.col("b").cast("long"), F.lit(32)).bitwiseOR(half.bitwiseAND(F.bitwise_not(mask))).alias("sig"))


def _two_wildcards(fps: DataFrame) -> DataFrame:
    """2,016 signatures of each fingerprint, one for each pair of bits left out: at most four fingerprints share one.

    pair is 64 times the first bit's number plus the second's; seen has one of four bits set, for the two bits' values.
    """
    schema = "pair int, sig long, seen int"
    i, j = (x.astype(np.uint64) for x in np.triu_indices(64, 1))
    one = np.uint64(1)
    masks, pair = ~((one << i) | (one << j)), (i * np.uint64(64) + j).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = x.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(v), 512):
                w = v[k : k + 512, None]
                seen = one << (((w >> i) & one) + np.uint64(2) * ((w >> j) & one))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(pair, len(w))), pa.array((w & masks).ravel().view(np.int64)), pa.array(seen.astype(np.int32).ravel())], ["pair", "sig", "seen"])

    return fps.mapInArrow(run, schema)


def links(fps: DataFrame, pair_group: int = PAIR_GROUP) -> DataFrame:
    """Pairs a, b of distinct fingerprints that differ in one or two bits; every linked pair is joined at least by a path.

    fps: one column fp long, distinct. Cut into two halves, two fingerprints at distance 2 or less have a half that differs
    in at most one bit, so they share the signature of that half with that bit left out. Signature groups up to
    pair_group are compared pair by pair and verified. The fingerprints of larger groups are looked up by signatures
    that leave out two of 64 bits, which at most four fingerprints share: exact, and in proportion to their number.
    """
    # A row becomes 64, so rows are spread first.
    fps = fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "fp")
    sigs = _variants(fps).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(by_merge(_variants(fps)).join(sigs, "sig"), "signatures")
    fits = rows.where(F.col("n") <= pair_group).select("sig", "fp")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = by_merge(fits.withColumnRenamed("fp", "a")).join(fits.withColumnRenamed("fp", "b"), "sig").where("a < b").where(close).select("a", "b")
    hot = rows.where(F.col("n") > pair_group).select("fp").distinct()
    met = _two_wildcards(hot).groupBy("pair", "sig").agg(F.bit_or("seen").alias("seen")).where(F.bit_count("seen") > 1)
    # All of a group of four link with each other, so links to one of them lose no path.
    one = F.lit(1).cast("long")
    first, second = F.floor(F.col("pair") / 64).cast("int"), F.pmod("pair", F.lit(64)).cast("int")
    member = [F.when(F.col("seen").bitwiseAND(F.lit(1 << v)) != 0, F.col("sig").bitwiseOR(F.call_function("shiftleft", one, first) if v & 1 else F.lit(0)).bitwiseOR(F.call_function("shiftleft", one, second) if v & 2 else F.lit(0))) for v in range(4)]
    fans = met.select(F.coalesce(*member).alias("a"), F.explode(F.array(*member)).alias("b")).where("a <> b")
    out = written(pairs.unionByName(fans).distinct(), "pairs")
    dropped(rows)
    return out


def near_duplicates(docs: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """The columns in keep, fp long, component_id: the smallest id among all rows whose fingerprints are linked, and
    group_fp long: one fingerprint of those, which names the group even where no row has an id.

    Fingerprints link at two or fewer differing bits, and so along chains. A null text counts as empty; without words the
    fingerprint is zero and links like any other. A null id never becomes a component's id unless all its rows lack one.
    Repeated rows and ids keep their rows. An empty table gives no rows. Other columns play no part.
    """
    cols = list(dict.fromkeys([*keep, id_col]))
    rows = written(fingerprints(docs, cols, text_col, shingle), "fingerprints")
    ids = rows.groupBy("fp").agg(F.min(id_col).alias("_id"))
    distinct = written(ids, "distinct")
    found = links(distinct.select("fp"))
    roots = connected_components(found)
    dropped(found)
    placed = by_merge(distinct).join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_id", F.coalesce("root", "fp").alias("_root"))
    smallest = placed.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return by_merge(rows).join(by_merge(placed).join(smallest, "_root").select("fp", "component_id", F.col("_root").alias("group_fp")), "fp").select(*keep, "fp", "component_id", "group_fp")


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, text by text."""
    order = np.lexsort([h, owner])
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _long_fingerprints(column: pa.ChunkedArray | pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text a hash of its set of shingles, the size of the set, and a SimHash of LONG words: a bit is 1 if set in
    over half of the shingles' hashes, every word mixing them anew."""
    node, n, words = np.zeros(len(column), np.uint64), np.zeros(len(column), np.int64), np.zeros((len(column), LONG), np.uint64)
    salt = textbytes.mix64(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = np.uint64(0x0101010101010101)
    for a, _, _, owner, h in _shingles(column, shingle):
        owner, h = _distinct(owner, h)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        at, size = a + owner[heads], np.diff([*heads, len(h)])
        node[at] = textbytes.mix64(np.add.reduceat(textbytes.mix64(h), heads))
        n[at] = size
        # Eight bits are counted at once, in the bytes of a word, so a run of at most 255 shingles at a time.
        runs = -(-size // 255)
        first = np.concatenate([[0], np.cumsum(runs)[:-1]])
        start = np.repeat(heads, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
        bits = np.zeros((len(heads), LONG, 8, 8), bool)
        for k in range(LONG):
            g = textbytes.mix64(h ^ salt[k])
            for j in range(8):
                some = np.add.reduceat((g >> np.uint64(j)) & lanes, start).view(np.uint8).reshape(-1, 8)
                bits[:, k, :, j] = 2 * np.add.reduceat(some, first, axis=0, dtype=np.int64) > size[:, None]
        words[at] = np.packbits(bits.reshape(len(heads), LONG * 64), axis=1, bitorder="little").view("<u8")
    return node.view(np.int64), n, words.view(np.int64)


def _agreeing(similarity: float) -> float:
    """The chance that a bit is the same in the fingerprints of two sets of that Jaccard similarity and equal size, by the angle between them."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _tables(nodes: int, similarity: float) -> np.ndarray:
    """For each table the bits of the long fingerprint that make its key. A key has more bits the more nodes there are, so
    that few unlike ones share it, and there are as many tables as find all but MISSED of the pairs at the similarity."""
    bits = max(16, nodes.bit_length() + 1)
    # A seventh more than independent bits would need: tables share them.
    n = math.ceil(1.15 * math.log(MISSED) / math.log1p(-(_agreeing(similarity) ** bits))) if similarity < 1 else 1
    random = np.random.default_rng(42)
    return np.stack([random.choice(LONG * 64, bits, replace=False) for _ in range(n)])


def _keys(nodes: DataFrame, roots: DataFrame | None, tables: np.ndarray) -> DataFrame:
    """key, node, root: the keys of every node, with its root, null where it has no link yet."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(tables.shape[1], dtype=np.int64)).astype(np.float64)
        for x in batches:
            words = x.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, LONG)
            bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little").astype(np.float64)
            at = np.arange(len(words))
            for i in range(0, len(tables), 16):
                key = np.stack([(bits[:, t] @ weight).astype(np.uint64) + (np.uint64(i + k) << np.uint64(48)) for k, t in enumerate(tables[i : i + 16])], axis=1)
                each = pa.array(np.repeat(at, key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(textbytes.mix64(key.ravel()).view(np.int64)), x.column(0).take(each), x.column(1).take(each)], ["key", "node", "root"])

    placed = nodes.select("node", "words").join(roots, "node", "left") if roots is not None else nodes.select("node", "words", F.lit(None).cast("long").alias("root"))
    spread = placed.select("node", "root", "words").repartition(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "node")
    return spread.mapInArrow(keys, "key long, node long, root long")


def _to_one(rows: DataFrame) -> DataFrame:
    """Pairs a, b of each node and one that shares its key, linked already if any is, unless both lie in one component."""
    pivots = rows.groupBy("key").agg(F.min(F.struct(F.col("root").isNull().alias("z"), "node", "root")).alias("p")).select("key", F.col("p.node").alias("node2"), F.col("p.root").alias("root2"))
    met = by_merge(rows).join(pivots, "key").where("coalesce(root, node) <> coalesce(root2, node2)")
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _crossing(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows, key and node, of keys whose nodes lie in several components, with each node's root, the root top that most
    nodes of the key have, and the number r of nodes that have another."""
    placed = by_merge(rows.select("key", "node")).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # Counted by root before the rows of a key meet.
    each = placed.groupBy("key", "root").agg(F.count("*").alias("k"))
    group = each.groupBy("key").agg(F.max(F.struct("k", "root")).alias("t"), F.sum("k").alias("m"))
    group = group.select("key", F.col("t.root").alias("top"), (F.col("m") - F.col("t.k")).alias("r")).where("r > 0")
    return written(by_merge(placed).join(group, "key"), "crossing")


def _across(fits: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of all nodes that share a key, lie in different components and have close fingerprints: at most r a row."""
    fits = by_merge(fits).join(nodes.select("node", F.col("words")[0].alias("s"), F.col("words")[1].alias("t")), "node")
    other = fits.where("root <> top").select("key", "node", "root", "s", "t")
    every = fits.select("key", "top", *(F.col(c).alias(f"{c}2") for c in ("node", "root", "s", "t")))
    met = by_merge(other).join(every, "key").where("root <> root2 AND (root2 = top OR node < node2)").where(_close("s", "t", "s2", "t2", similarity))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _to_pivots(hot: DataFrame) -> DataFrame:
    """Pairs a, b of each node with four of those that share its key and lie in another component: the one that shares keys
    with most others (a copied original shares more than its copies do), and three at random."""
    weight = hot.groupBy("node").agg(F.sum("r").alias("w"))
    by = [F.struct("w", "node"), *(F.struct(F.xxhash64(F.lit(i), "node").alias("w"), "node") for i in range(3))]
    pivots = by_merge(hot).join(weight, "node").groupBy("key").agg(F.array_distinct(F.array(*(F.max_by(F.struct("node", "root"), x) for x in by))).alias("p"))
    pivots = pivots.select("key", F.explode("p").alias("p")).select("key", F.col("p.node").alias("node2"), F.col("p.root").alias("root2"))
    return by_merge(hot).join(pivots, "key").where("root <> root2").select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def _close(s: str, t: str, s2: str, t2: str, similarity: float) -> Column:
    """Whether two words of two fingerprints are near enough for the similarity.

    128 bits tell most unlike pairs: the distance of pairs at the similarity lies four deviations or more below the bound.
    """
    p = _agreeing(similarity)
    bound = 128 * (1 - p) + 4.5 * math.sqrt(128 * p * (1 - p))
    return F.bit_count(F.col(s).bitwiseXOR(F.col(s2))) + F.bit_count(F.col(t).bitwiseXOR(F.col(t2))) <= F.lit(bound)


def _candidates(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those pairs, once each, whose sizes allow the similarity and whose fingerprints are not far apart."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("words")[0].alias(f"s{c}"), F.col("words")[1].alias(f"t{c}"))
    both = by_merge(by_merge(pairs.distinct()).join(of("a"), "a")).join(of("b"), "b")
    near = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9
    return written(both.where(near & _close("sa", "ta", "sb", "tb", similarity)).select("a", "b"), "candidates")


def _linked(nodes: DataFrame, similarity: float, pair_group: int, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Root of every node that has a link, by the links among pairs that share a key of a table.

    verified: gives those of some candidates a, b that are links. Nodes known to lie in one component are no pair any more,
    so pairs and links stay in proportion to rows, however large a group of copies is. By FIRST of the tables, a few at a
    time, every node meets one that shares its key. Then by all tables all nodes of different components meet that share
    a key with at most pair_group. In larger groups each meets four pivots, and the key is looked at again: where at most
    pair_group lie outside its largest component, they meet all; where more do, it is split by 16 more bits, twice.
    """
    nodes = nodes.where("n > 0")
    tables = _tables(nodes.count(), similarity)
    roots = None

    def joined(pairs: DataFrame) -> DataFrame:
        found = verified(_candidates(pairs, nodes, similarity))
        if roots is not None and found.isEmpty():
            return roots
        out = connected_components(found if roots is None else found.unionByName(roots.toDF("a", "b")))
        dropped(found)
        return out

    def crossing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        cross = _crossing(rows, roots)
        scratch.append(cross)
        return cross.where(F.col("r") <= pair_group), cross.where(F.col("r") > pair_group)

    for lo, hi in FIRST:
        roots = joined(_to_one(_keys(nodes, roots, tables[lo:hi]))) if lo < len(tables) else roots
    keys = _keys(nodes, roots, tables)
    met = written(by_merge(keys).join(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), "keys")
    few = met.where(F.col("m") <= pair_group).select("key", "node", "root")
    pairs = by_merge(few).join(few.select("key", F.col("node").alias("node2"), F.col("root").alias("root2")), "key")
    pairs = pairs.where("node < node2 AND coalesce(root, node) <> coalesce(root2, node2)").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    scratch = []
    fits, hot = crossing(met.where(F.col("m") > pair_group))
    hot = fits.unionByName(hot)
    for step in range(4):
        settled = hot.isEmpty()
        if not settled and step < 3:
            if step:
                part = F.get("words", F.pmod(F.col("key") + step, F.lit(LONG)).cast("int")).bitwiseAND(F.lit(0xFFFF))
                finer = by_merge(hot).join(nodes.select("node", "words"), "node").select(F.xxhash64("key", part).alias("key"), "node")
                fits, hot = crossing(finer)
                pairs = pairs.unionByName(_across(fits, nodes, similarity))
            pairs = pairs.unionByName(_to_pivots(hot))
        roots = joined(pairs)
        if not step:
            dropped(met)
        if settled or step == 3:
            break
        done = len(scratch)
        fits, hot = crossing(hot)
        dropped(*scratch[:done])
        del scratch[:done]
        pairs = _across(fits, nodes, similarity)
    dropped(*scratch)
    return roots


def similar(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, pair_group: int = PAIR_GROUP) -> DataFrame:
    """_rk_file, _rk_row, the id and group_fp long: which rows of docs, which has the row key, are near-duplicates.

    Two texts link if the Jaccard similarity of their sets of lower-cased shingles is at least so much, and so along
    chains. Candidates come from long SimHash fingerprints of the sets: those that agree in all bits of the key of some
    table, which all but MISSED of the pairs at that similarity do. Each is verified on the whole sets, unless earlier
    links join its two texts already. Texts without words are one group.
    """
    keys = ["_rk_file", "_rk_row", id_col]
    modest_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in keys] + [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            node, n, words = _long_fingerprints(x.column(3), shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * LONG), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(3)), pa.array(node), pa.array(n), lists], [*keys, "node", "n", "words"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = [b""] * x.num_rows
            for a, b, _, owner, h in _shingles(x.column(1), shingle):
                owner, h = _distinct(owner, h)
                edge = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(b - a):
                    out[a + i] = h[edge[i] : edge[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(out, pa.binary())], ["node", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                p, q = (np.frombuffer(y.as_buffer(), np.uint64) for y in (p, q))
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = written(docs.select(*keys, F.col(text_col).alias("_text")).mapInArrow(fingerprinted, schema), "fingerprints")
    # The first row of a set stands for it.
    nodes = written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.min(F.struct("_rk_file", "_rk_row")).alias("at")), "nodes")

    def linking(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", F.col("at._rk_file").alias("_rk_file"), F.col("at._rk_row").alias("_rk_row"))
        texts = docs.select("_rk_file", "_rk_row", F.col(text_col).alias("_text")).join(asked, ["_rk_file", "_rk_row"]).select("node", "_text")
        have = written(texts.mapInArrow(sets, "node long, shingles binary"), "shingles")
        both = pairs.join(have.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a").join(have.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
        found = written(both.select("a", "b", "p", "q").mapInArrow(verified, "a long, b long"), "similar")
        dropped(have, pairs)
        return found

    roots = _linked(nodes, similarity, pair_group, linking)
    return rows.join(roots, "node", "left").select(*keys, F.coalesce("root", "node").alias("group_fp"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id (nulls last), of repeated ids the first row.

    With a similarity, groups are those of similar(); without, those of near_duplicates().
    """
    keyed = with_row_key(docs)
    found = near_duplicates(keyed, ["_rk_file", "_rk_row", id_col], text_col, id_col, shingle) if similarity is None else similar(keyed, text_col, id_col, shingle, similarity)
    order = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_rk_file").alias("f"), F.col("_rk_row").alias("r"))
    kept = found.groupBy("group_fp").agg(F.min(order).alias("o")).select("o.f", "o.r")
    return keyed.join(kept, (keyed["_rk_file"] == kept["f"]) & (keyed["_rk_row"] == kept["r"]), "left_semi").drop("_rk_file", "_rk_row")
