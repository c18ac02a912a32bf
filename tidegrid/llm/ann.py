"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Orderings, dimensions that each projects to, bits of each, and neighbours in each ordering on either side of a query.
CURVES = 24
DIMS = 6
BITS = 8
REACH = 800
#: Points at which REACH finds 0.9585 of the 20 nearest; with more, it grows in proportion.
REACH_POINTS = 51_282
SEED = 7
#: Bands of length: each holds vectors of half its longest to its longest, the last one all that are shorter.
BANDS = 31
#: Places in a block at most, and queries that meet one at a time at most: what one task holds doesn't grow.
BLOCK = 4096
QUERIES = 16_384
#: Scores held at a time while a block is searched.
_SCORES = 1 << 22


def reach_for(points: int) -> int:
    """Neighbours on either side for so many points: on vectors without structure, a fixed number would lose most of them."""
    return max(REACH, -(-REACH * points // REACH_POINTS))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of integer coordinates below 2**bits (Skilling, 2004)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Projection:
    """The same random directions, shift and grid for every row. A vector is first lengthened by one component that
    brings it to the longest length in its band, and a query by zero: then the largest inner product is the nearest point."""

    def __init__(self, dim: int, curves: int, dims: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.curves, self.dims, self.bits = curves, dims, bits
        self.directions = rng.standard_normal((dim + 1, curves * dims)) / np.sqrt(dim + 1)
        self.shift = rng.random(curves * dims)

    def keys(self, vectors: np.ndarray, longest: np.ndarray | None = None) -> np.ndarray:
        """One key a curve for each row; longest: of each row's band, none for queries, of which only the direction matters."""
        if longest is None:
            scaled, extra = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300), np.zeros(len(vectors))
        else:
            scaled = vectors / longest[:, None]
            extra = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        y = np.column_stack([scaled, extra]) @ self.directions * np.sqrt(self.directions.shape[0])
        # Projections of points of the unit ball lie within a few standard deviations of 0; cells are quantiles of those.
        cell = np.clip(((np.clip(y, -3, 3) + 3) / 6 * 0.5 + self.shift * 0.5) * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return np.stack([hilbert(cell[:, c * self.dims : (c + 1) * self.dims], self.bits) for c in range(self.curves)], axis=1)


def _length(v: Column) -> Column:
    """The Euclidean length, also where squares would leave the range of numbers."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") / most) * (x.cast("double") / most)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, reach: int | None = None, seed: int = SEED) -> DataFrame:
    """For each query row its k nearest other rows by inner product: query_id long, rank int, vec_id long, score double.

    Equal vectors are one point: they are indexed and searched once, and each stands for its k + 1 smallest ids, so that
    however many copies a vector has, no window fills up with them. Points are parted into bands by their length, so that a few
    long ones don't press the rest together. Every point gets a place on each of several Hilbert curves of its band, through
    shifted random projections; where two reaches hold the whole band, one curve will do. For each curve the points are
    range-partitioned and ranked, and every query is compared, band by band, with all points of the blocks of its order that
    reach at least `reach` places to both sides of its own, in double precision on the original vectors. The best of all
    curves and bands are merged. Work is in proportion to queries times curves times reach; reach is that of reach_for()
    where none is given, and so grows with the points of a band. A task holds a block of bounded size and a bounded share of
    the queries that it meets.

    Rows whose id or vector is null, whose vector is all zeros or holds a null or non-finite component, or has another
    length than most have take no part. Repeated ids are rows of their own, except that a row never finds rows of its own
    id. Ties go to the smaller id. An empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    # Single-precision input travels as such; every product is taken in double precision.
    number = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"), is_query.alias("q"))
    fit = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = plain.where(fit)
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not length:
        return empty
    dim = length[0].n
    good = written(good.where(F.size("v") == dim).select("id", "v", F.coalesce("q", F.lit(False)).alias("q"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    # The smallest ids of each point, with no more than k + 1 in any state.
    ids = good.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("size", _length(F.col("v")))
    few = _smallest_ids(good, k + 1)
    points = written(ids, "points")
    longest = points.agg(F.max("size")).first()[0]
    band = F.least(F.floor(F.log2(F.lit(longest) / F.col("size"))), F.lit(BANDS - 1)).cast("int")
    points = points.withColumn("band", F.greatest(band, F.lit(0)))
    found = points.groupBy("band").agg(F.count("*").alias("n"), F.count_if("q").alias("asked"), F.max("size").alias("top")).collect()  # at most BANDS rows
    have, n_asked = {r.band: r.n for r in found}, sum(r.asked for r in found)
    tops = np.zeros(BANDS)
    tops[[r.band for r in found]] = [r.top for r in found]
    reaches = {b: reach or reach_for(n) for b, n in have.items()}
    lines = {b: 1 if n <= 2 * reaches[b] else curves for b, n in have.items()}
    shared = spark.sparkContext.broadcast(Projection(dim, curves, dims, bits, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "key", "h1", "h2", "v", "q"]
        for x in batches:
            m = _matrix(x.column(2))
            if not len(m):
                continue
            of = x.column(4).to_numpy(zero_copy_only=False)
            key = shared.value.keys(m, tops[of])
            asking = np.flatnonzero(x.column(3).to_numpy(zero_copy_only=False).astype(bool))
            ask = shared.value.keys(m[asking])
            for b, n_lines in lines.items():
                for rows, keys, q in ((np.flatnonzero(of == b), key, False), (asking, ask, True)):
                    if not len(rows):
                        continue
                    pick = pa.array(rows)
                    own = [x.column(i).take(pick) for i in range(3)]
                    for c in range(n_lines):
                        k = keys[:, c] if q else keys[rows, c]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b * curves + c, np.int32)), pa.array(k.astype(np.int64)), *own, pa.array(np.full(len(rows), q))], names)

    placed = points.select("h1", "h2", "v", "q", "band").mapInArrow(place, f"c int, key long, h1 long, h2 long, v array<{number}>, q boolean")
    # Places in order: rows in ranges of (curve, key), counted range by range; only the counts of ranges meet.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = placed.repartitionByRange(tasks, "c", "key", "h1").sortWithinPartitions("c", "key", "h1").withColumn("at", F.monotonically_increasing_id())
    ordered = written(ranged, "ordered").withColumn("range", F.shiftright("at", 33).cast("int"))
    counts = ordered.groupBy("c", "range").agg(F.count_if(~F.col("q")).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = W.partitionBy("c", "range").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    # A query's place is that of the points before it.
    spot = ordered.join(before, ["c", "range"]).withColumn("pos", F.col("before") + F.count_if(~F.col("q")).over(inside) - F.when(F.col("q"), 0).otherwise(1))
    # Blocks of at most BLOCK places; a query goes to its own block and to those within reach of it, a point to one. Where very many
    # queries meet a block, they come in parts, and the block's points to each part.
    size = {b: min(r, BLOCK) for b, r in reaches.items()}
    sides = {b: -(-reaches[b] // size[b]) for b in have}
    parts = {b: max(1, -(-n_asked * (2 * sides[b] + 1) * size[b] // (have[b] * QUERIES))) for b in have}

    def of_band(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.floor(F.col("c") / curves).cast("int"))

    home, side, part = F.floor(F.col("pos") / of_band(size)), of_band(sides), of_band(parts)
    near = F.transform(F.sequence(home - side, home + side), lambda x: F.struct(x.alias("block"), F.pmod(F.xxhash64("h1", "h2"), part).alias("part")))
    at_home = F.transform(F.sequence(F.lit(0).cast("long"), (part - 1).cast("long")), lambda x: F.struct(home.alias("block"), x.alias("part")))
    blocks = spot.withColumn("b", F.explode(F.when(F.col("q"), near).otherwise(at_home))).select("c", F.col("b.block").alias("block"), F.col("b.part").alias("part"), "q", "h1", "h2", "v")

    def rerank(table: pa.Table) -> pa.Table:
        q = table["q"].to_numpy()
        names = ["q1", "q2", "h1", "h2", "score"]
        if not q.any() or q.all():
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())], names)
        m = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
        mine, rest = np.flatnonzero(q), np.flatnonzero(~q)
        out = [[], [], []]
        take = min(k + 1, len(rest))
        step = max(1, min(256, _SCORES // len(rest)))
        for s in range(0, len(mine), step):
            score = m[mine[s : s + step]] @ m[rest].T
            if take < len(rest):
                # Everything that ties with the last one kept stays in, up to which of them the merge decides.
                cut = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                a, b = np.nonzero(score >= cut[:, None] - 1e-12)
            else:
                a, b = np.nonzero(np.ones_like(score, bool))
            out[0].append(mine[s + a])
            out[1].append(rest[b])
            out[2].append(score[a, b])
        a, b, score = (np.concatenate(x) for x in out)
        return pa.table([pa.array(h1[a]), pa.array(h2[a]), pa.array(h1[b]), pa.array(h2[b]), pa.array(score)], names)

    found = blocks.groupBy("c", "block", "part").applyInArrow(rerank, "q1 long, q2 long, h1 long, h2 long, score double")
    # One row a pair, though several curves found it; sums in another order may differ in the last bit.
    pairs = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"))
    few = written(few, "ids")
    best = pairs.join(few.select("h1", "h2", F.element_at("ids", 1).alias("low")), ["h1", "h2"])
    best = best.withColumn("r", F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "low"))).where(F.col("r") <= k + 1)
    queries = good.where("q").select("id", F.col("h1").alias("q1"), F.col("h2").alias("q2")).dropDuplicates(["id", "q1", "q2"])
    met = queries.join(best, ["q1", "q2"]).join(few, ["h1", "h2"])
    rows = met.select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest_ids(good: DataFrame, n: int) -> DataFrame:
    """h1, h2, ids: the n smallest distinct ids of each point, first split by a hash of the id so that no task holds many."""
    per = W.partitionBy("h1", "h2", "s").orderBy("id")
    split = good.select("h1", "h2", "id").distinct().withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64)))
    small = split.withColumn("r", F.row_number().over(per)).where(F.col("r") <= n)
    return small.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids"))
