"""Rounds of questions about all texts at once, asked in packed form.

Texts are dealt by a hash of their row into many small parts. In each round every part turns its candidates into sorted
64-bit keys and sends them, packed to a few bytes a key, to the buckets that own the ranges of key. A bucket sees all
keys of its range, and nothing else, at once; it answers each packet with one bit a key. Parts and buckets are small
whatever single keys do: a part names a key once, however often it holds it. Between rounds the answers are a table in
the shared folder, so a lost executor costs the round at hand at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKET, dealt, layout, modest_batches, packed_requests, packets, part_of, shuffles_released, text_bytes, unpack_sorted, with_row_key, written

_SIDE = PACKET + ", fk long, rk long"
#: Buckets that the parts lie in, at most, and among how many tasks the rows of one text are spread.
_MOST_BUCKETS = 50_000
_SALTS = 16


def in_order(keys: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, those of one key by check, and where each run of equal ones starts in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    if check is not None and len(k):
        c = check[order]
        other = ~new[1:] & (c[1:] != c[:-1])
        if other.any():
            order = np.lexsort([check, keys])
            k, c = keys[order], check[order]
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new)


class Asked:
    """Distinct keys that a part asks about, in order, and which of them each candidate has.

    bits: how much of each key is sent. Where a false yes only costs another round's work, fewer will do.
    check: a second fingerprint of each candidate, made in another way; keys are the same only if both agree.
    """

    def __init__(self, keys: np.ndarray, bits: int = 64, check: np.ndarray | None = None) -> None:
        self.bits = bits
        if bits < 64:
            keys = keys >> np.uint64(64 - bits)
        order, starts = in_order(keys, check)
        self.keys, self.check = keys[order[starts]], None if check is None else check[order[starts]]
        self.count = np.diff(np.append(starts, len(keys)))
        self.which = np.empty(len(keys), np.int64)
        self.which[order] = np.repeat(np.arange(len(starts)), self.count)

    def requests(self, part: int, level: int, n_buckets: int, extra: np.ndarray) -> list[tuple]:
        """extra: what goes with each key, beside its check."""
        if self.check is not None:
            extra = np.rec.fromarrays([extra, self.check], dtype=np.dtype([("own", extra.dtype), ("check", "<u8")]))
        return packed_requests(part, level, self.keys, n_buckets, extra, self.bits)

    def answers(self, side: pa.Table, level: int) -> np.ndarray:
        """The bit of every candidate."""
        mine = side.filter(pc.equal(side["level"], level)).sort_by("bucket")
        bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for n, d in zip(mine["n"].to_pylist(), mine["data"].to_pylist(), strict=True)]
        bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        return bits[self.which]


#: Of a bucket: where runs of equal keys start, the run of each key, and what came with each key, in order; gives a bit each.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def answer_bits(judge: Judge, own_type: str, checked: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket's function: it sorts all keys of its packets and answers each packet with a bit a key."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        keys = np.concatenate([unpack_sorted(d, k) for d, k in zip(table["data"].to_pylist(), n.tolist(), strict=True)])
        extra = np.concatenate([np.frombuffer(e, np.dtype([("own", own_type), ("check", "<u8")]) if checked else own_type) for e in table["extra"].to_pylist()])
        own, check = (extra["own"], extra["check"]) if checked else (extra, None)
        order, starts = in_order(keys, check)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        bits = np.empty(len(keys), bool)
        bits[order] = judge(starts, of, own[order])
        ends = np.cumsum(n)
        return packets([(p, b, level, k, np.packbits(bits[e - k : e]).tobytes(), b"y" if bits[e - k : e].any() else None) for p, b, level, k, e in zip(table["part"].to_pylist(), table["bucket"].to_pylist(), table["level"].to_pylist(), n.tolist(), ends.tolist(), strict=True)])

    return run


def repeated(starts: np.ndarray, of: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """True for keys of two packets, or that one packet has marked."""
    many = np.diff(np.append(starts, len(of))) > 1
    return (many | (np.maximum.reduceat(mark, starts) > 0))[of] if len(of) else np.zeros(0, bool)


class Parts:
    """docs dealt into parts, with what is known of rows whose whole text occurs more than once."""

    def __init__(self, docs: DataFrame, keep: list[str], text_col: str, id_col: str) -> None:
        self.spark, self.keep = docs.sparkSession, keep
        modest_batches(self.spark)
        size = text_bytes(docs, text_col)
        n_parts, self.n_buckets = layout(size)
        # Enough bits that about one in a thousand keys or fewer meets another by chance.
        self.bits = min(64, max(32, int(size).bit_length() + 10))
        keyed = with_row_key(docs.select(*dict.fromkeys([*keep, id_col, text_col])), "fk", "rk")
        # Whole texts cross the network here and never again: every round reads the parts as they lie.
        texts = keyed.select(part_of(n_parts, F.col("fk"), F.col("rk")).alias("part"), "fk", "rk", F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
        self.texts = dealt(texts, "part", min(n_parts, _MOST_BUCKETS), "parts")
        self.types = [docs.schema[c] for c in keep]
        # n: copies of the text; whether this row comes first among them is up to the caller's order.
        light = written(self.texts.select("part", "fk", "rk", "_id", F.unhex(F.md5(F.coalesce("_text", F.lit("")))).alias("m"), F.octet_length("_text").alias("b")), "digests")
        same = light.groupBy("m", "b").agg(F.count("*").alias("c"), F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), "fk", "rk")).alias("first")).where("c > 1")
        # Rows of one text, however many, are met in _SALTS tasks.
        same = same.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        met = light.withColumn("s", part_of(_SALTS, F.col("fk"), F.col("rk"))).join(same, ["m", "b", "s"])
        rows = met.select("part", F.lit(0).alias("bucket"), F.when((F.col("fk") == F.col("first.fk")) & (F.col("rk") == F.col("first.rk")), 1).when(F.col("_id").eqNullSafe(F.col("first.i")), 2).otherwise(3).alias("level"), "fk", "rk")
        self.side = written(rows.withColumns({"n": F.lit(0).cast("long"), "data": F.lit(None).cast("binary"), "extra": F.lit(None).cast("binary")}).select(*[f.split()[0] for f in _SIDE.split(", ")]), "copies")
        self.levels: dict[int, DataFrame] = {}

    def _met(self, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        side = self.side
        for df in self.levels.values():
            side = side.unionByName(df, allowMissingColumns=True)

        def ordered(left: pa.Table, right: pa.Table) -> pa.Table:
            return run(left.sort_by([("fk", "ascending"), ("rk", "ascending")]), right)

        return self.texts.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(ordered, schema)

    def ask(self, level: int, run: Callable[[int, pa.Table, pa.Table], list[tuple]], judge: Judge, own_type: str, checked: bool = False) -> bool:
        """One round; its answers are written and go to the next rounds under level (10 or more). Whether any of them is a yes."""

        def request(left: pa.Table, right: pa.Table) -> pa.Table:
            return packets(run(left["part"][0].as_py(), left, right) if left.num_rows else [])

        asked = self._met(request, PACKET)
        # Buckets are numbered; dealt by the number itself they spread evenly.
        answers = asked.groupBy("bucket").applyInArrow(answer_bits(judge, own_type, checked), PACKET)
        self.levels[level] = written(answers, "answers")
        del asked, answers
        shuffles_released(self.spark)
        return not self.levels[level].where("extra is not null").isEmpty()

    def finish(self, run: Callable[[pa.Table, pa.Table], pa.Table], fields: list[T.StructField]) -> DataFrame:
        """The columns in keep, then what run gives for each row, in the order of its table."""
        schema = T.StructType([*self.types, *fields])
        n = len(self.keep)

        def rows(left: pa.Table, right: pa.Table) -> pa.Table:
            made = run(left, right)
            names = [f.name for f in schema]
            return pa.table([*(left[f"k{i}"] for i in range(n)), *made.columns], names)

        return self._met(rows, schema)


def copies(left: pa.Table, side: pa.Table) -> np.ndarray:
    """For each row of a part: 0 if its text occurs once, 1 if it is the first of several copies, 2 if it is another with the
    first one's id, 3 if another with a larger id or none."""
    out = np.zeros(left.num_rows, np.int8)
    marks = side.filter(pc.less(side["level"], 10))
    if marks.num_rows:
        at = dict(zip(zip(marks["fk"].to_pylist(), marks["rk"].to_pylist(), strict=True), marks["level"].to_pylist(), strict=True))
        for i, k in enumerate(zip(left["fk"].to_pylist(), left["rk"].to_pylist(), strict=True)):
            out[i] = at.get(k, 0)
    return out
