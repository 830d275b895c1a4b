"""Bounded helpers that several operators share: Bloom filters, packed arrays, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm.words import mix
from arborlane.session import materialise, release

BITS_PER_KEY, MOST_BITS = 12, 28
#: Keys that a skewed join may send to all tasks, and rows of a table that may be sent whole.
HOT_KEYS, SMALL_TABLE = 1024, 100_000
#: One for each hash of a Bloom filter.
SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Bloom:
    """A Bloom filter over 64-bit keys, merged by Spark: the driver gets at most ``bits / 64`` rows.

    Its size goes by the number of keys, up to ``2 ** MOST_BITS`` bits (32 MB). With more keys than that is for it lets more
    through, never less; what it lets through is joined exactly.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        wide = keys.astype(np.int64).view(np.uint64)
        return [mix(wide ^ np.uint64(SEEDS[i])) & np.uint64(bits - 1) for i in range(len(SEEDS))]

    @staticmethod
    def of(keys: DataFrame, col: str, log_bits: int | None = None) -> Bloom:
        """keys: a written table; without ``log_bits`` its rows are counted for the size."""
        if log_bits is None:
            log_bits = min(max((BITS_PER_KEY * keys.count()).bit_length(), 16), MOST_BITS)
        bits = 1 << log_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                p = np.unique(np.concatenate(Bloom.places(rows.column(0).to_numpy(zero_copy_only=False), bits)))
                slot = (p >> np.uint64(6)).astype(np.int32)
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
                ones = np.left_shift(np.uint64(1), p & np.uint64(63))
                merged = np.bitwise_or.reduceat(ones, first) if len(first) else ones
                yield batch(w=pa.array(slot[first]), b=pa.array(merged.view(np.int64)))

        rows = keys.select(F.col(col).alias("k")).mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(bits >> 6, np.int64)
        words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        return Bloom(words.view(np.uint64))

    def mask(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in."""
        found = np.ones(len(keys), bool)
        for p in Bloom.places(keys, self.bits):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found

    def filter(self, df: DataFrame, col: str, inside: bool = True) -> DataFrame:
        """The rows whose key may be in, or those whose key is not in."""
        at = df.columns.index(col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield rows.filter(pa.array(self.mask(rows.column(at).to_numpy(zero_copy_only=False)) == inside))

        return df.mapInArrow(run, df.schema)


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_anti) with ``one``, which has a row for each key and in column ``n`` how many of the ``total`` rows have it.

    Keys with more than one ``HOT_KEYS``-th of the rows, fewer than ``HOT_KEYS``, are sent to the rows; the rows of any other
    key meet in one task. Both tables are read twice, so they should be written ones. Of many rows the rest is joined by
    merging, for a table whose file is small enough to be broadcast may be ten times that in the driver.
    """
    limit = total // HOT_KEYS
    plain = one.filter(F.col(n) <= limit).drop(n)
    hot = F.broadcast(one.filter(F.col(n) > limit).drop(n))
    rest = rows.join(hot.select(key), key, "left_anti").join(plain if total <= SMALL_TABLE else plain.hint("merge"), key, how)
    return rest if how == "left_anti" else rows.join(hot, key).unionByName(rest)


def _least(rows: DataFrame, size: int, made: list[DataFrame]) -> DataFrame:
    """(a, b, m) of rows (a, b), where m is the least b that a has. ``size``: at most so many rows; made: tables written."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if size <= SMALL_TABLE:  # the nodes' table is within the limit of a broadcast
        return rows.join(F.broadcast(least.drop("n")), "a")
    made.append(materialise(least, "least"))
    return join_hot(rows, made[-1], "a", "n", size)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node that links reach.

    Alternating large and small stars: each round is two group-bys without collecting any neighbourhood, over edges that
    a written table holds, until every node has one link and none is linked to one that has a link itself; then the links
    are stars around their least nodes. It is an error if they are not after ``rounds``. No node's links meet in one task.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialise(pairs, "edges")
    for left in range(rounds, -1, -1):
        ends = F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("a", 1), ("b", 0)))))
        links = pairs.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum(1 - F.col("e.up")).alias("down"))
        size, most, both = links.agg(F.coalesce(F.sum("up"), F.lit(0)), F.max("up"), F.max(F.least("up", "down"))).first()
        if not size or (most == 1 and both == 0):
            break
        if not left:
            raise RuntimeError(f"the components have not settled after {rounds} rounds")
        # Large star: each neighbour above a node is linked to the least of the node's neighbourhood.
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        made = [pairs]
        large = _least(around, 2 * size, made).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.filter("a <> b").distinct()
        if size > SMALL_TABLE:
            large = materialise(large, "edges")
            made.append(large)
        # Small star: a node's smaller neighbours and itself are linked to the least of them.
        small = _least(large, 2 * size, made).select(F.explode(F.array(*(F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in "ab"))).alias("e"))
        pairs = materialise(small.select("e.*").filter("a <> b").distinct(), "edges")
        for table in made:
            release(table)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
