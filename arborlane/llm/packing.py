"""Packing by cutting-stock column generation.

A document's ids are cut into full blocks and one remainder. The histogram of remainder lengths, at most
``size / unit`` classes, is all the driver sees. A linear program over packing patterns is solved by column generation:
the restricted master by revised simplex, new columns priced by an unbounded knapsack. Patterns are rounded down, what is
left over goes by first fit decreasing, and the patterns become intervals of ranks: the k-th piece of a class goes to the
pattern whose interval holds k. Ranks come from counts by (class, salt) plus a row number within, so that a class of any
size, also one of a single row repeated, is ranked by many tasks.

Lengths are rounded up to ``unit`` for the plan only; the pieces keep their length and lie without gaps, so a sequence
can miss at most ``unit - 1`` ids for each piece besides what the plan leaves open.

Defined results: null text counts as empty and is the closing id alone; repeated rows are packed each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlane.session import broadcast_if_small, materialise, tasks_for

#: Fixed value: how byte-level BPE of this vocabulary splits a text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file; its merge order is its id order, so ids serve as ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                ids = np.append(encode(text, allowed_special="all"), end_id).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["id", "start", "length", "crc", "total"],
            )

    return run


def _knapsack(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of classes 1..len(prices) of total size at most ``room``: value and counts."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        k = min(c, len(prices))
        worth = best[c - 1 :: -1][:k] + prices[:k]
        j = int(np.argmax(worth))
        best[c], last[c] = (worth[j], j + 1) if worth[j] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(len(prices), np.int64), room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), counts


def _first_basis(d: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fractional first fit decreasing: each pattern is used until it exhausts a class, which no later pattern holds.

    So the patterns, put in the order of the classes they exhaust, are a triangular basis: (basis, inverse, uses).
    """
    m, left = len(d), d.copy()
    basis, uses, rank = np.zeros((m, m)), np.zeros(m), []
    while len(rank) < m:
        pattern, free = np.zeros(m), room
        for j in range(m - 1, -1, -1):
            if left[j] > 0 and sizes[j] <= free:
                pattern[j] = min(free // int(sizes[j]), max(1, int(left[j])))
                free -= int(pattern[j]) * int(sizes[j])
        used = pattern > 0
        times = np.where(used, left / np.where(used, pattern, 1), np.inf)
        out = int(np.argmin(times))
        left = np.maximum(left - pattern * times[out], 0)
        left[out] = 0
        basis[:, out], uses[out] = pattern, times[out]
        rank.append(out)
        for j in np.flatnonzero(used & (left <= 1e-9) & (np.arange(m) != out)):  # exhausted along with it
            left[j] = 0
            basis[j, j] = room // int(sizes[j])
            rank.append(int(j))
    # Forward substitution: in the order of rank the basis is lower triangular.
    inverse = np.zeros((m, m))
    for k, j in enumerate(rank):
        done = rank[:k]
        row = -(basis[j, done][:, None] * inverse[done]).sum(axis=0)
        row[j] += 1
        inverse[j] = row / basis[j, j]
    return basis, inverse, uses


def column_generation(demand: np.ndarray, room: int, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional uses that cover ``demand`` of classes 1..len(demand) with few bins."""
    need = np.flatnonzero(demand)
    if not len(need):
        return np.zeros((len(demand), 0), np.int64), np.zeros(0)
    d, sizes = demand[need].astype(float), need + 1
    m = len(need)
    (basis, inverse, x), cost = _first_basis(d, sizes, room), np.ones(m)
    volume = sizes / room  # feasible for the dual, and near its optimum: prices are smoothed towards it
    least = float((volume * d).sum())
    for _ in range(rounds):
        if (cost * x).sum() <= least * (1 + 1e-6) + 0.5:
            break
        pi = (cost[:, None] * inverse).sum(axis=0)
        worst = int(np.argmin(pi))
        for share in (0.8, 0.4, 0.0):
            full = np.zeros(len(demand))
            full[need] = np.maximum(share * volume + (1 - share) * pi, 0)
            column = _knapsack(full, room)[1][need].astype(float)
            if (pi * column).sum() > 1 + 1e-7:
                price = 1.0
                break
        else:
            if pi[worst] >= -1e-7:
                break
            column, price = np.zeros(m), 0.0
            column[worst] = -1.0
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-7, np.maximum(x, 0) / np.where(step > 1e-7, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave], cost[leave] = column, price
        x = x - ratio[leave] * step
        x[leave] = ratio[leave]
        row = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, row)
        inverse[leave] = row
    x = np.maximum(x, 0)
    real = cost > 0.5
    patterns = np.zeros((len(demand), int(real.sum())), np.int64)
    patterns[need] = np.rint(basis[:, real]).astype(np.int64)
    return patterns, x[real]


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover every piece: the rounded program, then first fit decreasing for the rest."""
    patterns, uses = column_generation(demand, room)
    times = np.floor(uses + 1e-9).astype(np.int64)
    out = [(patterns[:, i], int(t)) for i, t in enumerate(times) if t > 0]
    left = np.maximum(demand - (patterns * times).sum(axis=1), 0) if len(times) else demand.copy()
    while left.any():
        counts, free = np.zeros(len(demand), np.int64), room
        for j in np.flatnonzero(left)[::-1]:
            take = min(int(left[j]), free // (int(j) + 1))
            counts[j], free = take, free - take * (int(j) + 1)
            if not free:
                break
        used = counts > 0
        again = int(np.min(left[used] // counts[used]))
        out.append((counts, again))
        left = left - counts * again
    return out


def intervals(steps: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, ranks, first sequence, slot), a row for each slot of each pattern."""
    out, sequence, reached = [], 0, {}
    for pattern, times in steps:
        slot = 0
        for j in np.flatnonzero(pattern)[::-1]:
            for _ in range(int(pattern[j])):
                lo = reached.get(int(j) + 1, 0)
                out.append((int(j) + 1, lo, times, sequence, slot))
                reached[int(j) + 1] = lo + times
                slot += 1
        sequence += times
    return out


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    size: int = 1024,
    unit: int = 4,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = T.StructType().add("id", docs.schema[id_col].dataType)
    for name in ("start", "length", "crc", "total"):
        kind = kind.add(name, T.LongType())
    pieces = two.mapInArrow(_cut(tokenizer or default_tokenizer(), size, end_id), kind)
    n = tasks_for(spark)
    # The salt is a hash of the piece and of its place in the input, so that repeated rows have many; it is written once.
    pieces = pieces.withColumn("at", F.monotonically_increasing_id()).withColumns(
        {"cls": F.ceil(F.col("length") / F.lit(unit)).cast("int"), "salt": F.pmod(F.xxhash64("id", "start", "crc", "at"), F.lit(n)).cast("int")}
    )
    pieces = materialise(pieces.drop("at"), "pieces")
    by_salt = pieces.groupBy("cls", "salt").agg(F.count("*").alias("pieces"))
    shift = by_salt.select(
        "cls", "salt", (F.sum("pieces").over(Window.partitionBy("cls").orderBy("salt")) - F.col("pieces")).alias("shift")
    )
    room = -(-size // unit)
    demand = np.zeros(room, np.int64)
    for cls, count in by_salt.groupBy("cls").agg(F.sum("pieces")).collect():  # at most size / unit rows
        demand[cls - 1] = count
    rows = intervals(plan(demand, room))
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "cls int, lo long, n long, first long, slot int")
    ranked = pieces.withColumn(
        "k", F.row_number().over(Window.partitionBy("cls", "salt").orderBy(F.xxhash64("id", "start", "crc"), "id", "start"))
    )
    # Classes times salts may be many on a large cluster: beyond the limit Spark's own join finds the shift.
    ranked = ranked.join(broadcast_if_small(shift, room * n), ["cls", "salt"]).withColumn("rank", F.col("shift") + F.col("k") - 1)
    # Patterns are a few for each class and hold at most ``room`` slots each, whatever the input.
    placed = ranked.join(
        F.broadcast(slots.withColumnRenamed("cls", "slot_cls")),
        (F.col("cls") == F.col("slot_cls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")),
    ).withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"),
        "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
    )
