"""Exact dedup by content sort.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Sampled splitters
range-partition the normalised texts, Spark's external sort puts equals next to each other, and one sweep compares
neighbours in full. Of equal texts the row with the most code points stays, then the smallest id.

Skew: each Arrow batch first collapses its own equals, so a group of any size sends one row for each batch. The sweep
keeps a running best of the open group, never its members. Members meet their group again by digest, again one row for each
batch; the ``HOT_GROUPS`` largest groups, a table of bounded size, are sent to the members instead.

The normalised texts are worked out once and written in the shared folder.

Defined results: null text counts as empty; all empty or blank texts are one group; a null id loses ties against any id;
of rows repeated whole one stays; an empty table gives no rows; further columns are ignored by ``exact_groups`` and kept
by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlane.session import materialise, tasks_for

BLANKS = b" \t\n\x0b\x0c\r"
WHITE = " \t\n\x0b\x0c\r"
HOT_GROUPS = 1000


def _bare(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.translate(None, BLANKS) for t in texts.cast(pa.large_binary()).to_pylist()]


def _rank(chars: int, key) -> tuple:
    """Smallest first: most code points, then smallest id, null last."""
    return (-chars, key is None, key)


def _splitter(bare):
    """What the splitters are sampled from: the start of a text, then its hash, so that the driver gets short keys."""
    return F.substring(bare, 1, 128), F.xxhash64(bare)


def _collapse_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, bare, batch, ids, chars) of the distinct texts of each batch; ids best first."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        groups: dict[bytes, list] = {}
        lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for key, chars, bare in zip(batch.column(0).to_pylist(), lengths, _bare(batch.column(1)), strict=True):
            groups.setdefault(bare, []).append((chars, key))
        members = [sorted(m, key=lambda x: _rank(*x)) for m in groups.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(x).digest() for x in groups], pa.binary()),
                pa.array(list(groups), pa.binary()),
                pa.array([part << 24 | number] * len(groups), pa.int64()),
                pa.array([[x[1] for x in m] for m in members], pa.list_(batch.column(0).type)),
                pa.array([m[0][0] for m in members], pa.int64()),
            ],
            names=["digest", "bare", "batch", "ids", "chars"],
        )


def _sweep_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows (bare, digest, batch, best, chars, n): one row for each group of more than one member."""
    open_text, best, size, digest, kind = None, None, 0, None, pa.int64()
    out: list[tuple] = []

    def close() -> None:
        if open_text is not None and size > 1:
            out.append((digest, best[1], best[2], size))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = (pa.binary(), kind, pa.int64(), pa.int64())
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "keep_id", "keep_batch", "group_size"])
        out.clear()
        return rows

    for batch in batches:
        kind = batch.schema.field("best").type
        rows = zip(*(batch.column(c).to_pylist() for c in ("bare", "digest", "batch", "best", "chars", "n")), strict=True)
        for bare, sha, number, key, chars, n in rows:
            mine = (chars, key, number)
            if bare == open_text:
                size += n
                if _rank(chars, key) + (number,) < _rank(*best[:2]) + (best[2],):
                    best = mine
            else:
                close()
                open_text, best, size, digest = bare, mine, n, sha
        yield flush()
    close()
    yield flush()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    collapsed = two.mapInArrow(
        _collapse_members,
        T.StructType()
        .add("digest", T.BinaryType())
        .add("bare", T.BinaryType())
        .add("batch", T.LongType())
        .add("ids", T.ArrayType(kind))
        .add("chars", T.LongType()),
    )
    collapsed = materialise(collapsed, "collapsed")
    ordered = (
        collapsed.select("bare", "digest", "batch", F.col("ids")[0].alias("best"), "chars", F.size("ids").cast("long").alias("n"))
        .repartitionByRange(tasks_for(spark), *_splitter(F.col("bare")))
        .sortWithinPartitions("bare")
    )
    groups = ordered.mapInArrow(
        _sweep_groups,
        T.StructType()
        .add("digest", T.BinaryType())
        .add("keep_id", kind)
        .add("keep_batch", T.LongType())
        .add("group_size", T.LongType()),
    )
    groups = materialise(groups, "groups")
    # A group in proportion to the table has a row for each batch; at most HOT_GROUPS rows of fixed size are broadcast.
    hot = F.broadcast(groups.orderBy(F.desc("group_size"), "digest").limit(HOT_GROUPS))
    members = collapsed.select("digest", "batch", "ids")
    rest = members.join(hot.select("digest"), "digest", "left_anti").join(groups, "digest", "left")
    return members.join(hot, "digest").unionByName(rest).select(
        F.posexplode("ids").alias("at", id_col), "ids", "digest", "batch", "keep_id", "keep_batch", "group_size"
    ).select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("at") == 0) & (F.col("batch") == F.col("keep_batch"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _best_rows(id_at: int, text_at: int):
    """Of each run of equal texts in the stream, the row that stays. The stream is one batch, or sorted rows."""

    def batch_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
            best: dict[bytes, int] = {}
            ids = batch.column(id_at).to_pylist()
            for i, bare in enumerate(_bare(batch.column(text_at))):
                j = best.setdefault(bare, i)
                if _rank(chars[i], ids[i]) < _rank(chars[j], ids[j]):
                    best[bare] = i
            yield batch.take(pa.array(sorted(best.values()), pa.int64()))

    def sorted_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_text, held_rank = None, None, None
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()
            ids = batch.column(id_at).to_pylist()
            out: list[int] = []
            at = None  # row of this batch that leads the open group; None: the held row of an earlier batch does
            ready = []
            for i, bare in enumerate(_bare(batch.column(text_at))):
                mine = _rank(chars[i], ids[i])
                if bare == held_text:
                    if mine < held_rank:
                        at, held_rank = i, mine
                else:
                    if at is not None:
                        out.append(at)
                    elif held is not None:
                        ready.append(held)
                    at, held, held_text, held_rank = i, None, bare, mine
            yield from ready
            if out:
                yield batch.take(pa.array(out, pa.int64()))
            if at is not None:
                held = batch.slice(at, 1).take(pa.array([0], pa.int64()))
        if held is not None:
            yield held

    return batch_best, sorted_best


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns and their texts as they were."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_at, text_at = names.index(id_col), names.index(text_col)
    batch_best, sorted_best = _best_rows(id_at, text_at)
    bare = F.translate(F.coalesce(F.col(f"c{text_at}").cast("string"), F.lit("")), WHITE, "")
    return (
        plain.mapInArrow(batch_best, plain.schema)
        .repartitionByRange(tasks_for(docs.sparkSession), *_splitter(bare))
        .withColumn("bare", bare)
        .sortWithinPartitions("bare")
        .drop("bare")
        .mapInArrow(sorted_best, plain.schema)
        .toDF(*names)
    )
