"""Substring dedup over a log-structured fingerprint index.

A window is ``window`` consecutive words of one document. Windows are sampled by content: of the ``ngram``-word hashes
inside a window the smallest is its fingerprint, so equal windows have equal fingerprints and few positions are indexed.

The index is a log of immutable runs in a folder, each a table bucketed by fingerprint and sorted within, with one posting
for each distinct fingerprint; a manifest, written after a run, names those that count. A new batch is dealt and sorted by
fingerprint and merge-joined with the runs where they lie, newest first, and with itself: runs are neither shuffled nor held
in memory. Postings of repeated fingerprints are reported, old ones included; the batch's new fingerprints, and the old ones
that are now marked as reported, become the next run. Beyond ``max_runs`` runs the two neighbours of fewest rows are merged,
again in place, and the superseded ones deleted. The folder outlives the session: who opens it goes on with its runs.

Verification: only windows whose fingerprint is repeated meet across documents, by a 128-bit BLAKE2b digest of their words,
half of it for sorting; a window counts as repeated when its whole word sequence starts elsewhere.

Skew: a task first settles what repeats inside it and sends one posting for each fingerprint or window, so a passage that
any share of all documents hold costs one posting for each task. Documents without a repeated fingerprint, all but the
few that a Bloom filter of fixed size lets through, are never shuffled.

Defined results: null text has no words; documents shorter than the window lose none; repeated rows repeat each other's
windows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlane.llm.blocks import Bloom, batch, binary
from arborlane.llm.words import Words, chunks, deal, mix, ngrams, tidy
from arborlane.session import materialise, release, shared_dir, tasks_for

WINDOW, NGRAM = 35, 8
#: Rows of a run: its postings, and those of the repeats found when it was made.
RUNS = "kind int, h long, doc long, pos int, told boolean"
MANIFEST = "window int, ngram int, buckets int, at int, run string, rows long"
FRESH, RUN, MATCH = 0, 1, 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def fingerprints(words: Words, window: int, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, fingerprint of each, all n-gram hashes) of a chunk."""
    grams = ngrams(words.hashes(), ngram)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), grams
    least = _sliding_min(grams, window - ngram + 1)
    starts = np.arange(len(least))
    whole = words.doc[starts] == words.doc[starts + window - 1]
    return starts[whole], least[whole], grams


def _matches(buckets: int, docs: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed by bucket of the document: distinct keys (doc), how many positions each has (seen), positions."""
    if not len(docs):
        return
    to = (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((pos, docs, to))
    docs, pos, to = docs[order], pos[order].astype(np.uint32), to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(docs)], strict=True):
        first = np.flatnonzero(np.append(True, docs[lo + 1 : hi] != docs[lo : hi - 1]))
        count = np.diff(np.append(first, hi - lo)).astype(np.uint32)
        yield batch(
            bucket=pa.array([int(to[lo])], pa.int32()), kind=pa.array([MATCH], pa.int32()), n=pa.array([int(hi - lo)], pa.int64()),
            hash=pa.nulls(1, pa.binary()), doc=pa.array([binary(docs[lo:hi][first])], pa.binary()),
            pos=pa.array([binary(pos[lo:hi])], pa.binary()), seen=pa.array([binary(count)], pa.binary()),
        )


def _unpack_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's packed matches: a row for each document with its positions."""
    parts = []
    for rows in batches:
        for doc, pos, seen in zip(*(rows.column(c).to_pylist() for c in ("doc", "pos", "seen")), strict=True):
            parts.append((np.repeat(np.frombuffer(doc, np.int64), np.frombuffer(seen, np.uint32)), np.frombuffer(pos, np.uint32)))
    if not parts:
        return
    docs, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, docs))
    docs, pos = docs[order], pos[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    ends = [*first[1:].tolist(), len(docs)]
    yield batch(key=pa.array(docs[first]), positions=pa.array([binary(pos[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()))


def positions_of(matches: DataFrame, buckets: int) -> DataFrame:
    """(key, positions) of packed matches, one row for each document."""
    dealt = matches.select("bucket", "doc", "pos", "seen").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(tidy(_unpack_matches), "key long, positions binary")


class _Gathered:
    """Arrays gathered up to a bound, then handed on."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, *arrays) -> None:
        self.parts.append(arrays)
        self.n += len(arrays[0])

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        return out


def _settle(hashes, docs, pos) -> Iterator[pa.RecordBatch]:
    """Report what repeats among these postings; pass on one for each hash."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs, pos = hashes[order], docs[order], pos[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    count = np.diff(np.append(first, len(hashes)))
    again = np.flatnonzero(np.repeat(count > 1, count))
    for kind, at, seen in ((MATCH, again, np.ones(len(again), bool)), (FRESH, first, count > 1)):
        yield batch(
            kind=pa.array(np.full(len(at), kind, np.int32)), h=pa.array(hashes[at].view(np.int64)), doc=pa.array(docs[at].astype(np.int64)),
            pos=pa.array(pos[at].astype(np.int32)), told=pa.array(seen),
        )


def _index_docs(window: int, ngram: int, limit: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(limit)
        for rows in batches:
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(rows.column(1)):
                words = Words(data, offsets)
                starts, least, grams = fingerprints(words, window, ngram)
                if not len(starts):
                    continue
                # Positions whose hash is the fingerprint of a window that holds them.
                width = window - ngram + 1
                low, high = np.full(len(grams), np.uint64(0)), np.uint64(0)
                chosen = np.zeros(len(grams), bool)
                full = np.full(len(grams) - width + 1, np.iinfo(np.uint64).max, np.uint64)
                full[starts] = least
                # A position is chosen if any whole window over it has its value as least.
                reach = np.full(len(grams) + width - 1, high, np.uint64)
                reach[width - 1 : width - 1 + len(full)] = np.where(full == np.iinfo(np.uint64).max, low[: len(full)], full)
                most = ~_sliding_min(~reach, width)
                chosen = most[: len(grams)] == grams
                at = np.flatnonzero(chosen)
                doc = words.doc[at]
                held.add(grams[at], keys[first + doc], at - words.first[doc])
            if held.n >= held.limit:
                yield from _settle(*held.take())
        if held.n:
            yield from _settle(*held.take())

    return run


def _passed(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(matches, which need no merge; the rest)."""
    match = rows.column("kind").to_numpy(zero_copy_only=False) == MATCH
    return rows.filter(pa.array(match)), rows.filter(pa.array(~match))


class FingerprintIndex:
    """Runs of fingerprints in the folder ``path``, which is made or, if it holds an index, gone on with.

    ``append`` adds a batch and returns the postings (doc, pos) of repeats. A repeat is reported when its second occurrence
    comes in; a reported one is not reported again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, ngram: int = NGRAM, buckets: int | None = None, max_runs: int = 4):
        self.spark, self.path, self.window, self.ngram, self.max_runs = spark, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", window, ngram, max_runs
        self.buckets, self.version = buckets or tasks_for(spark), 0
        #: (folder, table's name, rows) of each run, oldest first
        self.runs: list[tuple[str, str, int]] = []
        done = [int(p.getParent().getName().partition("-")[2]) for p in self._listed("manifest-*/_SUCCESS")]
        if done:
            self.version = max(done)
            rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest-{self.version}").orderBy("at").collect()
            self.buckets = rows[0]["buckets"]
            if (rows[0]["window"], rows[0]["ngram"]) != (window, ngram):
                raise ValueError(f"the index at {self.path} has windows of {rows[0]['window']} words and {rows[0]['ngram']}-grams")
            self.runs = [(r["run"], self._named(r["run"]), r["rows"]) for r in rows if r["run"] is not None]

    # -- files and tables ------------------------------------------------------------------------------------------

    def _files(self, at: str):
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(at)
        return target.getFileSystem(sc._jsc.hadoopConfiguration()), target

    def _listed(self, pattern: str) -> list:
        fs, target = self._files(f"{self.path}/{pattern}")
        return [status.getPath() for status in fs.globStatus(target) or []]

    def _gone(self, at: str) -> None:
        fs, target = self._files(at)
        fs.delete(target, True)

    def _named(self, run: str) -> str:
        """A name in this session's catalog for a run's files."""
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUNS}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return name

    def _written(self, rows: DataFrame) -> tuple[str, str, int]:
        run, name = f"run-{uuid.uuid4().hex}", f"fingerprint_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{run}")
        # A bucket is one sorted file, which a merge need not sort again.
        sorted_files = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(sorted_files, None)
        self.spark.conf.set(sorted_files, "true")
        try:
            writer.saveAsTable(name)
        finally:
            self.spark.conf.unset(sorted_files) if before is None else self.spark.conf.set(sorted_files, before)
        return run, name, self.spark.table(name).filter(F.col("kind") == RUN).count()

    def _commit(self, runs: list[tuple[str, str, int]]) -> None:
        """Make these the runs that count, then delete what no longer does."""
        old, self.runs = self.runs, runs
        rows = [(self.window, self.ngram, self.buckets, at, run, n) for at, (run, _, n) in enumerate(runs)] or [(self.window, self.ngram, self.buckets, 0, None, 0)]
        self.version += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        for run, name, _ in old:
            if run not in {r for r, _, _ in runs}:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self._gone(f"{self.path}/{run}")
        if self.version > 1:
            self._gone(f"{self.path}/manifest-{self.version - 1}")

    def close(self) -> None:
        """Forget the names; the folder stays."""
        for _, name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []

    def delete(self) -> None:
        self.close()
        self._gone(self.path)

    # -- the log ---------------------------------------------------------------------------------------------------

    def _postings(self, name: str, as_: str) -> DataFrame:
        return self.spark.table(name).filter(F.col("kind") == RUN).select("h", F.struct("doc", "pos", "told").alias(as_)).hint("merge")

    def append(self, docs: DataFrame) -> DataFrame:
        """docs: (key long, text). The postings (doc, pos) of repeats."""
        posted = docs.select("key", "text").mapInArrow(tidy(_index_docs(self.window, self.ngram)), RUNS)
        posted = materialise(posted, "postings", by="kind")
        rows = posted.filter(F.col("kind") == FRESH).drop("kind").repartition(self.buckets, "h")
        for i, (_, name, _) in enumerate(self.runs):
            rows = rows.join(self._postings(name, f"r{i}"), "h", "left")
        old = F.coalesce(*(F.col(f"r{i}") for i in range(len(self.runs) - 1, -1, -1))) if self.runs else F.lit(None).cast("struct<doc: bigint, pos: int, told: boolean>")
        # A hash has a posting of each task that found it, at most.
        alike = Window.partitionBy("h")
        rows = rows.select("h", "doc", "pos", "told", old.alias("old")).withColumns({
            "n": F.count("*").over(alike), "some": F.max("told").over(alike), "turn": F.row_number().over(alike.orderBy("doc", "pos")),
        })
        known, lead = F.col("old").isNotNull(), F.col("turn") == 1
        untold = lead & known & ~F.col("old.told")

        def row(kind: int, doc: str, pos: str, told) -> object:
            return F.struct(F.lit(kind).alias("kind"), F.col(doc).alias("doc"), F.col(pos).alias("pos"), told.alias("told"))

        made = F.array(
            F.when((known | (F.col("n") > 1)) & ~F.col("told"), row(MATCH, "doc", "pos", F.lit(True))),
            F.when(untold, row(MATCH, "old.doc", "old.pos", F.lit(True))),
            F.when(lead & ~known, row(RUN, "doc", "pos", F.col("some") | (F.col("n") > 1))),
            F.when(untold, row(RUN, "old.doc", "old.pos", F.lit(True))),
        )
        out = rows.select("h", F.explode(F.array_compact(made)).alias("r")).select("r.kind", "h", "r.doc", "r.pos", "r.told")
        new = self._written(out)
        found = posted.filter(F.col("kind") == MATCH).select("doc", "pos").unionByName(self.spark.table(new[1]).filter(F.col("kind") == MATCH).select("doc", "pos"))
        found = materialise(found, "repeats")
        release(posted)
        self._commit([*self.runs, new])
        while len(self.runs) > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge the two neighbouring runs that have the fewest rows; of a hash in both, the newer posting stays."""
        at = min(range(len(self.runs) - 1), key=lambda i: self.runs[i][2] + self.runs[i + 1][2])
        older, newer = (self._postings(self.runs[i][1], name) for i, name in ((at, "older"), (at + 1, "newer")))
        both = older.join(newer, "h", "full").select(F.lit(RUN).alias("kind"), "h", F.coalesce("newer", "older").alias("r"))
        merged = self._written(both.select("kind", "h", "r.doc", "r.pos", "r.told"))
        self._commit([*self.runs[:at], merged, *self.runs[at + 2 :]])


def marks_of(repeats: DataFrame) -> DataFrame:
    """(key, positions) of postings (doc, pos), one row for each document."""
    return repeats.groupBy(F.col("doc").alias("key")).agg(F.collect_set("pos").alias("positions"))


def digests(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digest of each window's words, joined by one space."""
    length = words.end - words.start
    at = np.append(0, np.cumsum(length + 1))
    source = np.repeat(words.start - at[:-1], length + 1) + np.arange(at[-1])
    joined = words.data[np.minimum(source, len(words.data) - 1)]
    joined[at[1:] - 1] = 32
    raw = joined.tobytes()
    out = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), (at[starts + window] - 1).tolist())])
    both = np.frombuffer(out, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _candidate_windows(window: int, ngram: int, buckets: int, limit: int = 1 << 19):
    """Rows (key, text, positions): the whole hash of each window whose fingerprint is at one of the positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(limit)
        for rows in batches:
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            marks = rows.column(2)
            ends, places = marks.offsets.to_numpy(), marks.values.to_numpy()
            for first, data, offsets in chunks(rows.column(1)):
                words = Words(data, offsets)
                starts, least, grams = fingerprints(words, window, ngram)
                if not len(starts):
                    continue
                flagged = [places[ends[first + i] : ends[first + i + 1]] + words.first[i] for i in range(len(offsets) - 1)]
                values = grams[np.concatenate(flagged).astype(np.int64)]
                starts = starts[np.isin(least, values)]
                doc = words.doc[starts]
                held.add(*digests(words, starts, window), keys[first + doc], (starts - words.first[doc]).astype(np.uint32))
            if held.n >= held.limit:
                yield from _settle_windows(buckets, *held.take())
        if held.n:
            yield from _settle_windows(buckets, *held.take())

    return run


WINDOWS = "bucket int, kind int, n long, hash binary, check binary, doc binary, keys binary, pos binary, seen binary"


def _window_matches(buckets: int, docs, pos) -> Iterator[pa.RecordBatch]:
    for rows in _matches(buckets, docs, pos):
        none = pa.nulls(rows.num_rows, pa.binary())
        yield batch(**{c: rows.column(c) for c in ("bucket", "kind", "n")}, hash=none, check=none, doc=rows.column("doc"), keys=none, pos=rows.column("pos"), seen=rows.column("seen"))


def _settle_windows(buckets: int, hashes, check, docs, pos) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((check, hashes))
    hashes, check, docs, pos = hashes[order], check[order], docs[order], pos[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(hashes)))
    again = np.repeat(count > 1, count)
    yield from _window_matches(buckets, docs[again], pos[again])
    hashes, check, docs, pos, seen = hashes[first], check[first], docs[first], pos[first], count > 1
    order = np.argsort(deal(hashes, buckets), kind="stable")
    hashes, check, docs, pos, seen = (x[order] for x in (hashes, check, docs, pos, seen))
    dealt = deal(hashes, buckets)
    cuts = np.flatnonzero(np.diff(dealt)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(hashes)], strict=True):
        if hi > lo:
            keys, index = np.unique(docs[lo:hi], return_inverse=True)
            small = np.uint16 if len(keys) < 1 << 16 else np.uint32
            yield batch(
                bucket=pa.array([int(dealt[lo])], pa.int32()), kind=pa.array([FRESH], pa.int32()), n=pa.array([int(hi - lo)], pa.int64()),
                hash=pa.array([binary(hashes[lo:hi])], pa.binary()), check=pa.array([binary(check[lo:hi])], pa.binary()),
                doc=pa.array([binary(index.astype(small))], pa.binary()), keys=pa.array([binary(keys)], pa.binary()),
                pos=pa.array([binary(pos[lo:hi])], pa.binary()), seen=pa.array([binary(seen[lo:hi].astype(np.uint8))], pa.binary()),
            )


def _merge_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for rows in batches:
            done, rows = _passed(rows)
            yield done
            for r in rows.to_pylist():
                keys = np.frombuffer(r["keys"], np.int64)
                index = np.frombuffer(r["doc"], np.uint16 if len(keys) < 1 << 16 else np.uint32)
                parts.append((np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["check"], np.uint64), keys[index], np.frombuffer(r["pos"], np.uint32), np.frombuffer(r["seen"], np.uint8)))
        if not parts:
            return
        hashes, check, docs, pos, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((check, hashes))
        hashes, check, docs, pos, seen = (x[order] for x in (hashes, check, docs, pos, seen))
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])))
        count = np.diff(np.append(first, len(hashes)))
        report = np.repeat(count > 1, count) & (seen == 0)
        yield from _window_matches(buckets, docs[report], pos[report])

    return run


def _kept(window: int):
    """Rows (id, text, starts): words, removed words and the digest of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            marks = rows.column(2).to_pylist()
            n_words, n_removed, digest = [], [], []
            for first, data, offsets in chunks(rows.column(1)):
                words = Words(data, offsets)
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    lo, hi = int(words.first[i]), int(words.first[i + 1])
                    gone = 0
                    if marks[first + i]:
                        starts = np.frombuffer(marks[first + i], np.uint32)
                        edge = np.zeros(hi - lo + 1, np.int32)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        stays = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
                        gone = hi - lo - len(stays)
                        kept = [raw[words.start[lo + j] : words.end[lo + j]] for j in stays]
                    else:
                        kept = raw[offsets[i] : offsets[i + 1]].split()  # bytes.split() parts at exactly 0x20 and 0x09-0x0D
                    n_words.append(hi - lo)
                    n_removed.append(gone)
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield batch(id=rows.column(0), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept_sha256=pa.array(digest, pa.string()))

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, ngram: int = NGRAM, batches: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    spark = docs.sparkSession
    # The key of a row: repeated rows share one, and with it their result.
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    index = FingerprintIndex(spark, None, window, ngram)
    found = None
    for i in range(batches):
        new = index.append(two.filter(F.pmod("key", F.lit(batches)) == i))
        found = new if found is None else found.unionByName(new)
    marks = materialise(marks_of(found), "marks")
    index.delete()
    bloom = Bloom.of(marks, "key")
    maybe = bloom.filter(two, "key")
    joined = maybe.select("key", "text").join(marks, "key").select("key", "text", "positions")
    blocks = joined.mapInArrow(tidy(_candidate_windows(window, ngram, index.buckets)), WINDOWS)
    starts = blocks.repartitionById(index.buckets, F.col("bucket")).mapInArrow(tidy(_merge_windows(index.buckets)), WINDOWS)
    starts = positions_of(starts, index.buckets)
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    plain = bloom.filter(two, "key", inside=False).select("id", "text", F.lit(None).cast("binary").alias("positions"))
    rest = maybe.join(starts, "key", "left").select("id", "text", "positions")
    out = plain.mapInArrow(tidy(_kept(window)), kind).unionByName(rest.mapInArrow(tidy(_kept(window)), kind))
    return out.withColumnRenamed("id", id_col)
