"""Quality classifier by importance resampling over hashed n-gram models.

Generative models of hashed n-grams are fitted on labelled documents, of the target (wanted) text and of the raw text (all
labelled documents), for two views:

* words: the distinct lower-case words of a document and their stems of ``STEM`` bytes, wanted = not toxic;
* forms: bigrams of word forms (last byte, case of the first two, same word as before), wanted = good quality.

The ratio of an n-gram is the log of its target over its raw probability, either sign, smoothed by ``ALPHA`` towards 0. In
the words' view it is brought towards 0 by ``margin`` standard errors, so that a long text is not judged by the noise of
many rare words. A document's log ratio in a view is the sum over all its n-grams; its log weight is how far the log ratio
is above the view's level, in the view where it is least: a document must be like the target in both.

Documents are sampled by Gumbel top-k on ``sharpness * log weight + Gumbel noise``, the noise a hash of id and text. k is
``share`` of the documents; by default the share whose log weight reaches 0. The greater the sharpness, the fewer documents
near the level change places by the noise.

Fitting reads at most ``max_labelled`` labelled documents, those with the smallest hash of the id. They are halved by a hash
of the text; two models are fitted, one on each half, margin and levels are chosen on the half a model has not seen, and the
mean of the two is taken. Only n-grams whose ratio is not 0 are sent to the driver and the tasks. Scoring reads every
document whole; the k-th key is found by counting in ever finer bins, without sorting or collecting.

Defined results: null text counts as empty, and an empty text has log ratio 0, which is never under a level; a view without
labels of both kinds in both halves says nothing; a text whose labels disagree counts as unwanted; labels of unknown
documents and null labels are not used; ties of keys are all in; repeated rows get the same key; an empty table gives no
rows; further columns are kept by ``accept``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlane.llm.blocks import batch
from arborlane.llm.words import Words, chunks, mix, ngrams, tidy
from arborlane.session import materialise, release

WORD_SIZE, FORM_SIZE, STEM = 1 << 22, 1 << 14, 5
VIEWS = {"word": WORD_SIZE, "form": FORM_SIZE}
ALPHA = 4.0
MARGINS = {"word": (1.0, 2.0, 3.0, 4.0, 5.0), "form": (0.0,)}
LOST_COSTS = 4.0  # a wanted document lost counts as this many unwanted ones let through
MAX_LABELLED = 60_000
SHARPNESS = 16.0


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By view (text, bucket) of the n-grams of each text of a chunk: distinct words and stems, and all form bigrams."""
    words = Words(data, offsets)
    if not len(words):
        none = np.zeros(0, np.int64)
        return {view: (none, none) for view in VIEWS}
    first, last = words.start, words.end - 1
    raw = words.data

    def upper(at: np.ndarray) -> np.ndarray:
        return ((raw[at] >= 65) & (raw[at] <= 90)).astype(np.uint64)

    same = np.zeros(len(words), np.uint64)
    plain = words.hashes()
    same[1:] = (plain[1:] == plain[:-1]) & (words.doc[1:] == words.doc[:-1])
    form = raw[last].astype(np.uint64) | upper(first) << np.uint64(8) | upper(np.minimum(first + 1, last)) << np.uint64(9)
    pairs = ngrams(mix(form | same << np.uint64(10)), 2) % np.uint64(FORM_SIZE)
    within = words.doc[1:] == words.doc[:-1]
    folded = Words(data, offsets, fold=True)
    end = folded.end.copy()
    for _ in range(3):  # closing punctuation
        b = folded.data[end - 1]
        letter = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
        end = end - (~letter & (end - folded.start > 1))
    found = []
    for salt, stop in ((0, end), (1, np.minimum(end, folded.start + STEM))):
        folded.end = stop
        bucket = mix(folded.hashes() + np.uint64(salt)) % np.uint64(WORD_SIZE)
        found.append(folded.doc * WORD_SIZE + bucket.astype(np.int64))
    once = np.unique(np.concatenate(found))
    return {"word": (once // WORD_SIZE, once % WORD_SIZE), "form": (words.doc[:-1][within], pairs.astype(np.int64)[within])}


def ratios(target: np.ndarray, raw: np.ndarray, share: float, margin: float) -> np.ndarray:
    """Log of target over raw probability of n-grams with these counts, ``share`` the target's part of all counts."""
    t, r = target + ALPHA * share, raw + ALPHA
    ratio = np.log(t / r / share)
    error = np.sqrt(np.maximum(1 / t - 1 / r, 0))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - margin * error, 0)


@dataclass
class Ratios:
    """Ratios of a view's n-grams, those that are not 0, and the level that parts wanted from unwanted log ratios."""

    size: int
    bucket: np.ndarray
    ratio: np.ndarray
    level: float = 0.0
    _dense: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    def of(self, bucket: np.ndarray) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(self.size, np.float32)
            self._dense[self.bucket] = self.ratio
        return self._dense[bucket]


@dataclass
class Model:
    """By view the ratios fitted on each half; a view without them says nothing."""

    views: dict[str, list[Ratios]] = field(default_factory=dict)
    #: by view: margin, and of the documents the models had not seen the shares of wanted ones lost and unwanted ones missed
    held_out: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def log_ratios(self, data, offsets) -> dict[str, np.ndarray]:
        """By view: the mean over both models of a text's log ratio above the level."""
        found, texts = features(data, offsets), len(offsets) - 1
        out = {}
        for view, models in self.views.items():
            doc, bucket = found[view]
            out[view] = sum(np.bincount(doc, weights=m.of(bucket), minlength=texts) - m.level for m in models) / len(models)
        return out

    def log_weight(self, data, offsets) -> np.ndarray:
        each = self.log_ratios(data, offsets)
        return np.min(list(each.values()), axis=0) if each else np.zeros(len(offsets) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, half, word, form), the last two whether a text is wanted in a view: counts by view, bucket and half."""
    for rows in batches:
        flags = {c: rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("half", *VIEWS)}
        for first, data, offsets in chunks(rows.column(0)):
            for at, (view, (doc, bucket)) in enumerate(features(data, offsets).items()):
                size = VIEWS[view]
                key, n = np.unique((flags["half"][first + doc] * 2 + flags[view][first + doc]) * size + bucket, return_counts=True)
                kind = key // size
                yield batch(
                    view=pa.array(np.full(len(key), at, np.int32)), bucket=pa.array((key % size).astype(np.int32)),
                    half=pa.array((kind // 2).astype(np.int32)), wanted=pa.array((kind % 2).astype(np.int32)), n=pa.array(n.astype(np.int64)),
                )


def level_of(log_ratio: np.ndarray, wanted: np.ndarray) -> tuple[float, float, float, float]:
    """(cost, level, wanted ones lost, unwanted ones let through) of the level, at most 0, that costs least.

    Of levels that cost the same it is the middle one.
    """
    order = np.argsort(log_ratio, kind="stable")
    value, good = log_ratio[order], wanted[order]
    lost = np.append(0, np.cumsum(good)) / max(good.sum(), 1)  # by how many of the least are under the level
    missed = np.append(np.cumsum((~good)[::-1])[::-1], 0) / max((~good).sum(), 1)
    edge = np.append(value[0] - 1, np.append((value[1:] + value[:-1]) / 2, value[-1] + 1))
    possible = np.append(True, np.append(value[1:] > value[:-1], True)) & (edge < 0)
    if not possible.any():
        return LOST_COSTS, float(value[0] - 1), 0.0, 1.0
    cost = np.where(possible, LOST_COSTS * lost + missed, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = best[len(best) // 2]
    return float(cost[at]), float(edge[at]), float(lost[at]), float(missed[at])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    known = labels.select(F.col(id_col).alias("id"), (F.col("toxic") == 0).cast("int").alias("word"), (F.col("quality") == 1).cast("int").alias("form"))
    known = known.dropna().orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    known = materialise(known, "labels")
    two = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    labelled = two.join(F.broadcast(known), "id").groupBy("text").agg(F.min("word").alias("word"), F.min("form").alias("form"))  # at most max_labelled rows
    half = F.pmod(F.shiftright(F.xxhash64("text"), 7), F.lit(2)).cast("int").alias("half")
    labelled = materialise(labelled.select("text", half, *VIEWS), "labelled")
    counts = labelled.mapInArrow(tidy(_count), "view int, bucket int, half int, wanted int, n long")
    cell = lambda half, wanted: F.sum(F.when((F.col("half") == half) & (F.col("wanted") == wanted), F.col("n")).otherwise(0))
    table = counts.groupBy("view", "bucket").agg(*(cell(h, w).alias(f"n{h}{w}") for h in (0, 1) for w in (0, 1)))
    table = materialise(table, "counts")
    sums = {(r["view"], h, w): r[f"s{h}{w}"] or 0 for r in table.groupBy("view").agg(*(F.sum(f"n{h}{w}").alias(f"s{h}{w}") for h in (0, 1) for w in (0, 1))).collect() for h in (0, 1) for w in (0, 1)}
    model, tried = Model(), {}
    for at, (view, size) in enumerate(VIEWS.items()):
        if not all(sums.get((at, h, w), 0) for h in (0, 1) for w in (0, 1)):
            continue
        share = [sums[at, h, 1] / (sums[at, h, 0] + sums[at, h, 1]) for h in (0, 1)]
        some = F.lit(False)
        for h in (0, 1):  # within a standard error or more of 0 by every margin
            t, r = F.col(f"n{h}1") + ALPHA * share[h], F.col(f"n{h}0") + F.col(f"n{h}1") + ALPHA
            some |= F.abs(F.log(t / r / share[h])) > min(MARGINS[view]) * F.sqrt(F.greatest(1 / t - 1 / r, F.lit(0.0)))
        found = table.filter((F.col("view") == at) & some).orderBy("bucket").toPandas()  # at most ``size`` rows
        bucket = found.bucket.to_numpy()
        tried[view] = [
            [Ratios(size, bucket, ratios(found[f"n{h}1"].to_numpy(float), (found[f"n{h}0"] + found[f"n{h}1"]).to_numpy(float), share[h], m).astype(np.float32)) for m in MARGINS[view]]
            for h in (0, 1)
        ]

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            halves = rows.column("half").to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(rows.column(0)):
                texts = len(offsets) - 1
                seen = features(data, offsets)
                sums = {}
                for view, by_half in tried.items():
                    doc, bucket = seen[view]
                    each = [np.stack([np.bincount(doc, weights=m.of(bucket), minlength=texts) for m in models], axis=1) for models in by_half]
                    other = 1 - halves[first : first + texts]  # the model of the other half
                    sums[view] = pa.array(np.where(other[:, None] == 1, each[1], each[0]).tolist(), pa.list_(pa.float64()))
                yield batch(**{c: rows.column(c).slice(first, texts) for c in ("half", *VIEWS)}, **{f"{view}_sums": sums[view] for view in tried})

    kinds = ", ".join([*(f"{c} int" for c in ("half", *VIEWS)), *(f"{view}_sums array<double>" for view in tried)])
    odd = labelled.mapInArrow(held_out, kinds).toPandas() if tried else None  # at most max_labelled rows of a few numbers
    for view, by_half in tried.items():
        sums, wanted, half = np.stack(odd[f"{view}_sums"].to_numpy()), odd[view].to_numpy() == 1, odd["half"].to_numpy()
        best = None
        for i, margin in enumerate(MARGINS[view]):
            levels = [level_of(sums[half == 1 - h, i], wanted[half == 1 - h]) for h in (0, 1)]
            cost = levels[0][0] + levels[1][0]
            if best is None or cost < best[0]:
                best = (cost, i, margin, levels)
        _, i, margin, levels = best
        model.views[view] = []
        for h in (0, 1):
            m = by_half[h][i]
            m.level = levels[h][1]
            model.views[view].append(m)
        model.held_out[view] = (margin, *(float(np.mean([x[k] for x in levels])) for k in (2, 3)))
    return model


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024, rounds: int = 12) -> float:
    """The k-th largest value, by counts in bins that narrow around it; ``bins`` rows come to the driver each round."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        inside = df.filter((F.col(col) >= low) & (F.col(col) <= high))
        bin_of = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
        rows = sorted(inside.groupBy(bin_of.alias("b")).agg(F.count("*"), F.min(col), F.max(col)).collect(), reverse=True)
        for _, count, least, most in rows:
            if above + count >= k:
                low, high = least, most
                break
            above += count
        if count == 1 or low == high or above + count == k:
            return low
    return low


def _weighed(model: Model, text_at: int):
    """The rows with their log weight in a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            weights = [model.log_weight(data, offsets) for _, data, offsets in chunks(rows.column(text_at))]
            weight = pa.array(np.concatenate(weights) if weights else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*rows.columns, weight], names=[*rows.schema.names, "log_weight"])

    return run


def _keyed(docs: DataFrame, model: Model, id_at: int, text_at: int, sharpness: float, seed: int) -> DataFrame:
    """docs (c0, c1, ..) with log_weight and gumbel_key, which are the same however often they are worked out."""
    text = F.coalesce(F.col(f"c{text_at}").cast("string"), F.lit(""))
    noise = F.xxhash64(F.lit(seed), F.col(f"c{id_at}"), text)
    u = (F.shiftrightunsigned(noise, 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rows = docs.withColumn("noise", -F.log(-F.log(u)))
    rows = rows.mapInArrow(tidy(_weighed(model, text_at)), T.StructType([*rows.schema.fields, T.StructField("log_weight", T.DoubleType())]))
    return rows.withColumn("gumbel_key", F.col("log_weight") * F.lit(sharpness) + F.col("noise")).drop("noise")


def _kept(keys: DataFrame, share: float | None):
    """Whether a row is in the Gumbel top-k. keys: a written table of all rows' log_weight and gumbel_key."""
    n, like = keys.agg(F.count("*"), F.count(F.when(F.col("log_weight") >= 0, 1))).first()
    return F.col("gumbel_key") >= F.lit(kth_largest(keys, "gumbel_key", like if share is None else round(share * n)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float | None = None,
    sharpness: float = SHARPNESS,
    seed: int = 11,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """One row for each input row: id, log_weight, gumbel_key, kept (in the Gumbel top-k)."""
    model = fit(docs, labels, id_col, text_col, max_labelled)
    two = docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").alias("c1"))
    keys = materialise(_keyed(two, model, 0, 1, sharpness, seed).select("c0", "log_weight", "gumbel_key"), "keys")
    return keys.withColumn("kept", _kept(keys, share)).withColumnRenamed("c0", id_col)


def accept(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, sharpness: float = SHARPNESS, seed: int = 11
) -> DataFrame:
    """The rows that the classifier keeps, with all their columns.

    Only the keys are written. The rows are read and weighed again as they leave: no join, and no copy of the texts that
    would stay on disk while other stages run.
    """
    names = docs.columns
    model = fit(docs, labels, id_col, text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = _keyed(plain, model, names.index(id_col), names.index(text_col), sharpness, seed)
    keys = materialise(rows.select("log_weight", "gumbel_key"), "keys")
    kept = _kept(keys, share)
    release(keys)
    return rows.filter(kept).select(plain.columns).toDF(*names)
