"""Weighted metrics. Each is sums that partitions add up, so any number of them is one pass; all means are sum(wx)/sum(w)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlane.operators.cells import column_matrix

TINY = 1e-16
SCORE_BINS = 1 << 16


class Metric:
    """``partial`` gives sums of a batch (any array shape), ``value`` reads the total. label, raw, score: rows by outputs."""

    name, larger_is_better, batch = "custom", False, False

    def partial(self, weight: np.ndarray, label: np.ndarray, raw: np.ndarray, score: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def value(self, sums: np.ndarray) -> float:
        return float(sums[1] / sums[0])


class Mean(Metric):
    """Weighted mean of ``of(label, raw, score)``, a user's function over numpy arrays."""

    def __init__(self, name: str, of: Callable, larger_is_better: bool = False, then: Callable[[float], float] = float):
        self.name, self.of, self.larger_is_better, self.then = name, of, larger_is_better, then

    def partial(self, weight, label, raw, score):
        return np.array([weight.sum(), (weight * self.of(label, raw, score)).sum()])

    def value(self, sums):
        return self.then(sums[1] / sums[0])


class Batch(Metric):
    """A user's function of the whole scored table, a DataFrame (weight, label, raw, score); the last three are arrays."""

    batch = True

    def __init__(self, name: str, of: Callable[[DataFrame], float], larger_is_better: bool = False):
        self.name, self.compute, self.larger_is_better = name, of, larger_is_better


class R2(Metric):
    name, larger_is_better = "r2", True

    def partial(self, weight, label, raw, score):
        y, s = label[:, 0], score[:, 0]
        return np.array([weight.sum(), (weight * (y - s) ** 2).sum(), (weight * y * y).sum(), (weight * y).sum()])

    def value(self, sums):
        w, e, yy, y = sums
        return float(1 - (e / w) / (yy / w - (y / w) ** 2))


class _Ranked(Metric):
    larger_is_better = True

    def __init__(self, bins: int = SCORE_BINS):
        self.bins = bins

    def partial(self, weight, label, raw, score):
        b = np.clip(np.floor(score[:, 0] * self.bins), 0, self.bins - 1).astype(np.int64)
        y = label[:, 0]
        return np.stack([np.bincount(b, weights=weight * y, minlength=self.bins), np.bincount(b, weights=weight * (1 - y), minlength=self.bins)])

    @staticmethod
    def _falling(sums):
        pos, neg = sums[0][::-1], sums[1][::-1]
        some = (pos > 0) | (neg > 0)
        return pos[some], neg[some]


class AUROC(_Ranked):
    name = "auroc"

    def value(self, sums):
        pos, neg = self._falling(sums)
        above = np.cumsum(pos) - pos
        return float((neg * (above + pos / 2)).sum() / (pos.sum() * neg.sum()))


class AUPRC(_Ranked):
    name = "auprc"

    def value(self, sums):
        pos, neg = self._falling(sums)
        tp, fp = np.cumsum(pos), np.cumsum(neg)
        precision, recall = tp / (tp + fp), tp / pos.sum()
        precision, recall = np.append(precision[0], precision), np.append(0.0, recall)
        return float((np.diff(recall) * (precision[1:] + precision[:-1]) / 2).sum())


def _log_loss(label, raw, score):
    if label.shape[1] > 1:
        return -np.log(np.maximum((label * score).sum(axis=1), TINY))
    y, p = label[:, 0], score[:, 0]
    return -np.where(y > 0, y * np.log(np.maximum(p, TINY)), 0) - np.where(y < 1, (1 - y) * np.log(np.maximum(1 - p, TINY)), 0)


def _error(threshold: float):
    def of(label, raw, score):
        if label.shape[1] > 1:
            return (label.argmax(axis=1) != score.argmax(axis=1)).astype(float)
        return ((score[:, 0] > threshold) != (label[:, 0] > 0.5)).astype(float)

    return of


def metric(name: str, threshold: float = 0.5) -> Metric:
    """mse, rmse, mae, r2, logloss, error, error@t, auroc (auc), auprc."""
    diff = lambda label, raw, score: score[:, 0] - label[:, 0]
    if name == "mse":
        return Mean("mse", lambda y, r, s: diff(y, r, s) ** 2)
    if name == "rmse":
        return Mean("rmse", lambda y, r, s: diff(y, r, s) ** 2, then=lambda v: float(np.sqrt(v)))
    if name == "mae":
        return Mean("mae", lambda y, r, s: np.abs(diff(y, r, s)))
    if name == "r2":
        return R2()
    if name == "logloss":
        return Mean("logloss", _log_loss)
    if name == "error" or name.startswith("error@"):
        return Mean(name, _error(float(name[6:]) if "@" in name else threshold))
    if name in ("auroc", "auc"):
        return AUROC()
    if name == "auprc":
        return AUPRC()
    raise ValueError(f"unknown metric {name!r}")


def partials(metrics: list[Metric], scored: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (metric, sums) of one partition's batches (weight, label, raw, score)."""
    total: list = [None] * len(metrics)
    for weight, label, raw, score in scored:
        if len(weight):
            for i, m in enumerate(metrics):
                s = m.partial(weight, label, raw, score)
                total[i] = s if total[i] is None else total[i] + s
    some = [i for i, s in enumerate(total) if s is not None]
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([total[i].astype(float).tobytes() for i in some], pa.binary()), pa.array([list(total[i].shape) for i in some], pa.list_(pa.int32()))],
        names=["m", "s", "shape"],
    )


def totalled(metrics: list[Metric], rows: Iterable[dict]) -> dict[str, float]:
    """Values by name from the rows of all partitions."""
    total: dict[int, np.ndarray] = {}
    for r in rows:
        s = np.frombuffer(r["s"], float).reshape(r["shape"])
        total[r["m"]] = total[r["m"]] + s if r["m"] in total else s
    return {m.name: m.value(total[i]) for i, m in enumerate(metrics) if i in total}


def measured(weight, label, raw, score) -> pa.RecordBatch:
    """Rows (weight, label, raw, score), the last three lists."""
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x, float).ravel()))

    return pa.RecordBatch.from_arrays([pa.array(np.asarray(weight, float)), lists(label), lists(raw), lists(score)], names=["weight", "label", "raw", "score"])


def measure(df: DataFrame, metrics: list[Metric]) -> dict[str, float]:
    """Metrics of a scored table (weight double; label, raw and score array<double>), as fits evaluate them."""
    adding = [m for m in metrics if not m.batch]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partials(adding, ((b.column("weight").to_numpy(zero_copy_only=False), *(column_matrix(b.column(c)) for c in ("label", "raw", "score"))) for b in batches))

    rows = df.select("weight", "label", "raw", "score").mapInArrow(run, "m int, s binary, shape array<int>").collect() if adding else []
    out = totalled(adding, (r.asDict() for r in rows)) | {m.name: float(m.compute(df)) for m in metrics if m.batch}
    return {m.name: out[m.name] for m in metrics if m.name in out}
