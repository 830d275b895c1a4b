"""Feature binning. Bin 0 means missing; real bins start at 1."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.params import CAST_MODES, Params


def clean(v: Column, zero_as_missing: bool = False) -> Column:
    """Null where a value is missing: null, NaN, infinite, and zero if asked."""
    v = v.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad | (v == 0), None).otherwise(v) if zero_as_missing else F.when(bad, None).otherwise(v)


def cast_bin(v: Column, mode: str, max_bins: int) -> Column:
    """floor, ceil or round (half up) into 0..max_bins - 1; null and NaN are 0, so are values that fall to 0 or below."""
    v = v.cast("double")
    whole = {"floor": F.floor(v), "ceil": F.ceil(v), "round": F.floor(v + 0.5)}[mode]
    inside = F.when(v >= max_bins, F.lit(max_bins - 1)).when(v <= -1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(whole.cast("int"), F.lit(max_bins - 1))))
    return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(inside).cast("int")


def width_bin(v: Column, start: Column, step: Column, bins: Column) -> Column:
    """v is clean. Equal widths: the first bin up to start, then one bin each step."""
    steps = F.ceil((v - start) / F.when(step == 0, F.lit(1.0)).otherwise(step)).cast("int")
    inside = F.when((step == 0) | (v <= start), F.lit(1)).otherwise(F.least(steps + 1, bins))
    return F.when(v.isNull(), F.lit(0)).otherwise(inside).cast("int")


def depth_bin(v: Column, splits: Column) -> Column:
    """v is clean. One more than the number of splits below it."""
    return F.when(v.isNull(), F.lit(0)).otherwise(F.size(F.filter(splits, lambda s: s < v)) + 1).cast("int")


def width_column(low: float | None, high: float | None, max_bins: int) -> dict:
    """Equal-width bins between the least and greatest clean value; without values one bin."""
    if low is None:
        return {"kind": "width", "start": 0.0, "step": 0.0, "bins": 1}
    m = max_bins - 1
    step = (high - low) / (m - 1)
    return {"kind": "width", "start": low + step / 2, "step": step, "bins": m}


def depth_points(max_bins: int) -> list[float]:
    """Quantiles that the splits are taken at."""
    m = max_bins - 1
    return [(i + 0.5) / (m - 1) for i in range(m - 1)]


#: Beyond so many columns one expression for each would outgrow generated code; Arrow batches are binned instead.
WIDE = 24


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows by places of a list column; null is NaN. A row of another length, or null, is an error."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) and not (lengths == size).all():
        raise ValueError(f"a row has not {size} features")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def _wide_ranges(df: DataFrame, array: Column, size: int, zero_as_missing: bool) -> dict[int, tuple[float, float]]:
    """(least, greatest) clean value of each column; a row for each column comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        for rows in batches:
            x = matrix(rows.column(0), size)
            ok = np.isfinite(x) & ((x != 0) if zero_as_missing else True)
            low = np.minimum(low, np.where(ok, x, np.inf).min(axis=0, initial=np.inf))
            high = np.maximum(high, np.where(ok, x, -np.inf).max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(low), pa.array(high)], names=["c", "l", "h"])

    rows = df.select(array.alias("x")).mapInArrow(run, "c int, l double, h double").groupBy("c").agg(F.min("l"), F.max("h")).collect()
    return {c: (lo, hi) for c, lo, hi in rows if lo <= hi}


@dataclass
class Discretizer:
    """Fitted bins of every column; columns are plain expressions when transforming, arrays when scoring."""

    max_bins: int
    discretization_type: str
    zero_as_missing: bool = False
    non_numerical: tuple[int, ...] = ()
    columns: list[dict] = field(default_factory=list)  # kind cast (mode), width (start, step, bins) or depth (splits)

    @property
    def size(self) -> int:
        return len(self.columns)

    @staticmethod
    def fit(df: DataFrame, features: list[Column], params: Params, exact: bool = False, extra: list[Column] = (), array: Column | None = None) -> tuple[Discretizer, list]:
        """One aggregation over all columns; ``extra`` aggregates (such as the label's mean) ride along. array: all
        features as one column, by which wide tables are read."""
        mode, other = params.modes()
        rest = {*params.cat_cols, *params.rank_cols}
        out = Discretizer(params.max_bins, params.discretization_type, params.zero_as_missing, tuple(sorted(rest)))
        aggs: list[Column] = []
        wide = mode == "width" and array is not None and len(features) > WIDE
        ranges = _wide_ranges(df, array, len(features), params.zero_as_missing) if wide else {}
        for i, v in enumerate(features):
            v = clean(v, params.zero_as_missing)
            if i in rest or mode in CAST_MODES or wide:
                continue
            if mode == "width":
                aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
            else:
                points = F.array(*map(F.lit, depth_points(params.max_bins)))
                # Finer than a bin: an error of 1 / (16 * max_bins) of the rows.
                aggs.append((F.percentile(v, points) if exact else F.percentile_approx(v, points, 16 * params.max_bins)).alias(f"c{i}"))
        row = df.agg(*aggs, *(x.alias(f"x{k}") for k, x in enumerate(extra))).first() if aggs or extra else None
        for i in range(len(features)):
            if i in rest:
                out.columns.append({"kind": "cast", "mode": other})
            elif mode in CAST_MODES:
                out.columns.append({"kind": "cast", "mode": mode})
            elif mode == "width":
                low, high = ranges.get(i, (None, None)) if wide else (row[f"l{i}"], row[f"h{i}"])
                out.columns.append(width_column(low, high, params.max_bins))
            else:
                out.columns.append({"kind": "depth", "splits": sorted({float(x) for x in (row[f"c{i}"] or []) if x is not None})})
        return out, [row[f"x{k}"] for k in range(len(extra))]

    def bin(self, i: int, v: Column) -> Column:
        c = self.columns[i]
        if c["kind"] == "cast":
            return cast_bin(v, c["mode"], self.max_bins)
        v = clean(v, self.zero_as_missing)
        if c["kind"] == "width":
            return width_bin(v, F.lit(c["start"]), F.lit(c["step"]), F.lit(c["bins"]))
        return depth_bin(v, F.array(*map(F.lit, c["splits"])).cast("array<double>"))

    def transform(self, features: list[Column]) -> Column:
        """Bins of a row as array<int>."""
        if len(features) != self.size:
            raise ValueError(f"{len(features)} features; the bins were fitted on {self.size}")
        return F.array(*(self.bin(i, v) for i, v in enumerate(features)))

    def bin_array(self, i: int, v: np.ndarray) -> np.ndarray:
        """The same for a numpy column."""
        c, v = self.columns[i], np.asarray(v, float)
        if c["kind"] == "cast":
            x = np.nan_to_num(v, nan=0.0, posinf=self.max_bins - 1, neginf=0.0)
            whole = {"floor": np.floor, "ceil": np.ceil, "round": lambda y: np.floor(y + 0.5)}[c["mode"]](x)
            return np.clip(whole, 0, self.max_bins - 1).astype(np.int32)
        missing = ~np.isfinite(v) | ((v == 0) if self.zero_as_missing else False)
        x = np.where(missing, 0.0, v)
        if c["kind"] == "width":
            step = c["step"] or 1.0
            inside = np.ones(len(x)) if c["step"] == 0 else np.where(x <= c["start"], 1, np.minimum(1 + np.ceil((x - c["start"]) / step), c["bins"]))
        else:
            inside = np.searchsorted(np.array(c["splits"], float), x, side="left") + 1
        return np.where(missing, 0, inside).astype(np.int32)

    @property
    def sparse(self) -> bool:
        """Whether zeros of every column are in bin 0, so that sparse rows can stay sparse."""
        return self.zero_as_missing or all(c["kind"] == "cast" for c in self.columns)

    def sparse_bins(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first cell of each row and their number, column, bin) of the filled cells of vectors, dense or sparse."""
        kind, size, index, value = (vectors.field(k) for k in range(4))
        kinds = kind.to_numpy(zero_copy_only=False)
        lengths = value.value_lengths().to_numpy(zero_copy_only=False)
        sizes = np.where(kinds == 0, size.fill_null(-1).to_numpy(zero_copy_only=False), lengths)
        if vectors.null_count or not (sizes == self.size).all():
            raise ValueError(f"a row has not {self.size} features")
        row = np.repeat(np.arange(len(vectors)), lengths)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        col[kinds[row] == 0] = index.flatten().to_numpy(zero_copy_only=False)
        x = value.flatten().to_numpy(zero_copy_only=False).astype(float)
        bins = np.zeros(len(row), np.int64)
        order = np.argsort(col, kind="stable")
        cuts = np.flatnonzero(np.diff(col[order])) + 1
        for mine in np.split(order, cuts) if len(order) else []:
            bins[mine] = self.bin_array(int(col[mine[0]]), x[mine])
        some = bins != 0
        return np.append(0, np.cumsum(np.bincount(row[some], minlength=len(vectors)))), col[some], bins[some]

    def to_dict(self) -> dict:
        return {"max_bins": self.max_bins, "discretization_type": self.discretization_type, "zero_as_missing": self.zero_as_missing,
                "non_numerical": list(self.non_numerical), "columns": self.columns}

    @staticmethod
    def from_dict(d: dict) -> Discretizer:
        return Discretizer(d["max_bins"], d["discretization_type"], d["zero_as_missing"], tuple(d["non_numerical"]), d["columns"])

    def tables(self, spark) -> dict[str, DataFrame]:
        """params, nonNumCols and colDiscretizers as tables."""
        rows = [(i, c["kind"], [float(c["start"]), float(c["step"])] if c["kind"] == "width" else [float(x) for x in c.get("splits", [])],
                 [int(c["bins"])] if c["kind"] == "width" else [CAST_MODES.index(c["mode"])] if c["kind"] == "cast" else []) for i, c in enumerate(self.columns)]
        return {
            "params": spark.createDataFrame([(k, json.dumps(v)) for k, v in (("numCols", self.size), ("maxBins", self.max_bins), ("discretizationType", self.discretization_type), ("zeroAsMissing", self.zero_as_missing))], "key string, value string"),
            "nonNumCols": spark.createDataFrame([(i,) for i in self.non_numerical], "col int"),
            "colDiscretizers": spark.createDataFrame(rows, "featureIndex int, type string, doubles array<double>, ints array<int>"),
        }

    @staticmethod
    def from_tables(tables: dict[str, DataFrame]) -> Discretizer:
        p = {r["key"]: json.loads(r["value"]) for r in tables["params"].collect()}
        out = Discretizer(p["maxBins"], p["discretizationType"], p["zeroAsMissing"], tuple(sorted(r[0] for r in tables["nonNumCols"].collect())))
        for r in sorted(tables["colDiscretizers"].collect(), key=lambda r: r["featureIndex"]):
            if r["type"] == "width":
                out.columns.append({"kind": "width", "start": r["doubles"][0], "step": r["doubles"][1], "bins": r["ints"][0]})
            elif r["type"] == "cast":
                out.columns.append({"kind": "cast", "mode": CAST_MODES[r["ints"][0]]})
            else:
                out.columns.append({"kind": "depth", "splits": list(r["doubles"])})
        return out


def sparsity(df: DataFrame, bins: str, cols: int) -> float:
    """Share of missing cells of a binned table."""
    missing = F.size(F.filter(F.col(bins), lambda b: b == 0))
    mean = df.agg(F.avg(missing)).first()[0]
    return mean / cols if mean is not None and cols else math.nan
