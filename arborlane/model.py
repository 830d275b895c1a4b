"""Fitted models: scoring, leaves, importances, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlane.functions.objectives import Objective, objective
from arborlane.operators.binning import Discretizer
from arborlane.operators.cells import Dense
from arborlane.operators.trees import NODE_SCHEMA, Tree
from arborlane.sources.tables import load_tables, save_tables


def feature_columns(df: DataFrame, features: str | list[str], size: int | None = None) -> list[Column]:
    """Columns of a vector, an array of doubles, or a list of numeric columns. The size is read from the first row."""
    if isinstance(features, (list, tuple)):
        return [F.col(c) for c in features]
    kind = df.schema[features].dataType
    array = vector_to_array(F.col(features)) if isinstance(kind, VectorUDT) else F.col(features)
    size = feature_count(df, features) if size is None else size
    return [F.get(array, F.lit(i)) for i in range(size)]


def feature_array(df: DataFrame, features: str | list[str]) -> Column:
    """All features of a row as one array<double>."""
    if isinstance(features, (list, tuple)):
        return BoostedModel.array([F.col(c) for c in features])
    kind = df.schema[features].dataType
    return vector_to_array(F.col(features)) if isinstance(kind, VectorUDT) else F.col(features).cast("array<double>")


def feature_vector(df: DataFrame, features: str | list[str]) -> Column | None:
    """The features as a vector, if they are one."""
    return F.col(features) if isinstance(features, str) and isinstance(df.schema[features].dataType, VectorUDT) else None


def feature_count(df: DataFrame, features: str | list[str]) -> int:
    """The size is read from the first row."""
    if isinstance(features, (list, tuple)):
        return len(features)
    array = feature_array(df, features)
    first = df.select(F.size(array)).filter(array.isNotNull()).first()
    if first is None:
        raise ValueError("no rows to read the number of features from")
    return first[0]


@dataclass
class BoostedModel:
    objective: Objective
    discretizer: Discretizer
    raw_base: list[float]
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    # -- inspection ------------------------------------------------------------------------------------------------

    @property
    def num_trees(self) -> int:
        return len(self.trees)

    @property
    def num_leaves(self) -> list[int]:
        return [len(t.leaves) for t in self.trees]

    @property
    def num_nodes(self) -> list[int]:
        return [len(t.nodes) for t in self.trees]

    @property
    def depths(self) -> list[int]:
        return [t.depth for t in self.trees]

    def _first(self, first_trees: int) -> int:
        if first_trees < -1:
            raise ValueError("first_trees must be at least -1")
        return len(self.trees) if first_trees < 0 else min(first_trees, len(self.trees))

    def importances(self, kind: str = "numsplits", first_trees: int = -1) -> dict[int, float]:
        """By column: numsplits, sumgain or avggain over the splits of the first trees."""
        sums: dict[int, list[float]] = {}
        for t in self.trees[: self._first(first_trees)]:
            for n in t.nodes.values():
                if n.split:
                    s = sums.setdefault(n.split.col, [0.0, 0])
                    s[0] += n.split.gain
                    s[1] += 1
        read = {"numsplits": lambda s: float(s[1]), "sumgain": lambda s: s[0], "avggain": lambda s: s[0] / s[1]}
        if kind not in read:
            raise ValueError(f"importance {kind!r} is not numsplits, sumgain or avggain")
        return {c: read[kind](s) for c, s in sorted(sums.items())}

    # -- scoring in numpy ------------------------------------------------------------------------------------------

    def bin(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.discretizer.size:
            raise ValueError(f"{x.shape[1]} features; the model has {self.discretizer.size}")
        return np.stack([self.discretizer.bin_array(i, x[:, i]) for i in range(x.shape[1])], axis=1)

    def raw_of(self, bins: np.ndarray, first_trees: int = -1) -> np.ndarray:
        raw, cells = np.tile(np.array(self.raw_base, float), (len(bins), 1)), Dense(bins)
        for i in range(self._first(first_trees)):
            raw[:, i % raw.shape[1]] += self.weights[i] * self.trees[i].predict(cells)
        return raw

    # -- scoring as columns: one vectorised function over plain arrays ---------------------------------------------

    def _function(self, kind: T.DataType, of):
        model = self

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                if len(rows):
                    yield pd.Series(list(of(model.bin(np.stack(rows.to_numpy()).astype(float)))))
                else:
                    yield pd.Series([], dtype=object)

        return run

    @staticmethod
    def array(features: list[Column] | Column) -> Column:
        if isinstance(features, Column):
            return features
        return F.array(*(F.coalesce(f.cast("double"), F.lit(float("nan"))) for f in features))

    def predict_raw(self, features: list[Column] | Column, first_trees: int = -1) -> Column:
        """array<double>, one for each output."""
        return self._function(T.ArrayType(T.DoubleType()), lambda b: self.raw_of(b, first_trees))(self.array(features))

    def predict(self, features: list[Column] | Column, first_trees: int = -1) -> Column:
        """array<double>: the link of the raw score."""
        return self._function(T.ArrayType(T.DoubleType()), lambda b: self.objective.transform(self.raw_of(b, first_trees)))(self.array(features))

    def leaf(self, features: list[Column] | Column, first_trees: int = -1) -> Column:
        """array<int>: leaf of each tree, by the order of node ids."""
        n = self._first(first_trees)
        return self._function(T.ArrayType(T.IntegerType()), lambda b: np.stack([t.leaf_of(Dense(b)) for t in self.trees[:n]], axis=1) if n else np.zeros((len(b), 0), int))(self.array(features))

    def leaf_places(self, features: list[Column] | Column, first_trees: int = -1) -> tuple[Column, int]:
        """(array<int> of the ones of a one-hot vector over all leaves of all trees, its size)."""
        n = self._first(first_trees)
        sizes = self.num_leaves[:n]
        shift = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if n else np.zeros(0, int)
        of = lambda b: np.stack([t.leaf_of(Dense(b)) for t in self.trees[:n]], axis=1) + shift if n else np.zeros((len(b), 0), int)
        return self._function(T.ArrayType(T.IntegerType()), of)(self.array(features)), int(sum(sizes))

    # -- tables ----------------------------------------------------------------------------------------------------

    def tree_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r) for i, t in enumerate(self.trees) for r in t.rows()]
        return spark.createDataFrame(rows, f"treeIndex int, node struct<{NODE_SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>")

    def save(self, spark: SparkSession, path: str) -> None:
        extra = [("objective", json.dumps(self.objective.to_dict())), ("rawBase", json.dumps(self.raw_base)), ("weights", json.dumps(self.weights)), ("numTrees", json.dumps(len(self.trees)))]
        save_tables({"tree": self.tree_table(spark), "extra": spark.createDataFrame(extra, "key string, value string")}, path)
        save_tables(self.discretizer.tables(spark), f"{path}/discretizer")

    @staticmethod
    def load(spark: SparkSession, path: str, loss: Objective | None = None) -> BoostedModel:
        """loss: needed for a user's own objective, of which only the name is saved."""
        tables = load_tables(spark, ["tree", "extra"], path)
        extra = {r["key"]: json.loads(r["value"]) for r in tables["extra"].collect()}
        by: dict[int, list] = {}
        for r in tables["tree"].collect():  # a model's nodes
            by.setdefault(r["treeIndex"], []).append(tuple(r["node"]))
        if sorted(by) != list(range(extra["numTrees"])):
            raise ValueError("tree indices must be dense")
        obj = extra["objective"]
        loss = loss or objective(**obj)
        disc = Discretizer.from_tables(load_tables(spark, ["params", "nonNumCols", "colDiscretizers"], f"{path}/discretizer"))
        return BoostedModel(loss, disc, extra["rawBase"], [Tree.from_rows(by[i]) for i in range(len(by))], extra["weights"])
