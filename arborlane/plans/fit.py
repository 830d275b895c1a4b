"""Fit a model on DataFrames: bins, base score, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.functions.metrics import Metric, metric
from arborlane.functions.objectives import Objective, Softmax, objective
from arborlane.model import BoostedModel, feature_array, feature_columns, feature_vector
from arborlane.operators.binning import Discretizer
from arborlane.params import Params
from arborlane.plans.boosting import Booster, prepare


def fit(
    train: DataFrame,
    features: str | list[str],
    label: str = "label",
    weight: str | None = None,
    params: Params | None = None,
    loss: Objective | str = "square",
    valid: DataFrame | None = None,
    metrics: list[Metric | str] = (),
    callbacks: list = (),
    initial: BoostedModel | None = None,
    key: str | None = None,
    exact_quantiles: bool = False,
    local: bool = True,
) -> tuple[BoostedModel, dict]:
    """(model, metric histories). The initial model's trees, weights, bins and base are taken over; the loss is the new one.

    local: whether the driver may hold a binned table of at most ``LOCAL_BYTES``."""
    params = params or Params()
    loss = objective(loss) if isinstance(loss, str) else loss
    metrics = [metric(m) if isinstance(m, str) else m for m in metrics]
    cols, array = feature_columns(train, features), feature_array(train, features)
    if any(c >= len(cols) for c in (*params.cat_cols, *params.rank_cols)):
        raise ValueError("cat_cols and rank_cols must be columns of the features")
    y, w = F.col(label).cast("double"), (F.col(weight) if weight else F.lit(1.0)).cast("double")
    if initial is not None:
        disc, raw_base = initial.discretizer, initial.raw_base
    else:
        means = _means(loss, y, w) if not params.base_score else []
        disc, found = Discretizer.fit(train, cols, params, exact_quantiles, means, array)
        if params.base_score and len(params.base_score) != loss.size:
            raise ValueError(f"base_score needs {loss.size} values")
        base = list(params.base_score) or found
        if any(b is None for b in base):
            raise ValueError("the weights sum to nothing, so there is no mean label")
        raw_base = [float(x) for x in loss.inverse([float(b) for b in base])]
    stable = F.xxhash64(key) if key else None
    if key and dict(train.dtypes)[key] in ("bigint", "int", "smallint"):
        stable = F.col(key)
    def written(df: DataFrame) -> DataFrame:
        sparse = feature_vector(df, features) if disc.sparse and params.parallelism_type == "data" else None
        return prepare(df, disc, feature_columns(df, features, len(cols)), y, w, raw_base, stable, feature_array(df, features), sparse)

    data, held = written(train), written(valid) if valid is not None else None
    trees, weights = (list(initial.trees), list(initial.weights)) if initial else ([], [])
    booster = Booster(data, disc, loss, raw_base, params, metrics, list(callbacks), held, trees, weights, local)
    try:
        booster.run(lambda: BoostedModel(loss, disc, raw_base, list(booster.trees), list(booster.weights)))
    finally:
        booster.close()
    return BoostedModel(loss, disc, raw_base, booster.trees, booster.weights), booster.history


def _means(loss: Objective, y: Column, w: Column) -> list[Column]:
    """Weighted means of the encoded label; null where the weights sum to nothing."""
    total = F.nullif(F.sum(w), F.lit(0.0))
    if isinstance(loss, Softmax):
        return [F.sum(F.when(y == k, w).otherwise(0.0)) / total for k in range(loss.size)]
    return [F.sum(w * y) / total]
