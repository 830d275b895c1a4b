"""Estimators and models for ``pyspark.ml`` pipelines."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import SparseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.functions.metrics import metric
from arborlane.functions.objectives import objective
from arborlane.model import BoostedModel, feature_array
from arborlane.params import Params as TrainParams
from arborlane.plans.callbacks import Checkpoint, EarlyStop
from arborlane.plans.fit import fit

_C = TypeConverters
_KINDS = {int: _C.toInt, float: _C.toFloat, str: _C.toString, bool: _C.toBoolean}
_LISTS = {"cat_cols": _C.toListInt, "rank_cols": _C.toListInt, "base_score": _C.toListFloat}


def _camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


_TRAIN = {_camel(k): (k, v) for k, v in TrainParams().to_dict().items()}
#: Params besides those of training: default and converter. "" and -1 mean off.
_OWN = {
    "featuresCol": ("features", _C.toString), "labelCol": ("label", _C.toString), "weightCol": ("", _C.toString), "keyCol": ("", _C.toString),
    "predictionCol": ("prediction", _C.toString), "leafCol": ("", _C.toString), "enableOneHot": (False, _C.toBoolean), "firstTrees": (-1, _C.toInt),
    "importanceType": ("numsplits", _C.toString), "evaluateFunc": ([], _C.toListString), "objectiveFunc": ("square", _C.toString),
    "earlyStopIters": (-1, _C.toInt), "modelCheckpointPath": ("", _C.toString), "modelCheckpointInterval": (-1, _C.toInt), "initialModelPath": ("", _C.toString),
}
_CLASSIFIER = {"probabilityCol": ("probability", _C.toString), "rawPredictionCol": ("rawPrediction", _C.toString), "threshold": (0.5, _C.toFloat)}


class _Shared(Params):
    """The params, with a setter and a getter for each."""

    _extra: dict = {}

    def __init__(self, **given):
        super().__init__()
        self._setDefault(**{name: list(v) if isinstance(v, tuple) else v for name, (_, v) in _TRAIN.items()})
        self._setDefault(**{name: d for name, (d, _) in {**_OWN, **self._extra}.items()})
        self._set(**given)

    def train_params(self) -> TrainParams:
        return TrainParams(**{key: self.getOrDefault(name) for name, (key, _) in _TRAIN.items()})


def _with_params(cls):
    names = {n: (_LISTS.get(k) or _KINDS[type(v)]) for n, (k, v) in _TRAIN.items()} | {n: c for n, (_, c) in {**_OWN, **cls._extra}.items()}
    for name, convert in names.items():
        setattr(cls, name, Param(Params._dummy(), name, name, typeConverter=convert))
        title = name[0].upper() + name[1:]
        setattr(cls, f"set{title}", lambda self, value, name=name: self._set(**{name: value}))
        setattr(cls, f"get{title}", lambda self, name=name: self.getOrDefault(name))
    return cls


class _Boosted(_Shared, Estimator, MLWritable, MLReadable):
    def fit(self, dataset: DataFrame, valid: DataFrame | dict | None = None, metrics: list | None = None, callbacks: list = ()):
        """Fit on ``dataset``; with a second DataFrame, metrics and early stopping use it."""
        if valid is not None and not isinstance(valid, DataFrame):
            return super().fit(dataset, valid)
        return self._fit(dataset, valid, metrics, callbacks)

    def _loss(self, dataset: DataFrame):
        return objective(self.getOrDefault("objectiveFunc")), 0

    def _metrics(self, loss) -> list:
        return [metric(m) for m in self.getOrDefault("evaluateFunc")]

    def _fit(self, dataset: DataFrame, valid: DataFrame | None = None, metrics: list | None = None, callbacks: list = ()):
        get = self.getOrDefault
        loss, classes = self._loss(dataset)
        metrics = self._metrics(loss) if metrics is None else metrics
        calls = list(callbacks)
        if get("earlyStopIters") > 0 and valid is not None:
            calls.append(EarlyStop(metrics, get("earlyStopIters")))
        if get("modelCheckpointPath") and get("modelCheckpointInterval") > 0:
            calls.append(Checkpoint(lambda m, path: self._model(m, classes).write().overwrite().save(path), get("modelCheckpointPath"), get("modelCheckpointInterval")))
        initial = type(self)._model_type.load(get("initialModelPath")).boosted if get("initialModelPath") else None
        boosted, history = fit(
            dataset, get("featuresCol"), get("labelCol"), get("weightCol") or None, self.train_params(), loss, valid, metrics, calls, initial, get("keyCol") or None
        )
        model = self._model(boosted, classes)
        model.history = history
        return model

    def _model(self, boosted: BoostedModel, classes: int):
        model = type(self)._model_type(boosted, classes)
        model._resetUid(self.uid)
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class _BoostedModel(_Shared, Model, MLWritable, MLReadable):
    def __init__(self, boosted: BoostedModel | None = None, num_classes: int = 0):
        super().__init__()
        self.boosted, self.num_classes, self.history = boosted, num_classes, {}

    numTrees = property(lambda self: self.boosted.num_trees)
    numLeaves = property(lambda self: self.boosted.num_leaves)
    numNodes = property(lambda self: self.boosted.num_nodes)
    depths = property(lambda self: self.boosted.depths)
    weights = property(lambda self: list(self.boosted.weights))

    @property
    def featureImportances(self) -> SparseVector:
        found = self.boosted.importances(self.getOrDefault("importanceType"), self.getOrDefault("firstTrees"))
        return SparseVector(self.boosted.discretizer.size, found)

    def _features(self, dataset: DataFrame):
        return feature_array(dataset, self.getOrDefault("featuresCol"))

    def leaf(self, dataset: DataFrame) -> DataFrame:
        """Adds leafCol: the leaf of each tree, or with enableOneHot a sparse vector over all leaves."""
        name, first = self.getOrDefault("leafCol"), self.getOrDefault("firstTrees")
        if not name:
            return dataset
        cols = self._features(dataset)
        if not self.getOrDefault("enableOneHot"):
            return dataset.withColumn(name, array_to_vector(self.boosted.leaf(cols, first).cast("array<double>")))
        places, size = self.boosted.leaf_places(cols, first)
        temporary = f"places-{uuid.uuid4().hex}"
        own = F.col(f"`{temporary}`")
        one_hot = F.transform(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)), lambda i: F.array_contains(own, i).cast("double"))
        dense = array_to_vector(one_hot if size else F.array().cast("array<double>"))
        dense = dataset.withColumn(temporary, places).withColumn(f"{temporary}-vector", dense).drop(temporary)
        # The assembler keeps a vector in its smaller form.
        out = VectorAssembler(inputCols=[f"{temporary}-vector"], outputCol=f"{temporary}-out").transform(dense.drop(name))
        return out.drop(f"{temporary}-vector").withColumnRenamed(f"{temporary}-out", name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark.sparkContext)
        self.model.boosted.save(spark, f"{path}/model")
        other = [("type", json.dumps(type(self.model).__name__)), ("numClasses", json.dumps(self.model.num_classes)), ("time", json.dumps(time.time()))]
        spark.createDataFrame(other, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/other")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        other = {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/other").collect()}
        model = self.cls(BoostedModel.load(spark, f"{path}/model"), other["numClasses"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


@_with_params
class BoostedRegressionModel(_BoostedModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = self.boosted.predict(self._features(dataset), self.getOrDefault("firstTrees"))
        return self.leaf(dataset.withColumn(self.getOrDefault("predictionCol"), score[0]))


@_with_params
class BoostedRegressor(_Boosted):
    _model_type = BoostedRegressionModel

    @keyword_only
    def __init__(self, **given):
        super().__init__(**given)


@_with_params
class BoostedClassificationModel(_BoostedModel):
    _extra = _CLASSIFIER

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        two = self.boosted.objective.size == 1
        raw = self.boosted.predict_raw(self._features(dataset), get("firstTrees"))
        own = {c: f"{c}-{uuid.uuid4().hex}" for c in ("raw", "both", "p", "e")}  # no column of the input has such a name
        col = {c: F.col(f"`{name}`") for c, name in own.items()}
        out = dataset.withColumn(own["raw"], raw)
        if two:
            r = col["raw"][0]
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-r))
            out = out.withColumns({own["both"]: F.array(-r, r), own["p"]: F.array(F.lit(1.0) - p, p)})
        else:
            most = F.array_max(col["raw"])
            out = out.withColumns({own["both"]: col["raw"], own["e"]: F.transform(col["raw"], lambda x: F.exp(x - most))})
            total = F.aggregate(col["e"], F.lit(0.0), lambda a, x: a + x)
            out = out.withColumn(own["p"], F.transform(col["e"], lambda x: x / total))
        if get("rawPredictionCol"):
            out = out.withColumn(get("rawPredictionCol"), array_to_vector(col["both"]))
        if get("probabilityCol"):
            out = out.withColumn(get("probabilityCol"), array_to_vector(col["p"]))
        if get("predictionCol"):
            best = F.array_position(col["p"], F.array_max(col["p"])) - 1
            out = out.withColumn(get("predictionCol"), best.cast("double"))
        return self.leaf(out.drop(*own.values()))


@_with_params
class BoostedClassifier(_Boosted):
    _extra = _CLASSIFIER
    _model_type = BoostedClassificationModel

    @keyword_only
    def __init__(self, **given):
        super().__init__(**({"objectiveFunc": "logistic"} | given))

    def _loss(self, dataset: DataFrame):
        label = F.col(self.getOrDefault("labelCol")).cast("double")
        found = sorted(r[0] for r in dataset.select(label.alias("y")).distinct().limit(10_001).collect())
        if not found or found != [float(i) for i in range(len(found))]:
            raise ValueError("labels must be 0 .. k - 1")
        name = self.getOrDefault("objectiveFunc")
        if name == "logistic" and len(found) > 2:
            raise ValueError("logistic loss is for two classes; set objectiveFunc to softmax")
        return objective(name, len(found)), max(2, len(found))

    def _metrics(self, loss) -> list:
        return [metric(m, self.getOrDefault("threshold")) for m in self.getOrDefault("evaluateFunc")]
