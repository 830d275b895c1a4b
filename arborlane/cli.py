"""Run a fit from a config file of ``key=value`` lines; values are JSON. ``python -m arborlane.cli FILE``.

task classification or regression, inputType parquet or libsvm[@N], trainPath, testPath, modelSavePath, and any param.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from arborlane.ml import BoostedClassifier, BoostedRegressor
from arborlane.session import repo_on_workers
from arborlane.sources.tables import load

RESERVED = ("task", "inputType", "trainPath", "testPath", "modelSavePath")


def parse(text: str) -> dict:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            key, eq, value = line.partition("=")
            if not eq:
                raise ValueError(f"not key=value: {line!r}")
            out[key.strip()] = json.loads(value)
    return out


def run(spark: SparkSession, config: dict):
    kinds = {"classification": BoostedClassifier, "regression": BoostedRegressor}
    if config.get("task") not in kinds:
        raise ValueError("task must be classification or regression")
    repo_on_workers(spark)
    estimator = kinds[config["task"]](**{k: v for k, v in config.items() if k not in RESERVED})
    kind = config.get("inputType", "parquet")
    train = load(spark, kind, config["trainPath"])
    test = load(spark, kind, config["testPath"]) if config.get("testPath") else None
    model = estimator.fit(train, test)
    if config.get("modelSavePath"):
        model.write().overwrite().save(config["modelSavePath"])
    return model


if __name__ == "__main__":
    with open(sys.argv[1], encoding="utf-8") as f:
        found = run(SparkSession.builder.appName("arborlane").getOrCreate(), parse(f.read()))
    print(json.dumps({"trees": found.numTrees, "history": found.history}))
