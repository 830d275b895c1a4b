import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlane import ml
from arborlane.functions import metrics as M
from arborlane.functions.objectives import Scalar, Softmax
from arborlane.model import BoostedModel
from arborlane.params import Params
from arborlane.plans.boosting import new_weights
from arborlane.plans.callbacks import Custom, EarlyStop, Recorder
from arborlane.plans.fit import fit


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = 2 * (x[:, 0] > 0.3) - x[:, 1] + 0.1 * rng.normal(size=400)
    rows = [(i, *map(float, x[i]), float(y[i]), float(y[i] > 0.5), float(1 + i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double, w double").repartition(3, "id")
    return df.withColumn("a", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("a"))).cache()


NAMES = ["a", "b", "c"]


def _fit(data, label="y", loss="square", **params):
    more = {k: params.pop(k) for k in ("metrics", "callbacks", "valid", "initial", "weight") if k in params}
    return fit(data, NAMES, label, params=Params(**({"max_iter": 3, "max_depth": 3, "max_bins": 16} | params)), loss=loss, key="id", **more)


def _reference(data, rounds=3, depth=3, max_bins=16, step=0.1, lam=1.0):
    """Square-loss boosting by loops over numpy, sharing no code with the library."""
    rows = data.orderBy("id").toPandas()
    x = rows[NAMES].to_numpy(float)
    bins = np.zeros(x.shape, int)
    for j in range(3):
        v = x[:, j]
        ok = np.isfinite(v)
        lo, hi = v[ok].min(), v[ok].max()
        width = (hi - lo) / (max_bins - 2)
        for i in range(len(v)):
            if ok[i]:
                bins[i, j] = 1 if v[i] <= lo + width / 2 else min(1 + int(np.ceil((v[i] - lo - width / 2) / width)), max_bins - 1)
    y = rows.y.to_numpy()
    f = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = f - y
        groups = [np.arange(len(y))]
        value = np.zeros(len(y))
        for _ in range(depth):
            nxt = []
            for rows_ in groups:
                best = None
                G, n = g[rows_].sum(), len(rows_)
                for j in range(3):
                    b = bins[rows_, j]
                    for right in (0, 1):
                        if right and not (b == 0).any():
                            continue
                        for t in range(0, max_bins):
                            if not (b == t).any() and not (right and t == 0):
                                continue
                            if right and t == 0:
                                continue
                            go = (b <= t) & (b > 0) if right else b <= t
                            m = go.sum()
                            if m < 1 or n - m < 1:
                                continue
                            a = g[rows_][go].sum()
                            gain = 0.5 * (a * a / (m + lam) + (G - a) ** 2 / (n - m + lam) - G * G / (n + lam))
                            if gain >= 0 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, go, -a / (m + lam), -(G - a) / (n - m + lam))
                if best:
                    nxt += [rows_[best[1]], rows_[~best[1]]]
                    value[rows_[best[1]]], value[rows_[~best[1]]] = best[2], best[3]
            groups = nxt
        f = f + step * value
    return f


def _scores(data, model):
    cols = [F.col(c) for c in NAMES]
    return np.array([r[0] for r in data.orderBy("id").select(model.predict(cols)[0]).collect()])


def test_equals_a_plain_trainer(data):
    model, history = _fit(data, metrics=["mse", "r2"])
    np.testing.assert_allclose(_scores(data, model), _reference(data), rtol=1e-9)
    losses = [h["mse"] for h in history["train"]]
    assert losses == sorted(losses, reverse=True) and model.num_trees == 3


@pytest.mark.parametrize("params", [{"histogram_computation_type": "subtract"}, {"histogram_computation_type": "vote"}, {"parallelism_type": "feature"}, {"checkpoint_interval": 1}])
def test_strategies_give_the_same_trees(data, params):
    base, _ = _fit(data)
    other, _ = _fit(data, **params)
    np.testing.assert_allclose(_scores(data, other), _scores(data, base), rtol=1e-9)


@pytest.mark.parametrize("params", [
    {"boost_type": "dart", "drop_rate": 0.5, "drop_skip": 0.0, "seed": 4}, {"forest_size": 2, "col_sample_rate_by_tree": 0.7}, {"leaf_boosting": True},
    {"sub_sample_type": "goss"}, {"sub_sample_type": "row", "sub_sample_rate_by_tree": 0.6}, {"sub_sample_type": "block", "block_size": 16, "sub_sample_rate_by_tree": 0.6},
    {"sub_sample_type": "partition", "sub_sample_rate_by_tree": 0.9}, {"sub_sample_rate_by_node": 0.7}, {"col_sample_rate_by_node": 0.5}, {"cat_cols": (2,), "discretization_type": "depth:round"},
    {"reg_alpha": 0.5, "max_leaves": 4}, {"zero_as_missing": True},
])
def test_variants_learn(data, params):
    model, history = _fit(data, metrics=["r2"], step_size=0.3, **params)
    assert history["train"][-1]["r2"] > 0.2
    if "max_leaves" in params:
        assert max(model.num_leaves) <= 4


def test_search_in_tasks_equals_search_on_the_driver(data, monkeypatch):
    from arborlane.plans import boosting

    base, _ = _fit(data)
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 0)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    other, _ = _fit(data)
    np.testing.assert_allclose(_scores(data, other), _scores(data, base), rtol=1e-9)


def test_node_hessians_add_up(data):
    model, _ = _fit(data)
    for tree in model.trees:
        for node in tree.nodes.values():
            for child in (node.left, node.right):
                if child is not None and child.split is not None:
                    h = node.split.hl if child is node.left else node.split.hr
                    assert child.split.hl + child.split.hr == pytest.approx(h)


def test_weights_count_as_repetition(data):
    once, _ = _fit(data, weight="w")
    twice, _ = _fit(data.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))))
    np.testing.assert_allclose(_scores(data, once), _scores(data, twice), rtol=1e-6)


def test_warm_start_equals_long_run(data):
    long, _ = _fit(data, max_iter=4)
    first, _ = _fit(data, max_iter=2)
    both, _ = _fit(data, max_iter=2, initial=first)
    np.testing.assert_allclose(_scores(data, both), _scores(data, long), rtol=1e-9)


def test_save_and_load(spark, data, tmp_path):
    model, _ = _fit(data, cat_cols=(2,), discretization_type="width:round")
    model.save(spark, str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m"))
    assert again.trees == model.trees and again.weights == model.weights and again.discretizer == model.discretizer
    assert sum(model.importances("numsplits").values()) == sum(len(t.nodes) - len(t.leaves) for t in model.trees)


def test_leaves(data):
    model, _ = _fit(data)
    cols = [F.col(c) for c in NAMES]
    places, size = model.leaf_places(cols)
    rows = data.select(model.leaf(cols).alias("l"), places.alias("p")).collect()
    assert size == sum(model.num_leaves)
    shift = np.concatenate([[0], np.cumsum(model.num_leaves)[:-1]])
    assert all(list(np.array(r["l"]) + shift) == r["p"] for r in rows)
    np.testing.assert_allclose(_scores(data, model)[0], model.objective.transform(model.raw_of(model.bin(np.array([data.orderBy("id").select(*NAMES).toPandas().iloc[0].to_numpy(float)]))))[0, 0])


def test_dart_weights():
    p = Params(boost_type="dart", step_size=0.1)
    assert new_weights([1.0, 1.0], 1, [], p, 1) == [1.0, 1.0, 1.0]
    assert new_weights([1.0, 1.0], 1, [0], p, 1) == pytest.approx([1 / 1.1, 1.0, 1 / 1.1])
    assert new_weights([0.1], 2, [], Params(step_size=0.2), 1) == [0.1, 0.2, 0.2]


def test_callbacks(data):
    rec = Recorder()
    stop = Custom(lambda p, m, i, tr, va: p.update(step_size=0.05) or i >= 2)
    model, _ = _fit(data, max_iter=5, metrics=["mse"], callbacks=[rec, stop])
    assert model.num_trees == 2 and len(rec.train) == 2 and model.weights == [0.1, 0.05]
    early = EarlyStop([M.metric("mse")], 1)
    assert not early.compute(None, None, 1, [], [{"mse": 2.0}]) and early.compute(None, None, 2, [], [{"mse": 2.0}, {"mse": 2.0}])
    assert not early.compute(None, None, 2, [], [{"mse": 2.0}, {"mse": 1.0}])


def test_custom_objective(data):
    model, _ = _fit(data, loss=Scalar(lambda y, s: (s - y, 1.0)))
    base, _ = _fit(data)
    np.testing.assert_allclose(_scores(data, model), _scores(data, base))


def test_softmax_once():
    np.testing.assert_allclose(Softmax(3).transform(np.array([[1.0, 0, -1]]))[0], [0.6652, 0.2447, 0.0900], atol=1e-4)
    assert np.isfinite(Softmax(2).transform(np.array([[1e4, 0.0]]))).all()


def test_constant_label(spark):
    df = spark.createDataFrame([(i, float(i), 2.0) for i in range(20)], "id long, a double, y double")
    model, _ = fit(df, ["a"], "y", params=Params(max_iter=2, max_depth=2))
    assert {n.prediction for t in model.trees for n in t.leaves} <= {0.0, -0.0}
    with pytest.raises(ValueError):
        fit(df.withColumn("y", F.lit(1.0)), ["a"], "y", params=Params(max_iter=1), loss="logistic")


def test_metrics():
    w, y, s = np.array([1.0, 3.0]), np.array([[0.0], [4.0]]), np.array([[0.0], [2.0]])
    assert M.metric("mse").value(M.metric("mse").partial(w, y, s, s)) == 3.0
    p, t = np.array([[0.9], [0.8], [0.3], [0.3]]), np.array([[1.0], [0.0], [1.0], [0.0]])
    one = np.ones(4)
    auc = M.metric("auroc")
    assert auc.value(auc.partial(one, t, p, p)) == pytest.approx(0.625)
    assert M.metric("error@0.85").value(M.metric("error@0.85").partial(one, t, p, p)) == 0.25


def test_sparse_rows_give_the_same_trees(spark, data, monkeypatch):
    """Vectors whose zeros are missing keep filled cells alone; scores are those of dense rows, held or not (equal gains may
    take another column that parts the same rows)."""
    from pyspark.ml.linalg import Vectors

    from arborlane.plans import boosting

    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 40)) < 0.1, rng.normal(size=(300, 40)).round(2), 0.0)
    y = x[:, 0] - 2 * (x[:, 7] > 0) + 0.1 * rng.normal(size=300)
    rows = [(i, Vectors.sparse(40, np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) if i % 3 else Vectors.dense(x[i].tolist()), x[i].tolist(), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, ["id", "v", "a", "y"]).repartition(3, "id")
    params = Params(max_iter=3, max_depth=3, max_bins=16, zero_as_missing=True, step_size=0.5, top_k=40, min_node_hess=3.0)
    for bytes_ in (boosting.LOCAL_BYTES, 0):
        monkeypatch.setattr(boosting, "LOCAL_BYTES", bytes_)
        for kind in ("basic", "subtract"):
            params.update(histogram_computation_type=kind, min_node_hess=3.0)
            sparse, _ = fit(df, "v", "y", params=params, key="id")
            dense, _ = fit(df, "a", "y", params=params, key="id")
            got = [r[0] for r in df.orderBy("id").select(sparse.predict(F.col("a"))[0]).collect()]
            want = [r[0] for r in df.orderBy("id").select(dense.predict(F.col("a"))[0]).collect()]
            np.testing.assert_allclose(got, want, rtol=1e-9)


def test_held_and_dealt_rows_give_the_same_trees(data, monkeypatch):
    from arborlane.plans import boosting

    variants = [{}, {"leaf_boosting": True}, {"boost_type": "dart", "drop_rate": 0.5, "drop_skip": 0.0, "seed": 4}, {"sub_sample_type": "goss", "checkpoint_interval": 1},
                {"sub_sample_type": "row", "sub_sample_rate_by_tree": 0.6}, {"forest_size": 2, "col_sample_rate_by_node": 0.5, "sub_sample_rate_by_node": 0.7}]
    held = [_scores(data, _fit(data, metrics=["mse"], **v)[0]) for v in variants]
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 0)
    for v, scores in zip(variants, held, strict=True):
        model, history = _fit(data, metrics=["mse"], **v)
        np.testing.assert_allclose(_scores(data, model), scores, rtol=1e-9)
        assert len(history["train"]) == 3


@pytest.mark.parametrize("params", [{"leaf_boosting": True}, {"sub_sample_type": "block", "block_size": 16, "sub_sample_rate_by_tree": 0.6, "forest_size": 2},
                                    {"boost_type": "dart", "drop_rate": 0.5, "drop_skip": 0.0, "seed": 4}, {"sub_sample_type": "goss", "checkpoint_interval": 1}])
def test_columns_dealt_vertically_give_the_same_trees(data, monkeypatch, params):
    from arborlane.plans import vertical

    monkeypatch.setattr(vertical, "BLOCK_ROWS", 37)
    monkeypatch.setattr(vertical, "GROUP_COLUMNS", 2)
    monkeypatch.setattr(vertical, "STATE_BYTES", 0)  # states meet the columns by block
    base, _ = _fit(data, **params)
    other, _ = _fit(data, parallelism_type="feature", **params)
    np.testing.assert_allclose(_scores(data, other), _scores(data, base), rtol=1e-9)


def test_histograms_are_combined_in_groups(data, monkeypatch):
    from arborlane.plans import boosting

    base, _ = _fit(data)
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 0)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    plain = boosting.Booster._combined

    def many(self, hists):
        self.parts, self.cores = 40, 4
        return plain(self, hists)

    monkeypatch.setattr(boosting.Booster, "_combined", many)
    other, _ = _fit(data)
    np.testing.assert_allclose(_scores(data, other), _scores(data, base), rtol=1e-9)


def test_batch_metrics_and_errors_of_checkpoints(data, tmp_path):
    from arborlane.plans.callbacks import Checkpoint

    worst = M.Batch("worst", lambda df: df.select(F.max(F.abs(F.col("label")[0] - F.col("score")[0]))).first()[0])
    _, history = _fit(data, metrics=["mse", worst])
    assert list(history["train"][0]) == ["mse", "worst"] and history["train"][-1]["worst"] > 0
    saved = []
    _fit(data, callbacks=[Checkpoint(lambda m, path: saved.append((m.num_trees, path)), "p", 2)])
    assert saved == [(2, "p/model-2-2")]

    def fail(m, path):
        raise OSError("no room")

    with pytest.raises(OSError, match="no room"):
        _fit(data, callbacks=[Checkpoint(fail, "p", 1)])


@pytest.mark.parametrize("bad", [{"max_bins": 3}, {"max_depth": 0}, {"max_depth": 31}, {"step_size": 0}, {"discretization_type": "wide"}, {"cat_cols": (1,), "rank_cols": (1,)}, {"leaf_boosting": True, "histogram_computation_type": "subtract"}, {"max_drop": 1, "min_drop": 2}])
def test_params_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_estimators(spark, data, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    features = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep")
    est = ml.BoostedClassifier(labelCol="z", maxIter=3, maxDepth=3, evaluateFunc=["logloss", "auroc"], leafCol="leaf", keyCol="id").setEnableOneHot(True)
    est.setModelCheckpointPath(str(tmp_path / "c")).setModelCheckpointInterval(2)
    model = Pipeline(stages=[features, est]).fit(data)
    out = model.transform(data)
    row = out.first()
    assert row["probability"].values.sum() == pytest.approx(1) and row["leaf"].size == sum(model.stages[1].numLeaves)
    model.write().overwrite().save(str(tmp_path / "p"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.transform(data).select("prediction").collect() == out.select("prediction").collect()
    saved = ml.BoostedClassificationModel.load(str(tmp_path / "c" / "model-2-2"))
    assert saved.numTrees == 2 and saved.num_classes == 2
    est2 = ml.BoostedRegressor(labelCol="y", maxIter=8, earlyStopIters=1, evaluateFunc=["rmse"], featuresCol="features", stepSize=3.0)
    both = features.transform(data)
    assert est2.fit(both, both).numTrees < 8


def test_stream_scoring(spark, data, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    from arborlane.streaming.scoring import score_stream

    df = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(data).select("id", F.col("y").alias("label"), "features")
    model = ml.BoostedRegressor(maxIter=2).fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").select("prediction").collect()
    assert got == model.transform(df).orderBy("id").select("prediction").collect()
    with pytest.raises(ValueError):
        score_stream(df, model, "x", "y")
