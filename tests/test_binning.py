import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlane.operators.binning import Discretizer, cast_bin, sparsity
from arborlane.params import Params

VALUES = [None, math.nan, math.inf, -math.inf, -3.2, -0.5, 0.0, 0.5, 1.0, 1.49, 2.5, 7.0, 100.0]


def _df(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("kind", ["width", "depth", "floor", "ceil", "round"])
@pytest.mark.parametrize("zero", [False, True])
def test_columns_equal_numpy(spark, kind, zero):
    df = _df(spark, VALUES)
    disc, _ = Discretizer.fit(df, [F.col("v")], Params(max_bins=8, discretization_type=kind, zero_as_missing=zero))
    got = [r[0] for r in df.select(disc.bin(0, F.col("v"))).collect()]
    expected = disc.bin_array(0, np.array([math.nan if v is None else v for v in VALUES])).tolist()
    assert got == expected
    assert Discretizer.from_dict(disc.to_dict()) == disc


def test_width_edges(spark):
    df = _df(spark, [0.0, 1.0, 2.0, 7.0, 14.0])
    disc, _ = Discretizer.fit(df, [F.col("v")], Params(max_bins=16))
    c = disc.columns[0]
    assert (c["start"], c["step"], c["bins"]) == (0.5, 1.0, 15)
    assert disc.bin_array(0, np.array([0, 0.5, 1.5, 14, 99, math.nan])).tolist() == [1, 1, 2, 15, 15, 0]


def test_depth_edges():
    disc = Discretizer(8, "depth", columns=[{"kind": "depth", "splits": [1.0, 2.0, 5.0]}])
    assert disc.bin_array(0, np.array([0, 1, 1.5, 2, 5, 6])).tolist() == [1, 1, 2, 2, 3, 4]


def test_all_missing_and_constant(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    disc, _ = Discretizer.fit(df, [F.col("a"), F.col("b")], Params(max_bins=8))
    assert df.select(disc.transform([F.col("a"), F.col("b")])).first()[0] == [0, 1]
    wide = Discretizer(8, "width", columns=disc.columns)
    with pytest.raises(ValueError):
        wide.transform([F.col("a")])


def test_wide_equals_narrow(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in r],) for r in rng.normal(size=(50, 30))]
    df = spark.createDataFrame(rows, "x array<double>")
    cols = [F.get("x", F.lit(i)) for i in range(30)]
    a, _ = Discretizer.fit(df, cols, Params(max_bins=16))
    b, _ = Discretizer.fit(df, cols, Params(max_bins=16), array=F.col("x"))
    assert a == b


def test_cast_keeps_negatives_missing(spark):
    df = _df(spark, [-1.0, -0.4, 0.4, 0.5, 1e18])
    assert [r[0] for r in df.select(cast_bin(F.col("v"), "round", 10)).collect()] == [0, 0, 0, 1, 9]


def test_sparsity(spark):
    df = spark.createDataFrame([([0, 1],), ([0, 0],)], "bins array<int>")
    assert sparsity(df, "bins", 2) == 0.75


def test_tables_round_trip(spark, tmp_path):
    from arborlane.sources.tables import load_tables, save_tables

    disc = Discretizer(8, "depth:floor", True, (1,), [{"kind": "depth", "splits": [1.0, 2.0]}, {"kind": "cast", "mode": "floor"}, {"kind": "width", "start": 0.5, "step": 0.1, "bins": 7}])
    save_tables(disc.tables(spark), str(tmp_path))
    assert Discretizer.from_tables(load_tables(spark, ["params", "nonNumCols", "colDiscretizers"], str(tmp_path))) == disc
