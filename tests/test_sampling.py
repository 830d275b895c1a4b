"""Exact shares of many units: results do not depend on how many there are."""

import numpy as np
import pytest

from arborlane.operators import sampling


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More parts, and more blocks of 16 keys, than 65,536, some keys in blocks of several parts."""
    path = tmp_path_factory.mktemp("many")
    rows = spark.range(70_000, numPartitions=3).selectExpr(
        "id * 16 + if(id % 10 = 0, 15, 0) + 1 as p_partkey", "cast(id * 31 % 50 + 1 as int) as p_size", "cast(900 + id % 1117 as double) as p_retailprice"
    )
    rows.write.parquet(f"{path}/part.parquet")
    events = spark.range(5_000, numPartitions=3).selectExpr("id as event_id", "cast(id * 7919 % 1013 as double) / 7 as value")
    events.write.parquet(f"{path}/events.parquet")
    return str(path)


def _same(spark, path, name):
    duckdb = pytest.importorskip("duckdb")
    from arborlane.plans.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got, rel = QUERIES[name](spark, path), con.sql(ORACLE_SQL[name])
    a, b = sorted(map(tuple, got.select(*rel.columns).collect())), sorted(rel.fetchall())
    assert len(a) == len(b)
    np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-6, atol=2e-4)


@pytest.mark.parametrize("name", ["sample_rows", "sample_blocks", "boost_forest_sampled"])
def test_shares_of_many_units_are_exact(spark, many, name):
    _same(spark, many, name)


def test_gradient_sampling_of_dealt_rows(spark, many, monkeypatch):
    """goss_weights on a table that the driver may not hold."""
    monkeypatch.setattr("arborlane.plans.boosting.LOCAL_BYTES", 0)
    _same(spark, many, "goss_weights")


def test_selection_is_exact(monkeypatch):
    monkeypatch.setattr(sampling, "FEW_KEYS", 5)
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.repeat(rng.integers(0, 40, 10).astype(np.uint64), 300), np.zeros(9, np.uint64)]
    for place in (1, 5, 9):
        scan = lambda pick, of: {i: sampling.tallied([np.unique(pick(i, part), return_counts=True) for part in np.array_split(keys[i], 4)]) for i in of}
        places = [place * 300, place * 300, place]
        assert sampling.kth_least(scan, places) == [int(np.sort(k)[p - 1]) for k, p in zip(keys, places, strict=True)]


def test_share_is_that_of_the_rate_as_written():
    assert sampling.share(1_000_000_000, 0.3) == 300_000_000 and sampling.share(7, 0.1) == 1 and sampling.share(0, 0.5) == 0


def test_no_split_without_holding_rows(spark, many, monkeypatch):
    """split_none: the rows of its four tables stay in tasks."""
    from arborlane.plans.boosting import Booster
    from arborlane.plans.registry import QUERIES

    monkeypatch.setattr(Booster, "_hold", lambda self: pytest.fail("the driver holds the rows"))
    assert [tuple(r) for r in QUERIES["split_none"](spark, many).collect()] == [(0,)]
