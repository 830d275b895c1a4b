import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_registry_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from arborlane.plans.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "labels", "embeddings", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(round(float(r[i]), 5) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in data), key=repr)

    for name, sql in ORACLE_SQL.items():
        got, rel = QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(rel.columns), name
        a, b = rows(got.columns, map(tuple, got.collect())), rows(list(rel.columns), rel.fetchall())
        assert len(a) == len(b), name
        for x, y in zip(a, b, strict=True):
            assert all(u == pytest.approx(v, rel=1e-5, abs=1e-4) if isinstance(u, float) else u == v for u, v in zip(x, y, strict=True)), name


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
