"""Queries by name, on the driver's tables, and the SQL of those that SQL can express.

The queries run what fits and models run; the SQL is written from the definitions and shares nothing with it but the salts of
sampling hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlane import ml
from arborlane.cli import run as run_config
from arborlane.functions import metrics as M
from arborlane.functions.objectives import Huber, Logistic, Objective, Scalar, Softmax, Square
from arborlane.model import BoostedModel
from arborlane.operators.binning import Discretizer, cast_bin, clean
from arborlane.operators.sampling import choose_columns, choose_units, keep_array
from arborlane.operators.splits import Split, candidates
from arborlane.params import Params
from arborlane.plans.boosting import Booster, Round, Rows, hist_batches, long_histograms, new_weights, prepare, summed
from arborlane.plans.callbacks import Checkpoint, Custom, EarlyStop, Recorder
from arborlane.plans.fit import _means, fit
from arborlane.plans.oracles import FitSql, hashed, logistic, mix64, seed_of, softmax, width_bins
from arborlane.session import materialise, tasks_for, temporary
from arborlane.sources.tables import load, load_tables, save_tables
from arborlane.streaming.scoring import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LINE = ["l_quantity", "l_discount", "l_tax"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _binned(df: DataFrame, columns: list[str], params: Params, exact: bool = False) -> DataFrame:
    cols = [F.col(c) for c in columns]
    disc, _ = Discretizer.fit(df, cols, params, exact)
    return df.withColumn("bins", disc.transform(cols))


def _bin_counts(df: DataFrame) -> DataFrame:
    cells = df.select(F.posexplode("bins").alias("col_id", "bin"))
    return cells.groupBy("col_id", "bin").agg(F.count("*").alias("n"))


_LINE_CELLS = """p AS (SELECT 0 AS col_id, CAST(l_quantity AS DOUBLE) AS v, l_extendedprice AS y FROM lineitem UNION ALL
  SELECT 1, l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_tax, l_extendedprice FROM lineitem)"""
_WIDTH = """e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM p GROUP BY col_id),
q AS (SELECT p.col_id, CASE WHEN v IS NULL THEN 0 WHEN step = 0 OR v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin, y
  FROM p JOIN e ON p.col_id = e.col_id)"""


@query(f"WITH {_LINE_CELLS}, {_WIDTH} SELECT col_id, bin, COUNT(*) AS n FROM q GROUP BY ALL")
def bin_width(spark, sf_dir):
    return _bin_counts(_binned(_table(spark, sf_dir, "lineitem"), LINE, Params(max_bins=16)))


@query(f"""WITH {_LINE_CELLS}, c AS (SELECT col_id, CASE WHEN v = 0 THEN NULL ELSE v END AS v, y FROM p),
e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM c GROUP BY col_id)
SELECT c.col_id, CASE WHEN v IS NULL THEN 0 WHEN v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin, COUNT(*) AS n
FROM c JOIN e ON c.col_id = e.col_id GROUP BY ALL""")
def bin_zero_as_missing(spark, sf_dir):
    return _bin_counts(_binned(_table(spark, sf_dir, "lineitem"), LINE, Params(max_bins=16, zero_as_missing=True)))


@query("""WITH s AS (SELECT UNNEST(list_distinct(quantile_cont(value, [""" + ", ".join(f"{(i + 0.5) / 14}" for i in range(14)) + """]))) AS s FROM events)
SELECT 0 AS col_id, CAST(1 + (SELECT COUNT(*) FROM s WHERE s < value) AS INT) AS bin, COUNT(*) AS n FROM events GROUP BY ALL""")
def bin_depth_exact(spark, sf_dir):
    return _bin_counts(_binned(_table(spark, sf_dir, "events"), ["value"], Params(max_bins=16, discretization_type="depth"), exact=True))


def _cast_query(mode: str, whole: str) -> None:
    def run(spark, sf_dir):
        df = _table(spark, sf_dir, "events").select(cast_bin(F.col("value") / 7, mode, 32).alias("bin"))
        return df.groupBy("bin").agg(F.count("*").alias("n"))

    run.__name__ = f"bin_{mode}"
    query(f"SELECT CAST(GREATEST(0, LEAST({whole}, 31)) AS INT) AS bin, COUNT(*) AS n FROM events GROUP BY ALL")(run)


_cast_query("floor", "FLOOR(value / 7)")
_cast_query("ceil", "CEIL(value / 7)")
_cast_query("round", "FLOOR(value / 7 + 0.5)")


@query("SELECT ROUND(SUM(l_quantity * l_extendedprice) / SUM(l_quantity), 6) AS mean FROM lineitem")
def label_mean(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    _, found = Discretizer.fit(df, [F.col("l_tax")], Params(max_bins=16), extra=[F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")])
    return spark.createDataFrame([(float(found[0]),)], "mean double").select(F.round("mean", 6).alias("mean"))


@query("SELECT quality AS label, CAST(COUNT(*) AS DOUBLE) AS weight FROM labels GROUP BY ALL")
def class_weights(spark, sf_dir):
    """Class shares as the base score of softmax sees them, times the rows."""
    df = _table(spark, sf_dir, "labels")
    _, found = Discretizer.fit(df, [F.col("doc_id")], Params(discretization_type="round"), extra=[*_means(Softmax(2), F.col("quality"), F.lit(1.0)), F.count("*")])
    return spark.createDataFrame([(k, float(found[k] * found[2])) for k in (0, 1)], "label int, weight double").select("label", F.round("weight", 6).alias("weight"))


@query("SELECT ROUND(SUM(l_quantity * l_tax) / SUM(l_quantity), 9) AS mean FROM lineitem")
def label_mean_alone(spark, sf_dir):
    """Bins that need no fit: the label's mean is the only aggregate."""
    _, found = Discretizer.fit(_table(spark, sf_dir, "lineitem"), [F.col("l_quantity")], Params(discretization_type="floor"), extra=_means(Square(), F.col("l_tax"), F.col("l_quantity")))
    return spark.createDataFrame([(float(found[0]),)], "mean double").select(F.round("mean", 9).alias("mean"))


@query("SELECT ROUND(AVG((CASE WHEN l_discount = 0 THEN 1.0 ELSE 0 END + CASE WHEN l_tax = 0 THEN 1.0 ELSE 0 END) / 2), 9) AS sparsity FROM lineitem")
def sparsity(spark, sf_dir):
    from arborlane.operators.binning import sparsity as of

    df = _binned(_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], Params(max_bins=16, zero_as_missing=True))
    return spark.createDataFrame([(of(df, "bins", 2),)], "sparsity double").select(F.round("sparsity", 9).alias("sparsity"))


def _gradients(spark, df: DataFrame, loss: Objective, key: str, label: Column, raw: list[Column], weight: Column | None = None) -> DataFrame:
    """(key, k, g, h): gradients of every row at a given raw score, as a round works them out."""
    data = df.select(F.col(key).cast("long").alias("key"), F.array(F.lit(1)).alias("bins"), label.cast("double").alias("label"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), F.array(*raw).cast("array<double>").alias("raw"))
    round_ = Round(loss, [0.0] * loss.size, [], [], 0, params=Params())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in round_.rows(batches):
            k = np.tile(np.arange(loss.size, dtype=np.int32), len(r))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r.key, loss.size)), pa.array(k), pa.array(r.g.ravel()), pa.array(r.h.ravel())], names=[key, "k", "g", "h"])

    return data.mapInArrow(run, f"{key} long, k int, g double, h double")


def _two(df: DataFrame, digits: int) -> DataFrame:
    return df.select(df.columns[0], F.round("g", digits).alias("g"), F.round("h", digits).alias("h"))


@query("SELECT p_partkey, ROUND(p_size - p_retailprice, 6) AS g, 1.0::DOUBLE AS h FROM part")
def grad_square(spark, sf_dir):
    return _two(_gradients(spark, _table(spark, sf_dir, "part"), Square(), "p_partkey", F.col("p_retailprice"), [F.col("p_size")]), 6)


@query("SELECT p_partkey, ROUND(p_size * (p_size - p_retailprice), 4) AS g, p_size::DOUBLE AS h FROM part")
def grad_weighted(spark, sf_dir):
    return _two(_gradients(spark, _table(spark, sf_dir, "part"), Square(), "p_partkey", F.col("p_retailprice"), [F.col("p_size")], F.col("p_size")), 4)


_HALVES = "((p_size * 20.0) - p_retailprice)"


@query(f"SELECT p_partkey, ROUND(CASE WHEN {_HALVES} > 0 THEN 3 * {_HALVES} ELSE {_HALVES} END, 4) AS g, CASE WHEN {_HALVES} > 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS h FROM part")
def grad_custom(spark, sf_dir):
    """A user's loss: errors above count three times."""
    loss = Scalar(lambda y, s: (np.where(s > y, 3.0, 1.0) * (s - y), np.where(s > y, 3.0, 1.0)))
    return _two(_gradients(spark, _table(spark, sf_dir, "part"), loss, "p_partkey", F.col("p_retailprice"), [F.col("p_size") * 20.0]), 4)


@query(f"WITH r AS (SELECT p_partkey, {_HALVES} AS r FROM part) SELECT p_partkey, ROUND(r / SQRT(1 + (r / 100) * (r / 100)), 6) AS g, ROUND(1 / POWER(SQRT(1 + (r / 100) * (r / 100)), 3), 9) AS h FROM r")
def grad_huber(spark, sf_dir):
    out = _gradients(spark, _table(spark, sf_dir, "part"), Huber(100.0), "p_partkey", F.col("p_retailprice"), [F.col("p_size") * 20.0])
    return out.select("p_partkey", F.round("g", 6).alias("g"), F.round("h", 9).alias("h"))


@query("""WITH s AS (SELECT doc_id, quality AS y, 1 / (1 + EXP(-((doc_id * 37) % 1009 / 250.0 - 2))) AS p FROM labels)
SELECT doc_id, ROUND(p - y, 9) AS g, ROUND(GREATEST(p * (1 - p), 1e-16), 9) AS h FROM s""")
def grad_logistic(spark, sf_dir):
    raw = F.pmod(F.col("doc_id") * 37, F.lit(1009)) / F.lit(250.0) - 2
    return _two(_gradients(spark, _table(spark, sf_dir, "labels"), Logistic(), "doc_id", F.col("quality"), [raw]), 9)


@query("""WITH e AS (SELECT vec_id, label % 3 AS y, [EXP(embedding[1]::DOUBLE), EXP(embedding[2]::DOUBLE), EXP(embedding[3]::DOUBLE)] AS e FROM embeddings),
k AS (SELECT vec_id, y, UNNEST([0, 1, 2]) AS k, e FROM e), p AS (SELECT vec_id, k, CASE WHEN y = k THEN 1.0 ELSE 0.0 END AS y, e[k + 1] / (e[1] + e[2] + e[3]) AS p FROM k)
SELECT vec_id, k, ROUND(p - y, 6) AS g, ROUND(GREATEST(2 * p * (1 - p), 1e-16), 6) AS h FROM p""")
def grad_softmax(spark, sf_dir):
    out = _gradients(spark, _table(spark, sf_dir, "embeddings"), Softmax(3), "vec_id", F.col("label") % 3, [F.col("embedding")[i].cast("double") for i in range(3)])
    return out.select("vec_id", "k", F.round("g", 6).alias("g"), F.round("h", 6).alias("h"))


def _booster(df: DataFrame, features: list[Column], label: Column, base: float, params: Params, key: Column, local: bool = False, repartition: Column | None = None) -> tuple[Booster, Round]:
    """A fit at its first round. Labels in whole cents, so that sums of gradients are exact."""
    disc, _ = Discretizer.fit(df, features, params)
    data = prepare(df, disc, features, label, F.lit(1.0), [base], key)
    if repartition is not None:
        data = data.repartitionById(4, repartition)
    booster = Booster(data, disc, Square(), [base], params, local=local)
    return booster, booster.start(0)[0]


def _line(spark, sf_dir, columns: list[str] = LINE, local: bool = False, **given) -> tuple[Booster, Round]:
    df = _table(spark, sf_dir, "lineitem")
    return _booster(df, [F.col(c) for c in columns], F.round(F.col("l_extendedprice") * 100), 3_000_000.0, Params(**({"max_bins": 16} | given)), F.col("l_orderkey") * 8 + F.col("l_linenumber"), local)


def _packed(spark, hists) -> DataFrame:
    return hists if isinstance(hists, DataFrame) else spark.createDataFrame(pa.Table.from_batches(list(hist_batches(hists))))


def _whole(booster: Booster, hists) -> DataFrame:
    """Every histogram once, with all tasks' parts."""
    spark, size = booster.data.sparkSession, booster.params.max_bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hist_batches(summed(batches, size))

    hists = _packed(spark, hists)
    return hists.repartition(tasks_for(spark), "tree", "node", "col").mapInArrow(add, hists.schema)


def _long(booster: Booster, hists) -> DataFrame:
    return long_histograms(_whole(booster, hists), booster.params.max_bins).withColumn("node_id", F.col("node_id").cast("int"))


def _cuts(booster: Booster, hists, categorical: bool = False) -> DataFrame:
    """Every way to part a histogram that the search allows: (col_id, threshold, miss_right, members, size, wl, wr, gain)."""
    params, size = booster.params, booster.params.max_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, c), h in summed(batches, size).items():
            found = candidates(c, h[0], h[1], categorical, params)
            rows = [] if found is None else found.allowed().tolist()
            out = {name: [] for name in ("col_id", "threshold", "miss_right", "members", "size", "wl", "wr", "gain")}
            for i in rows:
                bins, s = found.bins(i), found.split(i, params)
                first = s.goes_left(int(bins[0]))
                values = (c, int(bins[-1]), 0 if categorical or found.missing_first[i] else 1, ",".join(map(str, np.sort(bins))), len(bins), s.wl if first else s.wr, s.wr if first else s.wl, s.gain)
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return _whole(booster, hists).mapInArrow(run, "col_id int, threshold int, miss_right int, members string, size int, wl double, wr double, gain double")


_G = "3000000.0 - ROUND(y * 100)"
_HIST = f"WITH {_LINE_CELLS}, {_WIDTH}, hist AS (SELECT col_id, bin, SUM({_G}) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM q GROUP BY ALL)"


@query(f"{_HIST} SELECT 0 AS tree_id, 1 AS node_id, col_id, bin, g, h FROM hist")
def hist_basic(spark, sf_dir):
    booster, round_ = _line(spark, sf_dir)
    return _long(booster, booster.histograms(round_, booster.active(round_)))


@query(ORACLE_SQL["hist_basic"])
def hist_combined(spark, sf_dir):
    """Added up in groups of partitions before they are dealt."""
    booster, round_ = _line(spark, sf_dir, aggregation_depth=3)
    booster.parts, booster.cores = 64, 4
    return _long(booster, booster.histograms(round_, booster.active(round_)))


def _two_nodes(booster: Booster, round_: Round) -> set:
    """Grow the root by hand: line numbers up to 3 go left."""
    round_.new[0].grow({1: Split(3, True, True, (3,), True, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)})
    round_.depth, round_.columns = 1, [[0, 1, 2]]
    return booster.active(round_)


_NODES = {"columns": [*LINE, "l_linenumber"], "rank_cols": (3,), "discretization_type": "width:round"}


@query(f"""WITH p AS (SELECT 0 AS col_id, l_linenumber AS ln, CAST(l_quantity AS DOUBLE) AS v, l_extendedprice AS y FROM lineitem UNION ALL
  SELECT 1, l_linenumber, l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_linenumber, l_tax, l_extendedprice FROM lineitem),
  e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM p GROUP BY col_id)
SELECT 0 AS tree_id, CASE WHEN ln <= 3 THEN 2 ELSE 3 END AS node_id, p.col_id,
  CASE WHEN step = 0 OR v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin, SUM({_G}) AS g, CAST(COUNT(*) AS DOUBLE) AS h
FROM p JOIN e ON p.col_id = e.col_id GROUP BY ALL""")
def hist_two_nodes(spark, sf_dir):
    booster, round_ = _line(spark, sf_dir, **_NODES)
    return _long(booster, booster.histograms(round_, _two_nodes(booster, round_)))


@query(ORACLE_SQL["hist_two_nodes"])
def hist_subtract(spark, sf_dir):
    """Right children are added up, left ones are the rest of their parents."""
    booster, round_ = _line(spark, sf_dir, histogram_computation_type="subtract", **_NODES)
    round_.columns = [[0, 1, 2]]
    parent = materialise(_packed(spark, booster.histograms(round_, booster.active(round_))), "hist")
    return _long(booster, booster.histograms(round_, _two_nodes(booster, round_), parent))


@query(ORACLE_SQL["hist_two_nodes"])
def hist_held(spark, sf_dir):
    """A table small enough for the driver, with subtraction."""
    booster, round_ = _line(spark, sf_dir, local=True, histogram_computation_type="subtract", **_NODES)
    round_.columns = [[0, 1, 2]]
    parent = booster.histograms(round_, booster.active(round_))
    return _long(booster, booster.histograms(round_, _two_nodes(booster, round_), parent))


@query(ORACLE_SQL["hist_two_nodes"])
def hist_vertical(spark, sf_dir):
    """Bins dealt by column, rows' states gathered."""
    booster, round_ = _line(spark, sf_dir, parallelism_type="feature", **_NODES)
    return _long(booster, booster.histograms(round_, _two_nodes(booster, round_)))


def _node_salt(node: int) -> int:
    return mix64(seed_of(seed_of(-1, 0), 3, 0, node))


_KEPT = f"(ln <= 3 AND {hashed('ok * 8 + ln', _node_salt(2))} % {1 << 30} < {math.ceil(0.5 * (1 << 30))} OR ln > 3 AND {hashed('ok * 8 + ln', _node_salt(3))} % {1 << 30} < {math.ceil(0.5 * (1 << 30))})"


@query(f"""WITH p AS (SELECT 0 AS col_id, l_linenumber AS ln, l_orderkey AS ok, CAST(l_quantity AS DOUBLE) AS v, l_extendedprice AS y FROM lineitem UNION ALL
  SELECT 1, l_linenumber, l_orderkey, l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_linenumber, l_orderkey, l_tax, l_extendedprice FROM lineitem),
  e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM p GROUP BY col_id)
SELECT 0 AS tree_id, CASE WHEN ln <= 3 THEN 2 ELSE 3 END AS node_id, p.col_id,
  CASE WHEN step = 0 OR v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin, SUM({_G}) AS g, CAST(COUNT(*) AS DOUBLE) AS h
FROM p JOIN e ON p.col_id = e.col_id WHERE {_KEPT} GROUP BY ALL""")
def hist_node_sampled(spark, sf_dir):
    booster, round_ = _line(spark, sf_dir, sub_sample_rate_by_node=0.5, **_NODES)
    return _long(booster, booster.histograms(round_, _two_nodes(booster, round_)))


_SPARSE = """WITH p AS (SELECT 0 AS col_id, l_discount AS v, l_extendedprice AS y FROM lineitem UNION ALL SELECT 1, l_tax, l_extendedprice FROM lineitem),
c AS (SELECT col_id, CASE WHEN v = 0 THEN NULL ELSE v END AS v, y FROM p),
e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM c GROUP BY col_id)
SELECT 0 AS tree_id, 1 AS node_id, c.col_id, CASE WHEN v IS NULL THEN 0 WHEN v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin,
  SUM({}) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM c JOIN e ON c.col_id = e.col_id GROUP BY ALL"""


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def _sparse(spark, sf_dir, local: bool) -> tuple[Booster, Round]:
    """Filled cells alone are kept and added up; the missing bin is the node's total less the rest."""
    df = _vectors(_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])
    params, cols = Params(max_bins=16, zero_as_missing=True), [F.col("l_discount"), F.col("l_tax")]
    disc, _ = Discretizer.fit(df, cols, params)
    data = prepare(df, disc, cols, F.round(F.col("l_extendedprice") * 100), F.lit(1.0), [3_000_000.0], F.col("l_orderkey") * 8 + F.col("l_linenumber"), sparse=F.col("features"))
    booster = Booster(data, disc, Square(), [3_000_000.0], params, local=local)
    return booster, booster.start(0)[0]


@query(_SPARSE.format(_G))
def hist_sparse_fill(spark, sf_dir):
    booster, round_ = _sparse(spark, sf_dir, False)
    return _long(booster, booster.histograms(round_, booster.active(round_)))


@query(_SPARSE.format(_G))
def hist_sparse_held(spark, sf_dir):
    booster, round_ = _sparse(spark, sf_dir, True)
    return _long(booster, booster.histograms(round_, booster.active(round_)))


def _splits_sql(lam: str, alpha: str, least: int = 1) -> str:
    score = lambda g, h: f"POWER(GREATEST(ABS({g}) - {alpha}, 0), 2) / (2 * ({h} + {lam}))"
    weight = lambda g, h: f"-SIGN({g}) * GREATEST(ABS({g}) - {alpha}, 0) / ({h} + {lam})"
    return f"""{_HIST}, c AS (SELECT col_id, bin, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER (PARTITION BY col_id) AS gt, SUM(h) OVER (PARTITION BY col_id) AS ht
  FROM hist WINDOW w AS (PARTITION BY col_id ORDER BY bin)),
k AS (SELECT *, {score('gl', 'hl')} + {score('gt - gl', 'ht - hl')} - {score('gt', 'ht')} AS gain FROM c WHERE hl >= {least} AND ht - hl >= {least})
SELECT col_id, bin AS threshold, ROUND({weight('gl', 'hl')}, 4) AS wl, ROUND({weight('gt - gl', 'ht - hl')}, 4) AS wr, ROUND(gain / 1e6, 2) AS gain FROM k WHERE gain >= 0"""


def _root_cuts(spark, sf_dir, **given) -> DataFrame:
    booster, round_ = _line(spark, sf_dir, **given)
    return _cuts(booster, booster.histograms(round_, booster.active(round_)))


def _rounded(splits: DataFrame, *more: str) -> DataFrame:
    return splits.select("col_id", *more, F.round("wl", 4).alias("wl"), F.round("wr", 4).alias("wr"), F.round(F.col("gain") / 1e6, 2).alias("gain"))


@query(_splits_sql("1.0", "0.0"))
def split_seq(spark, sf_dir):
    return _rounded(_root_cuts(spark, sf_dir), "threshold")


@query(_splits_sql("5.0", "20000.0", 50))
def split_l1(spark, sf_dir):
    return _rounded(_root_cuts(spark, sf_dir, reg_alpha=20000.0, reg_lambda=5.0, min_node_hess=50.0), "threshold")


@query(f"SELECT * FROM ({_splits_sql('1.0', '0.0')}) ORDER BY gain DESC, col_id, threshold LIMIT 1")
def split_best(spark, sf_dir):
    """The search's own choice over all tasks' histograms."""
    booster, round_ = _line(spark, sf_dir)
    found, _ = booster.level(round_, [10], set(), None)
    s = found[0][1]
    w = (s.wl, s.wr) if s.left else (s.wr, s.wl)
    return _rounded(spark.createDataFrame([(s.col, s.data[0], float(w[0]), float(w[1]), float(s.gain))], "col_id int, threshold int, wl double, wr double, gain double"), "threshold")


@query("""WITH h AS (SELECT CAST(CASE WHEN l_discount = 0 THEN 0 ELSE ROUND(l_discount * 100) END AS INT) AS bin, SUM(3000000.0 - ROUND(l_extendedprice * 100)) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM lineitem GROUP BY 1),
o AS (SELECT 0 AS miss_right, bin AS ord, bin, g, h FROM h UNION ALL
  SELECT 1, CASE WHEN bin = 0 THEN 1000000 ELSE bin END, bin, g, h FROM h WHERE EXISTS (SELECT 1 FROM h WHERE bin = 0)),
c AS (SELECT miss_right, bin, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER (PARTITION BY miss_right) AS gt, SUM(h) OVER (PARTITION BY miss_right) AS ht
  FROM o WINDOW w AS (PARTITION BY miss_right ORDER BY ord)),
k AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE hl >= 1 AND ht - hl >= 1)
SELECT 0 AS col_id, miss_right, bin AS threshold, ROUND(-gl / (hl + 1), 4) AS wl, ROUND(-(gt - gl) / (ht - hl + 1), 4) AS wr, ROUND(gain / 1e6, 2) AS gain FROM k WHERE gain >= 0""")
def split_missing(spark, sf_dir):
    bins = F.round(clean(F.col("l_discount"), True) * 100)
    booster, round_ = _booster(_table(spark, sf_dir, "lineitem"), [bins], F.round(F.col("l_extendedprice") * 100), 3_000_000.0, Params(max_bins=16, discretization_type="round"), F.col("l_orderkey"))
    return _rounded(_cuts(booster, booster.histograms(round_, booster.active(round_))), "miss_right", "threshold")


def _category(spark, sf_dir, table: str, bin_of: Column, label: Column, base: float, key: str, bins: int) -> DataFrame:
    booster, round_ = _booster(_table(spark, sf_dir, table), [bin_of], label, base, Params(max_bins=bins, cat_cols=(0,)), F.col(key))
    return _cuts(booster, booster.histograms(round_, booster.active(round_)), True)


@query("""WITH h AS (SELECT CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) AS bin, SUM(15000000.0 - ROUND(o_totalprice * 100)) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM orders GROUP BY 1),
n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY bin) - 1 AS i, SUM(g) OVER () AS gt, SUM(h) OVER () AS ht, COUNT(*) OVER () AS m FROM h),
k AS (SELECT mask, list(bin ORDER BY bin) AS s, SUM(g) AS gl, SUM(h) AS hl, MAX(gt) AS gt, MAX(ht) AS ht
  FROM n, (SELECT UNNEST(range(1, 1 << 4)) AS mask) WHERE (mask >> i::INT) & 1 = 1 AND mask < (1 << (m::INT - 1)) GROUP BY mask),
c AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM k)
SELECT 0 AS col_id, array_to_string(s, ',') AS members, ROUND(-gl / (hl + 1), 4) AS wl, ROUND(-(gt - gl) / (ht - hl + 1), 4) AS wr, ROUND(gain / 1e6, 2) AS gain
FROM c WHERE hl >= 1 AND ht - hl >= 1 AND gain >= 0""")
def split_cat_brute(spark, sf_dir):
    found = _category(spark, sf_dir, "orders", F.substring("o_orderpriority", 1, 1).cast("int"), F.round(F.col("o_totalprice") * 100), 15_000_000.0, "o_orderkey", 8)
    return _rounded(found, "members")


@query("""WITH h AS (SELECT CAST(REGEXP_EXTRACT(p_brand, '([0-9]+)', 1) AS INT) AS bin, SUM(95000.0 - ROUND(p_retailprice * 100)) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM part GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY g / (h + 1.0 / 64), bin) AS i, SUM(g) OVER () AS gt, SUM(h) OVER () AS ht, COUNT(*) OVER () AS m FROM h),
c AS (SELECT i, m, SUM(g) OVER (ORDER BY i) AS gl, SUM(h) OVER (ORDER BY i) AS hl, gt, ht FROM r),
k AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE i < m AND hl >= 1 AND ht - hl >= 1)
SELECT 0 AS col_id, CAST(i AS INT) AS size, ROUND(-gl / (hl + 1), 4) AS wl, ROUND(-(gt - gl) / (ht - hl + 1), 4) AS wr, ROUND(gain / 1e6, 2) AS gain FROM k WHERE gain >= 0""")
def split_cat_heuristic(spark, sf_dir):
    return _rounded(_category(spark, sf_dir, "part", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), F.round(F.col("p_retailprice") * 100), 95_000.0, "p_partkey", 64), "size")


@query("SELECT 0 AS found")
def split_none(spark, sf_dir):
    """No split where all rows are in one bin, or where no side may be so small."""
    df = _table(spark, sf_dir, "part")
    found = 0
    for feature, more in ((F.lit(1.0), {}), (F.col("p_size"), {"min_node_hess": 1e9}), (F.col("p_size"), {"min_gain": 1e18}), (F.lit(None).cast("double"), {})):
        booster, round_ = _booster(df, [feature], F.col("p_retailprice"), 1000.0, Params(max_bins=16, **more), F.col("p_partkey"))
        found += sum(map(len, booster.level(round_, [10], set(), None)[0].values()))
    return spark.createDataFrame([(found,)], "found int")


@query(f"""WITH p AS (SELECT l_suppkey % 4 AS part, 0 AS col_id, CAST(l_quantity AS DOUBLE) AS v, l_extendedprice AS y FROM lineitem UNION ALL
  SELECT l_suppkey % 4, 1, l_discount, l_extendedprice FROM lineitem UNION ALL SELECT l_suppkey % 4, 2, l_tax, l_extendedprice FROM lineitem),
e AS (SELECT col_id, MIN(v) + (MAX(v) - MIN(v)) / 14 / 2 AS start_, (MAX(v) - MIN(v)) / 14 AS step FROM p GROUP BY col_id),
h AS (SELECT part, p.col_id, CASE WHEN v <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((v - start_) / step) AS INT), 15) END AS bin, SUM({_G}) AS g, CAST(COUNT(*) AS DOUBLE) AS h
  FROM p JOIN e ON p.col_id = e.col_id GROUP BY ALL),
c AS (SELECT part, col_id, bin, SUM(g) OVER w AS gl, SUM(h) OVER w AS hl, SUM(g) OVER u AS gt, SUM(h) OVER u AS ht FROM h WINDOW w AS (PARTITION BY part, col_id ORDER BY bin), u AS (PARTITION BY part, col_id)),
v AS (SELECT part, col_id, MAX(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1))) AS gain FROM c WHERE hl >= 1 AND ht - hl >= 1 GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY part ORDER BY gain DESC, col_id) AS r FROM v)
SELECT 0 AS tree_id, 1 AS node_id, col_id, COUNT(*) AS votes FROM k WHERE r <= 2 GROUP BY col_id""")
def vote_topk(spark, sf_dir):
    """Votes of four partitions, dealt by supplier."""
    df, cols = _table(spark, sf_dir, "lineitem"), [F.col(c) for c in LINE]
    params = Params(max_bins=16, top_k=2, histogram_computation_type="vote")
    # The key carries what partitions are dealt by.
    booster, round_ = _booster(df, cols, F.round(F.col("l_extendedprice") * 100), 3_000_000.0, params, F.col("l_suppkey") % 4, repartition=F.col("key").cast("int"))
    rows = [(t, n, c, k) for (t, n, c), k in booster.votes(round_, booster.active(round_)).items()]
    return spark.createDataFrame(rows, "tree_id int, node_id int, col_id int, votes long")


_STUMP = """b AS (SELECT AVG(CAST(l_quantity AS DOUBLE)) AS base FROM lineitem),
e AS (SELECT MIN(l_tax) + (MAX(l_tax) - MIN(l_tax)) / 14 / 2 AS start_, (MAX(l_tax) - MIN(l_tax)) / 14 AS step FROM lineitem),
r AS (SELECT CASE WHEN l_tax <= start_ THEN 1 ELSE LEAST(1 + CAST(CEIL((l_tax - start_) / step) AS INT), 15) END AS bin, base - l_quantity AS g, base FROM lineitem, b, e),
h AS (SELECT bin, SUM(g) AS g, CAST(COUNT(*) AS DOUBLE) AS h FROM r GROUP BY bin),
c AS (SELECT bin, SUM(g) OVER (ORDER BY bin) AS gl, SUM(h) OVER (ORDER BY bin) AS hl, SUM(g) OVER () AS gt, SUM(h) OVER () AS ht FROM h),
k AS (SELECT bin AS cut, -gl / (hl + 1) AS wl, -(gt - gl) / (ht - hl + 1) AS wr,
  0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE ht - hl >= 1 ORDER BY gain DESC, bin LIMIT 1)"""


@query(f"""WITH {_STUMP} SELECT bin, COUNT(*) AS n, ROUND(MAX(base + 0.5 * CASE WHEN bin <= cut THEN wl ELSE wr END), 6) AS prediction FROM r, k GROUP BY bin""")
def boost_stump(spark, sf_dir):
    """One round of depth 1, scored; rows by bin."""
    df = _table(spark, sf_dir, "lineitem")
    model, _ = fit(df, ["l_tax"], "l_quantity", params=Params(max_iter=1, max_depth=1, max_bins=16, step_size=0.5))
    features = [F.col("l_tax")]
    scored = df.select(model.discretizer.bin(0, features[0]).alias("bin"), model.predict(features)[0].alias("p"))
    return scored.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.max("p"), 6).alias("prediction"))


_GOSS_SALT = mix64(seed_of(seed_of(-1, 0), 2, 0))


@query(f"""WITH n AS (SELECT event_id, POWER(5.0 - ROUND(value * 100), 2) AS norm FROM events), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY norm) AS i, COUNT(*) OVER () AS c FROM n),
l AS (SELECT MAX(norm) AS level FROM r WHERE i = CEIL(0.8 * c))
SELECT CASE WHEN norm >= level THEN 1.0 WHEN {hashed('event_id', _GOSS_SALT)} % {1 << 30} < {math.ceil(0.125 * (1 << 30))} THEN 8.0 ELSE 0.0 END::DOUBLE AS scale, COUNT(*) AS n FROM n, l GROUP BY 1""")
def goss_weights(spark, sf_dir):
    booster, round_ = _booster(_table(spark, sf_dir, "events"), [F.col("value")], F.round(F.col("value") * 100), 5.0, Params(sub_sample_type="goss"), F.col("event_id"))

    def scales(rows: Iterable[Rows], part: int) -> Iterator[pa.RecordBatch]:
        for r in rows:
            scale, n = np.unique(round_.goss_scale(r.g, r.key, 0), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(scale), pa.array(n.astype(np.int64))], names=["scale", "n"])

    return booster.each(round_, scales, "scale double, n long").groupBy(F.round("scale", 9).alias("scale")).agg(F.sum("n").alias("n"))


def _unit_salt(iteration: int, base: int) -> int:
    return mix64(seed_of(seed_of(-1, iteration), 1, base))


@query(f"SELECT event_id FROM events WHERE {hashed('event_id', _unit_salt(0, 0))} % {1 << 30} < {math.ceil(0.3 * (1 << 30))}")
def sample_hashed(spark, sf_dir):
    """Many units: each is kept by its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep_array(0.3, seed_of(seed_of(-1, 0), 1, 0), b.column(0).to_numpy())))

    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id")).mapInArrow(run, "event_id long")


def _sampled_keys(spark, sf_dir, **given) -> DataFrame:
    """Keys of the rows that the first base model reads."""
    booster, round_ = _booster(_table(spark, sf_dir, "part"), [F.col("p_size")], F.col("p_retailprice"), 1000.0, Params(**given), F.col("p_partkey"))

    def keys(rows: Iterable[Rows], part: int) -> Iterator[pa.RecordBatch]:
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array(r.key[round_.sampled(r.key, part, 0)])], names=["p_partkey"])

    return booster.each(round_, keys, "p_partkey long")


@query(f"SELECT p_partkey FROM part QUALIFY ROW_NUMBER() OVER (ORDER BY {hashed('p_partkey', _unit_salt(0, 0))}) <= CEIL(0.3 * COUNT(*) OVER ())")
def sample_rows(spark, sf_dir):
    return _sampled_keys(spark, sf_dir, sub_sample_type="row", sub_sample_rate_by_tree=0.3)


@query(f"""WITH b AS (SELECT DISTINCT p_partkey // 16 AS b FROM part), k AS (SELECT b FROM b QUALIFY ROW_NUMBER() OVER (ORDER BY {hashed('b', _unit_salt(0, 0))}) <= CEIL(0.4 * COUNT(*) OVER ()))
SELECT p_partkey FROM part WHERE p_partkey // 16 IN (SELECT b FROM k)""")
def sample_blocks(spark, sf_dir):
    return _sampled_keys(spark, sf_dir, sub_sample_type="block", block_size=16, sub_sample_rate_by_tree=0.4)


@query(f"WITH u AS (SELECT UNNEST(range(50)) AS unit) SELECT unit FROM u QUALIFY ROW_NUMBER() OVER (ORDER BY {hashed('unit', _unit_salt(0, 0))}) <= 20")
def sample_partitions(spark, sf_dir):
    return spark.createDataFrame([(int(u),) for u in choose_units(np.arange(50), 0.4, seed_of(seed_of(-1, 0), 1, 0))], "unit long")


@query("SELECT rate, CAST(CEIL(rate * 7) AS INT) AS chosen, 20 AS trees, 0 AS outside FROM (VALUES (0.1::DOUBLE), (0.5), (0.9), (1.0)) t(rate)")
def sample_columns(spark, sf_dir):
    """Exactly the share of columns, distinct and sorted, for trees as for nodes."""
    rows = []
    for rate in (0.1, 0.5, 0.9, 1.0):
        found = [choose_columns(7, rate, seed) for seed in range(20)]
        sizes = {len(set(x)) for x in found}
        rows.append((rate, sizes.pop() if len(sizes) == 1 else -1, len(found), sum(c not in range(7) for x in found for c in x) + sum(x != sorted(x) for x in found)))
    return spark.createDataFrame(rows, "rate double, chosen int, trees int, outside int")


@query("SELECT * FROM (VALUES (0, 1.0 * 2 / 2.1), (1, 1.0), (2, 1.0 * 2 / 2.1), (3, 1 / 2.1)) t(tree, w)".replace("SELECT *", "SELECT tree, ROUND(w::DOUBLE, 9) AS weight"))
def dart_weights(spark, sf_dir):
    weights = new_weights([1.0, 1.0, 1.0], 1, [0, 2], Params(boost_type="dart"), 1)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "tree int, w double").select("tree", F.round("w", 9).alias("weight"))


# -- metrics ---------------------------------------------------------------------------------------------------------


def _measured(df: DataFrame, metrics: list[M.Metric], weight: Column, label: Column, score: Column, digits: int) -> DataFrame:
    scored = df.select(weight.cast("double").alias("weight"), *(F.array(c.cast("double")).alias(n) for n, c in (("label", label), ("raw", score), ("score", score))))
    found = M.measure(scored, metrics)
    return df.sparkSession.createDataFrame([tuple(float(x) for x in found.values())], [k.replace("@", "_").replace(".", "_") for k in found]).select(*(F.round(k.replace("@", "_").replace(".", "_"), digits).alias(k.replace("@", "_").replace(".", "_")) for k in found))


@query("""SELECT ROUND(SUM(l_quantity * POWER(l_discount - l_tax, 2)) / SUM(l_quantity), 9) AS mse, ROUND(SQRT(SUM(l_quantity * POWER(l_discount - l_tax, 2)) / SUM(l_quantity)), 9) AS rmse,
ROUND(SUM(l_quantity * ABS(l_discount - l_tax)) / SUM(l_quantity), 9) AS mae FROM lineitem""")
def metric_regression(spark, sf_dir):
    return _measured(_table(spark, sf_dir, "lineitem"), [M.metric(m) for m in ("mse", "rmse", "mae")], F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), 9)


@query("""SELECT ROUND(1 - (SUM(l_quantity * POWER(l_discount - l_tax, 2)) / SUM(l_quantity)) / (SUM(l_quantity * l_tax * l_tax) / SUM(l_quantity) - POWER(SUM(l_quantity * l_tax) / SUM(l_quantity), 2)), 6) AS r2 FROM lineitem""")
def metric_r2(spark, sf_dir):
    return _measured(_table(spark, sf_dir, "lineitem"), [M.metric("r2")], F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), 6)


_PSEUDO = "((doc_id * 37) % 1009) / 1009.0"


def _pseudo() -> Column:
    return F.pmod(F.col("doc_id") * 37, F.lit(1009)) / F.lit(1009.0)


@query(f"""WITH s AS (SELECT CAST(quality AS DOUBLE) AS y, {_PSEUDO} AS p FROM labels)
SELECT ROUND(AVG(CASE WHEN y = 1 THEN -LN(GREATEST(p, 1e-16)) ELSE -LN(GREATEST(1 - p, 1e-16)) END), 9) AS logloss, ROUND(AVG(CASE WHEN (p > 0.5) <> (y > 0.5) THEN 1.0 ELSE 0.0 END), 9) AS error,
ROUND(AVG(CASE WHEN (p > 0.8) <> (y > 0.5) THEN 1.0 ELSE 0.0 END), 9) AS error_0_8 FROM s""")
def metric_logloss_error(spark, sf_dir):
    return _measured(_table(spark, sf_dir, "labels"), [M.metric(m) for m in ("logloss", "error", "error@0.8")], F.lit(1.0), F.col("quality"), _pseudo(), 9)


@query(f"""WITH s AS (SELECT CAST(quality AS INT) AS y, LEAST(CAST(FLOOR({_PSEUDO} * 64) AS INT), 63) AS b FROM labels),
h AS (SELECT b, CAST(SUM(y) AS DOUBLE) AS p, CAST(SUM(1 - y) AS DOUBLE) AS n FROM s GROUP BY b),
c AS (SELECT b, p, n, SUM(p) OVER (ORDER BY b DESC) AS tp, SUM(n) OVER (ORDER BY b DESC) AS fp, SUM(p) OVER () AS pt, SUM(n) OVER () AS nt FROM h),
d AS (SELECT *, tp / (tp + fp) AS prec, LAG(tp / (tp + fp)) OVER (ORDER BY b DESC) AS prev FROM c)
SELECT ROUND(SUM(n * (tp - p / 2)) / MAX(pt * nt), 9) AS auroc, ROUND(SUM(p / pt * (COALESCE(prev, prec) + prec) / 2), 9) AS auprc FROM d""")
def metric_auroc_auprc(spark, sf_dir):
    return _measured(_table(spark, sf_dir, "labels"), [M.AUROC(64), M.AUPRC(64)], F.lit(1.0), F.col("quality"), _pseudo(), 9)


@query("SELECT ROUND(MAX(ABS(l_discount - l_tax)), 9) AS worst FROM lineitem")
def metric_batch(spark, sf_dir):
    """A user's metric over the whole scored table."""
    worst = M.Batch("worst", lambda df: df.select(F.max(F.abs(F.col("label")[0] - F.col("score")[0]))).first()[0])
    return _measured(_table(spark, sf_dir, "lineitem"), [worst], F.lit(1.0), F.col("l_tax"), F.col("l_discount"), 9)


# -- whole fits ------------------------------------------------------------------------------------------------------

PART = ["p_partkey", "p_size"]
ROUNDS = {"max_iter": 2, "max_depth": 2, "max_bins": 16, "step_size": 0.5}
#: A label without symmetries, so that no two cuts gain alike.
_PRICE = "p_retailprice + p_size * p_size / 10.0 + (p_partkey * 7919 % 1013) / 7.0"
_ROWS = width_bins("part", PART, "p_partkey", _PRICE)
_MEAN = "(SELECT SUM(w * y) / SUM(w) FROM rows0)"
_PLAIN = FitSql(_ROWS, 2, [_MEAN])
_BINARY = FitSql(width_bins("part", ["p_partkey", "p_retailprice"], "p_partkey", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END"), 2, [f"(-LN(1 / {_MEAN} - 1))"], loss=logistic)
_SHARES = [f"(SELECT AVG(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END) FROM rows0)" for k in range(3)]
_THREE = FitSql(width_bins("part", ["p_partkey", "p_retailprice"], "p_partkey", "p_size % 3"), 2, [f"LN(3 / ({' + '.join(_SHARES)})) + LN({s})" for s in _SHARES], outputs=3, loss=softmax)


def _part(spark, sf_dir) -> DataFrame:
    df = _table(spark, sf_dir, "part")
    return df.withColumns({"price": F.expr(_PRICE).cast("double"), "binary": (F.col("p_size") > 25).cast("double"), "three": (F.col("p_size") % 3).cast("double")})


def _part_fit(spark, sf_dir, features=PART, label="price", more: dict | None = None, **given) -> tuple[DataFrame, BoostedModel, dict]:
    df = _part(spark, sf_dir)
    model, history = fit(df, features, label, params=Params(**(ROUNDS | given)), key="p_partkey", **(more or {}))
    return df, model, history


def _predicted(df: DataFrame, model: BoostedModel, features=PART, digits: int = 4) -> DataFrame:
    return df.select(F.col("p_partkey").alias("id"), F.round(model.predict([F.col(c) for c in features])[0], digits).alias("prediction"))


def _fit_query(name: str, sql: FitSql | str, features=PART, label="price", more: Callable[[], dict] | dict | None = None, digits: int = 4, **given) -> None:
    def run(spark, sf_dir):
        df, model, _ = _part_fit(spark, sf_dir, features, label, more() if callable(more) else more, **given)
        return _predicted(df, model, features, digits)

    run.__name__ = name
    query(sql if isinstance(sql, str) else sql.scores(digits))(run)


_fit_query("boost_gbtree", _PLAIN)
_fit_query("boost_dealt", _PLAIN, more={"local": False})
_fit_query("boost_subtract", _PLAIN, histogram_computation_type="subtract")
_fit_query("boost_subtract_dealt", _PLAIN, more={"local": False}, histogram_computation_type="subtract")
_fit_query("boost_vote", _PLAIN, more={"local": False}, histogram_computation_type="vote")
_fit_query("boost_feature", _PLAIN, more={"local": False}, parallelism_type="feature")
_fit_query("boost_checkpointed", _PLAIN, more={"local": False}, checkpoint_interval=1)
_fit_query("boost_base_score", FitSql(_ROWS, 2, ["1000.0"]), base_score=(1000.0,))
_fit_query("boost_weighted", FitSql(width_bins("part", PART, "p_partkey", _PRICE, "p_size"), 2, [_MEAN]), more={"weight": "p_size"})
_fit_query("boost_regularised", FitSql(_ROWS, 2, [_MEAN], lam=25.0, least=40.0), reg_lambda=25.0, min_node_hess=40.0)
_fit_query("boost_max_leaves", FitSql(_ROWS, 2, [_MEAN], depth=3, leaves=3), max_depth=3, max_leaves=3)
_fit_query("boost_leafwise", FitSql(_ROWS, 2, [_MEAN], leafwise=True), leaf_boosting=True)
_fit_query("boost_leafwise_dealt", FitSql(_ROWS, 2, [_MEAN], leafwise=True), more={"local": False}, leaf_boosting=True)
_fit_query("boost_custom", FitSql(_ROWS, 2, [_MEAN], loss=lambda raws: [(f"3 * ({raws[0]} - y)", "3.0")]), more=lambda: {"loss": Scalar(lambda y, s: (3 * (s - y), 3.0))})
_fit_query(
    "boost_huber",
    FitSql(_ROWS, 2, [_MEAN], loss=lambda raws: [(f"({raws[0]} - y) / SQRT(1 + POWER(({raws[0]} - y) / 100, 2))", f"1 / POWER(SQRT(1 + POWER(({raws[0]} - y) / 100, 2)), 3)")]),
    more=lambda: {"loss": Huber(100.0)},
)
# Every earlier tree is dropped in each round, which no chance decides.
_fit_query(
    "boost_dart", FitSql(_ROWS, 2, [_MEAN], rounds=3, working=lambda r: [0.0] * r, final=[1 / 1.5 * 2 / 2.5, 1 / 1.5 * 2 / 2.5, 1 / 2.5]),
    max_iter=3, boost_type="dart", drop_rate=1.0, drop_skip=0.0,
)
_fit_query("boost_dart_skipped", FitSql(_ROWS, 2, [_MEAN], working=lambda r: [1.0] * r, final=[1.0, 1.0]), boost_type="dart", drop_rate=1.0, drop_skip=1.0)
_fit_query("boost_forest", FitSql(_ROWS, 2, [_MEAN], forest=2, working=lambda r: [0.25] * 2 * r, final=[0.25] * 4, step=0.25), forest_size=2, step_size=0.25)


def _part_rank(r: int, t: int, rate: float) -> str:
    return f"id IN (SELECT id FROM rows0 QUALIFY ROW_NUMBER() OVER (ORDER BY {hashed('id', mix64(seed_of(seed_of(-1, r), 1, t)))}) <= CEIL({rate} * COUNT(*) OVER ()))"


_fit_query("boost_row_sampled", FitSql(_ROWS, 2, [_MEAN], sampled=lambda r, t: _part_rank(r, t, 0.5)), sub_sample_type="row", sub_sample_rate_by_tree=0.5)
_fit_query("boost_row_sampled_dealt", FitSql(_ROWS, 2, [_MEAN], sampled=lambda r, t: _part_rank(r, t, 0.5)), more={"local": False}, sub_sample_type="row", sub_sample_rate_by_tree=0.5)
_fit_query(
    "boost_feature_sampled", FitSql(_ROWS, 2, [_MEAN], sampled=lambda r, t: _part_rank(r, t, 0.5)), more={"local": False}, parallelism_type="feature",
    sub_sample_type="row", sub_sample_rate_by_tree=0.5,
)
_fit_query("boost_forest_sampled", FitSql(_ROWS, 2, [_MEAN], forest=2, sampled=lambda r, t: _part_rank(r, t, 0.5)), forest_size=2, sub_sample_type="row", sub_sample_rate_by_tree=0.5)


def _part_block(r: int, t: int) -> str:
    return f"id // 16 IN (SELECT b FROM (SELECT DISTINCT id // 16 AS b FROM rows0) QUALIFY ROW_NUMBER() OVER (ORDER BY {hashed('b', mix64(seed_of(seed_of(-1, r), 1, t)))}) <= CEIL(0.5 * COUNT(*) OVER ()))"


_fit_query("boost_block_sampled", FitSql(_ROWS, 2, [_MEAN], sampled=_part_block), sub_sample_type="block", block_size=16, sub_sample_rate_by_tree=0.5)
_fit_query("boost_feature_block", FitSql(_ROWS, 2, [_MEAN], sampled=_part_block), more={"local": False}, parallelism_type="feature", sub_sample_type="block", block_size=16, sub_sample_rate_by_tree=0.5)


def _goss_sql(r: int, t: int) -> str:
    kept = f"{hashed('id', mix64(seed_of(seed_of(-1, r), 2, t)))} % {1 << 30} < {math.ceil(0.125 * (1 << 30))}"
    return f"CASE WHEN g0 * g0 >= (SELECT v FROM level{r}) THEN 1.0 WHEN {kept} THEN 8.0 ELSE 0.0 END"


def _goss_level(r: int) -> str:
    return f"level{r} AS MATERIALIZED (SELECT MAX(n) AS v FROM (SELECT g0 * g0 AS n, ROW_NUMBER() OVER (ORDER BY g0 * g0) AS i, COUNT(*) OVER () AS c FROM y{r}) WHERE i = CEIL(0.8 * c))"


_fit_query("boost_goss", FitSql(_ROWS, 2, [_MEAN], scale=_goss_sql, before=_goss_level), sub_sample_type="goss")
_fit_query("boost_goss_dealt", FitSql(_ROWS, 2, [_MEAN], scale=_goss_sql, before=_goss_level), more={"local": False}, sub_sample_type="goss")
_fit_query("boost_logistic", f"{_BINARY.ctes()} SELECT id, ROUND(1 / (1 + EXP(-({_BINARY.final_raw()}))), 6) AS prediction FROM rows2", ["p_partkey", "p_retailprice"], "binary", {"loss": "logistic"}, 6)


@query("SELECT 0 AS trees, 7.5::DOUBLE AS prediction")
def boost_empty(spark, sf_dir):
    """No split is allowed, so all new trees are empty and the fit stops."""
    df = _table(spark, sf_dir, "part").withColumn("y", F.lit(7.5))
    model, _ = fit(df, PART, "y", params=Params(**ROUNDS, min_node_hess=1e12), key="p_partkey")
    return df.select(F.lit(model.num_trees).alias("trees"), model.predict([F.col(c) for c in PART])[0].alias("prediction")).distinct()


@query(_PLAIN.scores())
def boost_warm(spark, sf_dir):
    """One round, and one more on top of it; the second fit's own binning knobs do not count."""
    df, first, _ = _part_fit(spark, sf_dir, max_iter=1)
    model, _ = fit(df, PART, "price", params=Params(**(ROUNDS | {"max_iter": 1})), initial=first, key="p_partkey")
    return _predicted(df, model)


_CLASSES = [f"EXP({_THREE.final_raw(k)})" for k in range(3)]


@query(f"{_THREE.ctes()} SELECT id, " + ", ".join(f"ROUND({c} / ({' + '.join(_CLASSES)}), 6) AS p{k}" for k, c in enumerate(_CLASSES)) + " FROM rows2")
def boost_softmax(spark, sf_dir):
    features = ["p_partkey", "p_retailprice"]
    df, model, _ = _part_fit(spark, sf_dir, features, "three", {"loss": Softmax(3)})
    p = model.predict([F.col(c) for c in features])
    return df.select(F.col("p_partkey").alias("id"), *(F.round(p[k], 6).alias(f"p{k}") for k in range(3)))


@query(f"""WITH r AS (SELECT p_partkey AS id, LEAST(p_size, 63) AS b, ({_PRICE}) AS y, (SELECT AVG({_PRICE}) FROM part) AS base FROM part),
h AS (SELECT b, SUM(base - y) AS g, COUNT(*)::DOUBLE AS h FROM r GROUP BY b), o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY g / (h + 1.0 / 64), b) AS i FROM h),
c AS (SELECT i, SUM(g) OVER (ORDER BY i) AS gl, SUM(h) OVER (ORDER BY i) AS hl, SUM(g) OVER () AS gt, SUM(h) OVER () AS ht FROM o),
k AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM c WHERE hl >= 1 AND ht - hl >= 1 ORDER BY gain DESC, i LIMIT 1)
SELECT id, ROUND(base + 0.5 * CASE WHEN o.i <= k.i THEN -gl / (hl + 1) ELSE -(gt - gl) / (ht - hl + 1) END, 4) AS prediction FROM r JOIN o ON r.b = o.b, k""")
def boost_categorical(spark, sf_dir):
    df, model, _ = _part_fit(spark, sf_dir, ["p_size"], max_iter=1, max_depth=1, max_bins=64, cat_cols=(0,))
    return _predicted(df, model, ["p_size"])


# -- models ----------------------------------------------------------------------------------------------------------


@query(f"{_PLAIN.ctes()} SELECT id, ROUND({_PLAIN.final_raw(0, 1)}, 4) AS first, ROUND({_MEAN}, 4) AS none_, ROUND({_PLAIN.final_raw()}, 4) AS every FROM rows2")
def predict_first_trees(spark, sf_dir):
    df, model, _ = _part_fit(spark, sf_dir)
    cols = [F.col(c) for c in PART]
    return df.select(F.col("p_partkey").alias("id"), *(F.round(model.predict_raw(cols, n)[0], 4).alias(name) for n, name in ((1, "first"), (0, "none_"), (-1, "every"))))


_LEAF = ", ".join(f"CAST(DENSE_RANK() OVER (ORDER BY x{t}_2.node) - 1 AS INT) AS leaf{t}" for t in (0, 1))


@query(f"{_PLAIN.ctes()} SELECT x0_2.id, {_LEAF} FROM x0_2 JOIN x1_2 ON x0_2.id = x1_2.id")
def leaf_index(spark, sf_dir):
    df, model, _ = _part_fit(spark, sf_dir)
    leaf = model.leaf([F.col(c) for c in PART])
    return df.select(F.col("p_partkey").alias("id"), leaf[0].alias("leaf0"), leaf[1].alias("leaf1"))


def _estimated(spark, sf_dir, cls, label: str, features: list[str], **given):
    df = _vectors(_part(spark, sf_dir), features)
    return df, cls(labelCol=label, keyCol="p_partkey", maxIter=2, maxDepth=2, maxBins=16, stepSize=0.5, discretizationType="width", **given)


@query(f"{_PLAIN.ctes()}, l AS (SELECT x0_2.id, {_LEAF} FROM x0_2 JOIN x1_2 ON x0_2.id = x1_2.id), n AS (SELECT MAX(leaf0) + 1 AS n0, MAX(leaf1) + 1 AS n1 FROM l) "
       "SELECT id, CAST(n0 + n1 AS INT) AS size, CAST(leaf0 AS INT) AS one, CAST(n0 + leaf1 AS INT) AS other FROM l, n")
def leaf_one_hot(spark, sf_dir):
    df, est = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART, leafCol="leaf", enableOneHot=True)
    dense = vector_to_array(F.col("leaf"))
    ones = F.filter(F.sequence(F.lit(0), F.size(dense) - 1), lambda i: F.get(dense, i) == 1.0)
    return est.fit(df).transform(df).select(F.col("p_partkey").alias("id"), F.size(dense).alias("size"), F.get(ones, F.lit(0)).alias("one"), F.get(ones, F.lit(1)).alias("other"))


@query(ORACLE_SQL["leaf_index"])
def leaf_column(spark, sf_dir):
    df, est = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART, leafCol="leaf")
    leaf = vector_to_array(F.col("leaf"))
    return est.fit(df).leaf(df).select(F.col("p_partkey").alias("id"), leaf[0].cast("int").alias("leaf0"), leaf[1].cast("int").alias("leaf1"))


@query(f"{_PLAIN.ctes()} SELECT col AS col_id, COUNT(*)::DOUBLE AS numsplits, ROUND(SUM(gain), 2) AS sumgain, ROUND(AVG(gain), 2) AS avggain FROM ({_PLAIN.splits()}) GROUP BY col")
def importance(spark, sf_dir):
    _, model, _ = _part_fit(spark, sf_dir)
    found = {kind: model.importances(kind) for kind in ("numsplits", "sumgain", "avggain")}
    rows = [(c, *(float(found[kind][c]) for kind in found)) for c in found["numsplits"]]
    return spark.createDataFrame(rows, "col_id int, numsplits double, sumgain double, avggain double").select("col_id", "numsplits", F.round("sumgain", 2).alias("sumgain"), F.round("avggain", 2).alias("avggain"))


@query(f"{_PLAIN.ctes()} SELECT col AS col_id, COUNT(*)::DOUBLE AS importance FROM ({_PLAIN.splits()}) WHERE tree = 0 GROUP BY col")
def importance_of_first_trees(spark, sf_dir):
    df, est = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART, firstTrees=1)
    found = est.fit(df).featureImportances
    return spark.createDataFrame([(int(i), float(v)) for i, v in zip(found.indices, found.values)], "col_id int, importance double")


@query(f"{_PLAIN.ctes()} SELECT CAST(tree AS INT) AS tree, CAST(COUNT(*) + 1 AS INT) AS leaves, CAST(2 * COUNT(*) + 1 AS INT) AS nodes, CAST(MAX(FLOOR(LOG2(node)) + 1) AS INT) AS depth FROM ({_PLAIN.splits()}) GROUP BY tree")
def tree_stats(spark, sf_dir):
    _, model, _ = _part_fit(spark, sf_dir)
    rows = list(zip(range(model.num_trees), model.num_leaves, model.num_nodes, model.depths))
    return spark.createDataFrame(rows, "tree int, leaves int, nodes int, depth int")


@query(f"{_BINARY.ctes()}, r AS (SELECT id, {_BINARY.final_raw()} AS r FROM rows2) SELECT id, ROUND(-r, 6) AS raw0, ROUND(r, 6) AS raw1, ROUND(1 - 1 / (1 + EXP(-r)), 6) AS p0, ROUND(1 / (1 + EXP(-r)), 6) AS p1, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM r")
def classifier_binary(spark, sf_dir):
    df, est = _estimated(spark, sf_dir, ml.BoostedClassifier, "binary", ["p_partkey", "p_retailprice"])
    raw, p = vector_to_array(F.col("rawPrediction")), vector_to_array(F.col("probability"))
    return est.fit(df).transform(df).select(F.col("p_partkey").alias("id"), *(F.round(c[k], 6).alias(f"{n}{k}") for n, c in (("raw", raw), ("p", p)) for k in (0, 1)), "prediction")


_RAWS = [f"({_THREE.final_raw(k)})" for k in range(3)]


@query(f"{_THREE.ctes()}, r AS (SELECT id, " + ", ".join(f"{r} AS r{k}" for k, r in enumerate(_RAWS)) + " FROM rows2) SELECT id, ROUND(r0, 6) AS raw0, ROUND(r1, 6) AS raw1, ROUND(r2, 6) AS raw2, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0.0 WHEN r1 >= r2 THEN 1.0 ELSE 2.0 END::DOUBLE AS prediction FROM r")
def classifier_three(spark, sf_dir):
    df, est = _estimated(spark, sf_dir, ml.BoostedClassifier, "three", ["p_partkey", "p_retailprice"], objectiveFunc="softmax")
    raw = vector_to_array(F.col("rawPrediction"))
    return est.fit(df).transform(df).select(F.col("p_partkey").alias("id"), *(F.round(raw[k], 6).alias(f"raw{k}") for k in range(3)), "prediction")


# -- histories and callbacks -----------------------------------------------------------------------------------------

_ERRORS = " UNION ALL ".join(f"SELECT {n} AS round_, ROUND(AVG(POWER(y - ({_PLAIN.final_raw(0, n)}), 2)), 2) AS mse, ROUND(AVG(ABS(y - ({_PLAIN.final_raw(0, n)}))), 4) AS mae FROM rows2" for n in (1, 2))


def _history(spark, history: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(h["mse"]), float(h["mae"])) for i, h in enumerate(history)], "round_ int, mse double, mae double").select("round_", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


@query(f"{_PLAIN.ctes()} {_ERRORS}")
def metric_history(spark, sf_dir):
    """Metrics after each round, of dealt rows, in one pass."""
    _, _, history = _part_fit(spark, sf_dir, more={"metrics": ["mse", "mae"], "local": False})
    return _history(spark, history["train"])


@query(f"{_PLAIN.ctes()} {_ERRORS}")
def callback_recorder(spark, sf_dir):
    """The validation history that a recorder has kept."""
    recorder = Recorder()
    _part_fit(spark, sf_dir, more={"metrics": ["mse", "mae"], "valid": _part(spark, sf_dir), "callbacks": [recorder]})
    return _history(spark, recorder.valid)


@query(FitSql(_ROWS, 2, [_MEAN], working=lambda r: [0.5] * r, final=[0.5, 0.25]).scores())
def callback_update(spark, sf_dir):
    """A callback halves the step after the first round."""
    df, model, _ = _part_fit(spark, sf_dir, more={"callbacks": [Custom(lambda p, m, i, train, valid: p.update(step_size=0.25))]})
    return _predicted(df, model)


_WILD = FitSql(_ROWS, 2, [_MEAN], step=3.0)


@query(f"{_WILD.ctes()}, e AS (SELECT AVG(POWER(y - ({_WILD.final_raw(0, 1)}), 2)) AS one, AVG(POWER(y - ({_WILD.final_raw(0, 2)}), 2)) AS two FROM rows2) SELECT CASE WHEN two >= one THEN 2 ELSE 5 END AS trees FROM e")
def callback_early_stop(spark, sf_dir):
    """A step so long that the second round is worse than the first."""
    stop = EarlyStop([M.metric("mse")], 1)
    _, model, _ = _part_fit(spark, sf_dir, more={"metrics": ["mse"], "valid": _part(spark, sf_dir), "callbacks": [stop]}, max_iter=5, step_size=3.0)
    return spark.createDataFrame([(model.num_trees,)], "trees int")


@query(f"{_PLAIN.ctes()} SELECT id, ROUND({_PLAIN.final_raw(0, 1)}, 4) AS prediction FROM rows2")
def callback_checkpoint(spark, sf_dir):
    """The model that a checkpoint saved after the first round, beside the second."""
    path = temporary(spark, "models")
    df, _, _ = _part_fit(spark, sf_dir, more={"callbacks": [Checkpoint(lambda m, p: m.save(spark, p), path, 1)]})
    return _predicted(df, BoostedModel.load(spark, f"{path}/model-1-1"))


# -- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_parquet(spark, sf_dir):
    return load(spark, "parquet", f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey::DOUBLE AS label, CAST(i AS INT) AS i, CASE WHEN i = 0 THEN n_regionkey ELSE n_nationkey * 2 END::DOUBLE AS value FROM nation, (VALUES (0), (6)) t(i)")
def io_libsvm(spark, sf_dir):
    """Lines of a label and index:value pairs, from one; the number of features is given."""
    path = temporary(spark, "libsvm")
    n = _table(spark, sf_dir, "nation")
    n.select(F.concat_ws(" ", F.col("n_nationkey"), F.concat(F.lit("1:"), F.col("n_regionkey")), F.concat(F.lit("7:"), F.col("n_nationkey") * 2))).write.text(f"{path}/lines")
    array = vector_to_array(F.col("features"))
    return load(spark, "libsvm@9", f"{path}/lines").filter(F.size(array) == 9).select("label", F.explode(F.array(F.lit(0), F.lit(6))).alias("i"), array.alias("a")).select("label", "i", F.get("a", F.col("i")).alias("value"))


@query("SELECT 'region' AS name, r_regionkey::BIGINT AS k, r_name AS v FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def io_tables(spark, sf_dir):
    path = temporary(spark, "tables")
    save_tables({"region": _table(spark, sf_dir, "region"), "nation": _table(spark, sf_dir, "nation")}, path)
    found = load_tables(spark, ["region", "nation"], path)
    each = [found[t].select(F.lit(t).alias("name"), F.col(f"{t[0]}_{t}key").cast("long").alias("k"), F.col(f"{t[0]}_name").alias("v")) for t in ("region", "nation")]
    return each[0].unionByName(each[1])


@query(ORACLE_SQL["bin_width"])
def io_discretizer(spark, sf_dir):
    """Bins of a saved discretizer."""
    df, cols, path = _table(spark, sf_dir, "lineitem"), [F.col(c) for c in LINE], temporary(spark, "bins")
    disc, _ = Discretizer.fit(df, cols, Params(max_bins=16))
    save_tables(disc.tables(spark), path)
    again = Discretizer.from_tables(load_tables(spark, ["params", "nonNumCols", "colDiscretizers"], path))
    return _bin_counts(df.withColumn("bins", again.transform(cols)))


@query(_PLAIN.scores())
def io_model(spark, sf_dir):
    df, model, _ = _part_fit(spark, sf_dir)
    path = temporary(spark, "model")
    model.save(spark, path)
    return _predicted(df, BoostedModel.load(spark, path))


@query(_PLAIN.scores())
def io_estimator(spark, sf_dir):
    """Estimator and model, each written and read again."""
    path = temporary(spark, "estimator")
    df, est = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART)
    est.write().save(f"{path}/est")
    ml.BoostedRegressor.load(f"{path}/est").fit(df).write().save(f"{path}/model")
    return ml.BoostedRegressionModel.load(f"{path}/model").transform(df).select(F.col("p_partkey").alias("id"), F.round("prediction", 4).alias("prediction"))


@query(_PLAIN.scores())
def io_config(spark, sf_dir):
    """A fit from a config of keys and values, and the model that it saved."""
    path = temporary(spark, "config")
    df, _ = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART)
    df.write.parquet(f"{path}/train")
    config = {"task": "regression", "inputType": "parquet", "trainPath": f"{path}/train", "modelSavePath": f"{path}/model", "labelCol": "price", "keyCol": "p_partkey",
              "maxIter": 2, "maxDepth": 2, "maxBins": 16, "stepSize": 0.5, "discretizationType": "width"}
    run_config(spark, config)
    return ml.BoostedRegressionModel.load(f"{path}/model").transform(df).select(F.col("p_partkey").alias("id"), F.round("prediction", 4).alias("prediction"))


@query(_PLAIN.scores())
def io_stream(spark, sf_dir):
    """A stream of rows scored by a fitted model."""
    path = temporary(spark, "stream")
    df, est = _estimated(spark, sf_dir, ml.BoostedRegressor, "price", PART)
    model = est.fit(df)
    df.select("p_partkey", "features").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    score_stream(stream, model, f"{path}/out", f"{path}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("p_partkey").alias("id"), F.round("prediction", 4).alias("prediction"))


def _cells(data: DataFrame) -> DataFrame:
    """(id, col_id, bin) of the filled cells of a binned table."""
    pairs = F.arrays_zip("cols", "bins") if "cols" in data.columns else F.transform("bins", lambda b, i: F.struct(i.alias("cols"), b.alias("bins")))
    return data.select(F.col("key").alias("id"), F.explode(pairs).alias("c")).select("id", F.col("c.cols").cast("int").alias("col_id"), F.col("c.bins").alias("bin"))


@query(f"WITH {_ROWS} SELECT id, 0 AS col_id, b0 AS bin FROM rows0 UNION ALL SELECT id, 1, b1 FROM rows0")
def bin_rows(spark, sf_dir):
    df, cols = _table(spark, sf_dir, "part"), [F.col(c) for c in PART]
    disc, _ = Discretizer.fit(df, cols, Params(max_bins=16, discretization_type="width"))
    return _cells(prepare(df, disc, cols, F.lit(0.0), F.lit(1.0), [0.0], F.col("p_partkey")))


@query("SELECT p_partkey AS id, 1 AS col_id, CAST(LEAST(p_size, 31) AS INT) AS bin FROM part UNION ALL SELECT p_partkey, 0, CAST(p_partkey % 3 AS INT) FROM part WHERE p_partkey % 3 > 0")
def bin_rows_sparse(spark, sf_dir):
    """Vectors keep filled cells alone where zeros are in bin 0."""
    df = _vectors(_table(spark, sf_dir, "part").withColumn("third", (F.col("p_partkey") % 3).cast("double")), ["third", "p_size"])
    disc, _ = Discretizer.fit(df, [F.col("third"), F.col("p_size")], Params(max_bins=32, discretization_type="round"))
    return _cells(prepare(df, disc, [], F.lit(0.0), F.lit(1.0), [0.0], F.col("p_partkey"), sparse=F.col("features")))


@query("SELECT CAST(col_id AS INT) AS col_id, 15 AS bins, 0 AS off FROM (VALUES (0), (1)) t(col_id)")
def bin_depth(spark, sf_dir):
    """Quantiles by sketch: splits that are further from their rank than a sixteenth of a bin, of which there are none."""
    df, rows = _table(spark, sf_dir, "lineitem"), []
    disc, _ = Discretizer.fit(df, [F.col("l_extendedprice"), F.col("l_orderkey")], Params(max_bins=16, discretization_type="depth"))
    for i, name in enumerate(("l_extendedprice", "l_orderkey")):
        splits = disc.columns[i]["splits"]
        found = df.agg(F.count("*"), *(F.count(F.when(F.col(name) <= s, 1)) for s in splits), *(F.count(F.when(F.col(name) < s, 1)) for s in splits)).first()
        n, upto, under = found[0], found[1 : 1 + len(splits)], found[1 + len(splits) :]
        ranks = [(k + 0.5) / 14 * n for k in range(14)]
        off = sum(not lo - n / 256 - 1 <= r <= hi + n / 256 + 1 for r, lo, hi in zip(ranks, under, upto))
        rows.append((i, len(splits) + 1, off))
    return spark.createDataFrame(rows, "col_id int, bins int, off int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model, _ = _part_fit(spark, sf_dir, max_iter=5, max_bins=64, max_depth=5)
    return df.select("p_partkey", "p_retailprice", model.predict([F.col(c) for c in PART])[0].alias("prediction"))
