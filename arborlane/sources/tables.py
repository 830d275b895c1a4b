"""Sources and sinks: libsvm and Parquet inputs, small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """``parquet``, ``libsvm`` or ``libsvm@N`` with N features."""
    if kind == "parquet":
        return spark.read.parquet(path)
    name, _, n = kind.partition("@")
    if name != "libsvm":
        raise ValueError(f"input type {kind!r} is not parquet, libsvm or libsvm@N")
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", n) if n else reader).load(path)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Small tables, one file each, at path/name."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
