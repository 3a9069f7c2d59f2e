"""Files in and out: batch tables, signed changelogs and file streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as types

from ..functions.weights import T, W, weighted


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: types.StructType | str | None = None, **options) -> DataFrame:
    """A plain table. Text formats (csv, json) need a schema: inferring one would read the data twice."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"give a schema for {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_changelog(spark: SparkSession, path: str, *, time: Column | None = None, weight: Column | int = 1, **options) -> DataFrame:
    """A changelog: stored ``__t`` and ``__w`` columns, or ones computed from the row."""
    df = read_table(spark, path, **options)
    return df if time is None and {T, W} <= set(df.columns) else weighted(df, weight, time if time is not None else 0)


def write_changelog(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append changes, one folder for each time, so that readers of a span of times prune the others."""
    log.write.mode(mode).partitionBy(T).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: types.StructType | str, kind: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
