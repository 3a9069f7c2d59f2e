"""The data model: a relation is a DataFrame whose column ``__w`` (BIGINT) says how often a row holds.

A table has weight 1 everywhere, a change has positive weights for inserts and negative ones for deletes. A changelog adds
``__t`` (BIGINT), the logical time at which a change happens. All other columns make up the record; records are equal when
all their columns are, with NULL equal to NULL. Rows of one record may be spread (a bag); :func:`consolidate` brings them
together and drops those whose weights cancel. It is the only shuffle in the linear part of the algebra and is therefore
applied only where a following operator is not linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W, T = "__w", "__t"


def record_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (W, T)]


def is_changelog(df: DataFrame) -> bool:
    return T in df.columns


def keys(df: DataFrame) -> list[str]:
    """The record's columns and, in a changelog, the time."""
    return [*record_columns(df), *([T] if is_changelog(df) else [])]


def quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def weighted(df: DataFrame, weight: Column | int = 1, time: Column | int | None = None) -> DataFrame:
    """A plain DataFrame as a Z-set (or, with a time, as a changelog)."""
    out = df.withColumn(W, (weight if isinstance(weight, Column) else F.lit(weight)).cast("long"))
    return out if time is None else out.withColumn(T, (time if isinstance(time, Column) else F.lit(time)).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """One row per record (and time), with the sum of its weights, without zeros. Partial sums form before the shuffle."""
    names = keys(df)
    return df.groupBy(*quoted(names)).agg(F.sum(W).cast("long").alias(W)).where(F.col(W) != 0).select(*quoted([*names, W]))


def scale(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumn(W, (F.col(W) * F.lit(factor)).cast("long")).where(F.col(W) != 0)


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(union_all(a, b))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, negate(b))


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def unweighted(df: DataFrame, *, bag: bool = False) -> DataFrame:
    """Rows that hold: each once, or with ``bag`` as often as its weight says. The input is consolidated first."""
    out = consolidate(df).where(F.col(W) > 0)
    if bag:
        out = out.withColumn(W, F.explode(F.array_repeat(F.lit(1), F.col(W).cast("int"))))
    return out.drop(W)
