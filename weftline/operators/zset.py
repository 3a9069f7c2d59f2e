"""Z-sets as values: construction, predicates and the Abelian group over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from ..functions import weights as w


@dataclass(frozen=True)
class ZSet:
    """An immutable Z-set over a DataFrame. ``merged`` says that every record is known to stand in one row."""

    df: DataFrame
    merged: bool = False

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[tuple], schema: str) -> ZSet:
        """From (record..., weight) tuples; ``schema`` names the record's columns."""
        fields = types.StructType.fromDDL(schema).fields
        return ZSet(spark.createDataFrame(list(rows), types.StructType([*fields, types.StructField(w.W, types.LongType(), False)])))

    @staticmethod
    def from_table(df: DataFrame, weight: Column | int = 1) -> ZSet:
        return ZSet(w.weighted(df, weight))

    @staticmethod
    def make(df: DataFrame) -> ZSet:
        """A one-row result (such as an aggregate) as the set that holds it once."""
        return ZSet(w.weighted(df), merged=True)

    @property
    def data(self) -> DataFrame:
        return self.df

    def append(self, other: DataFrame) -> ZSet:
        return ZSet(w.union_all(self.df, other))

    concat = append

    def merge(self) -> ZSet:
        return self if self.merged else ZSet(w.consolidate(self.df), merged=True)

    def is_set(self) -> bool:
        return self.merge().df.where(F.col(w.W) != 1).isEmpty()

    def is_positive(self) -> bool:
        return self.merge().df.where(F.col(w.W) < 0).isEmpty()

    def is_empty(self) -> bool:
        return self.merge().df.isEmpty()

    def multiply(self, factor: int) -> ZSet:
        return ZSet(w.scale(self.df, factor), self.merged)

    def zero(self) -> ZSet:
        return ZSet(w.empty_like(self.df), merged=True)

    def __add__(self, other: ZSet) -> ZSet:
        return ZSet(w.add(self.df, other.df), merged=True)

    def __sub__(self, other: ZSet) -> ZSet:
        return ZSet(w.subtract(self.df, other.df), merged=True)

    def __neg__(self) -> ZSet:
        return ZSet(w.negate(self.df), self.merged)


@dataclass(frozen=True)
class Pair:
    """The product group: two Z-sets, as operators with two inputs take them."""

    left: ZSet
    right: ZSet

    def zero(self) -> Pair:
        return Pair(self.left.zero(), self.right.zero())

    def __add__(self, other: Pair) -> Pair:
        return Pair(self.left + other.left, self.right + other.right)

    def __sub__(self, other: Pair) -> Pair:
        return Pair(self.left - other.left, self.right - other.right)

    def __neg__(self) -> Pair:
        return Pair(-self.left, -self.right)
