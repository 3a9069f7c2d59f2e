"""Relational operators over Z-sets. Given changelogs, those marked *per tick* work within each time for itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import T, W, consolidate, is_changelog, keys, negate, quoted, record_columns, union_all

Order = Sequence[Column]


def where(z: DataFrame, condition: Column | str) -> DataFrame:
    """Linear: weights stay as they are."""
    return z.where(condition)


def project(z: DataFrame, *columns: Column | str, merge: bool = True) -> DataFrame:
    """Linear. Records that become equal add up their weights, unless ``merge`` is off and a later step does it."""
    out = z.select(*columns, *([T] if is_changelog(z) else []), W)
    return consolidate(out) if merge else out


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both inputs aliased ``l`` and ``r`` and the record of a match: clashing names get the prefix of their side."""
    left, right = record_columns(a), record_columns(b)
    clash = set(left) & set(right)
    out = [F.col(f"l.`{c}`").alias(f"l_{c}" if c in clash else c) for c in left]
    out += [F.col(f"r.`{c}`").alias(f"r_{c}" if c in clash else c) for c in right]
    return a.alias("l"), b.alias("r"), out


def _product(a: DataFrame, b: DataFrame, condition: Column | None, merge: bool, spread: int = 1) -> DataFrame:
    """The bilinear core. Over changelogs a match holds from the later of both times on, which adds up to the delta of
    the join of both integrals; no state and no loop over times is needed.

    To merge, the sides are consolidated, not the product, which may be as large as their product: records that occur
    once make each match once. Only over changelogs can a match come at one time from several pairs of times.
    """
    if is_changelog(a) != is_changelog(b):
        raise ValueError("join a changelog with a changelog, or a Z-set with a Z-set")
    if merge:
        a, b = consolidate(a), consolidate(b)
    left, right, out = _sides(a, b)
    if spread > 1:
        left = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).alias("l").hint("merge")
        right = right.withColumn("__block", F.pmod(F.xxhash64(*quoted(keys(b))), F.lit(spread)).cast("int")).alias("r")
        condition &= F.col("l.__block") == F.col("r.__block")
    joined = left.crossJoin(right) if condition is None else left.join(right, condition)
    weight = (F.col(f"l.{W}") * F.col(f"r.{W}")).cast("long").alias(W)
    time = [F.greatest(f"l.{T}", f"r.{T}").alias(T)] if is_changelog(a) else []
    product = joined.select(*out, *time, weight).where(F.col(W) != 0)
    return consolidate(product) if merge and time else product


def cartesian(a: DataFrame, b: DataFrame, *, merge: bool = True) -> DataFrame:
    """All pairs; weights multiply."""
    return _product(a, b, None, merge)


def equi_join(a: DataFrame, b: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, *, merge: bool = True) -> DataFrame:
    """Inner join on equal keys, NULL equal to NULL; weights multiply. Plans as a hash or sort-merge join."""
    pairs = zip(left_on, right_on or left_on, strict=True)
    match = reduce(lambda x, y: x & y, [F.col(f"l.`{x}`").eqNullSafe(F.col(f"r.`{y}`")) for x, y in pairs])
    return _product(a, b, match, merge)


def theta_join(a: DataFrame, b: DataFrame, condition: Column, *, merge: bool = True, spread: int = 1) -> DataFrame:
    """Inner join on any condition over ``l.`` and ``r.`` columns; Catalyst takes equalities out of it as keys.

    Where keys have few values, ``spread`` deals the rows of ``b`` over so many blocks and copies those of ``a``, the smaller
    side, to each: as many more tasks share the matches, and none holds more than a block of a key.
    """
    return _product(a, b, condition, merge, spread)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of both; weights multiply."""
    left, right = consolidate(a), consolidate(b)
    names = record_columns(left)
    joined = equi_join(left, right.select(*quoted(keys(left)), W), names, merge=False)
    return consolidate(joined.select(*[F.col(f"`l_{c}`").alias(c) for c in names], *([T] if is_changelog(joined) else []), W))


def distinct(z: DataFrame) -> DataFrame:
    """Per tick: records of positive total weight, once."""
    return consolidate(z).where(F.col(W) >= 1).withColumn(W, F.lit(1).cast("long"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(union_all(a, b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(union_all(a, negate(b)))


def count() -> Column:
    return F.coalesce(F.sum(W), F.lit(0)).cast("long")


def total(value: Column | str, *, sql_nulls: bool = False) -> Column:
    """Sum of value times weight: 0 over no rows and NULL as 0, or with ``sql_nulls`` NULL where no value is."""
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v * F.col(W)) if sql_nulls else F.coalesce(F.sum(F.coalesce(v, F.lit(0)) * F.col(W)), F.lit(0))


def average(value: Column | str, *, sql_nulls: bool = False) -> Column:
    """Total over count, NULL where the weights add up to 0. NULL values count, unless ``sql_nulls`` leaves them out."""
    v = F.col(value) if isinstance(value, str) else value
    weight = F.sum(F.when(v.isNotNull(), F.col(W))) if sql_nulls else F.sum(W)
    return total(v, sql_nulls=sql_nulls) / F.nullif(weight, F.lit(0))


def aggregate(z: DataFrame, by: Sequence[str], /, **columns: Column) -> DataFrame:
    """Per tick: one row for each group that has a record of non-zero weight, each of weight 1.

    Without ``by`` there is one row even over no records. The input is consolidated first, so that cancelled records keep
    no group alive, while a group in which weights of different records add up to 0 stays.
    """
    times = [T] if is_changelog(z) else []
    out = consolidate(z).groupBy(*quoted([*by, *times])).agg(*[c.alias(n) for n, c in columns.items()])
    return out.withColumn(W, F.lit(1).cast("long"))


def extremes(z: DataFrame, by: Sequence[str], /, **columns: Column) -> DataFrame:
    """Aggregates that no retraction can undo (minimum, maximum): over the records of positive weight."""
    return aggregate(consolidate(z).where(F.col(W) > 0), by, **columns)


def top_k(z: DataFrame, order: Order, k: int | None = None, offset: int = 0, *, rank: bool = False) -> DataFrame:
    """Records of positive weight in order, from ``offset`` on, ``k`` at most, each once. Put a unique tie-break last.

    A Z-set is cut by a distributed top-k; a changelog per tick by a rank within each time. ``rank`` adds ``__rank``, from 0;
    without ``k`` it comes from sorted ranges and their sizes, and no task sees all rows.
    """
    rows = distinct(z)
    if is_changelog(z):
        rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(T).orderBy(*order)) - 1 - offset)
        rows = rows.where((F.col("__rank") >= 0) & (F.col("__rank") < (k if k is not None else 1 << 62)))
        return rows if rank else rows.drop("__rank")
    if rank and k is None:
        return ranked(rows, order).where(F.col("__rank") >= offset).withColumn("__rank", F.col("__rank") - offset)
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(k) if k is not None else rows
    if rank:
        rows = rows.withColumn("__rank", F.row_number().over(Window.orderBy(*order)) - 1)
    return rows


def ranked(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` with ``__rank``, their place in the order from 0. Sorted ranges are written once, and their sizes added up."""
    from ..sources.state import StateStore

    place = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")
    parts = StateStore(rows.sparkSession).commit(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *place))
    sizes = parts.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    out = parts.join(sizes, F.col("__part") == F.col("__p")).withColumn("__rank", F.col("__before") + F.col("__place"))
    return out.drop("__part", "__place", "__p", "__before")


@dataclass(frozen=True)
class Indexed:
    """An indexed Z-set: a Z-set for each key. It is one table, of which the columns ``by`` are the key; a group may be as
    large as it likes, as its rows stay rows. Grouping is linear, so that changes of the Z-set are changes of its groups."""

    df: DataFrame
    by: tuple[str, ...]

    def get(self, *key) -> DataFrame:
        """The Z-set of one key, each record once; empty if the key is not there."""
        match = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in zip(self.by, key, strict=True)])
        return consolidate(self.df.where(match))

    def keys(self) -> DataFrame:
        return consolidate(self.df).select(*quoted(list(self.by))).distinct()

    def aggregate(self, **columns: Column) -> DataFrame:
        return aggregate(self.df, self.by, **columns)

    def __add__(self, other: Indexed) -> Indexed:
        return Indexed(union_all(self.df, other.df), self.by)


def group_by(z: DataFrame, *by: str) -> Indexed:
    return Indexed(z, by)


def order_by(z: DataFrame, order: Order, limit: int | None = None, offset: int = 0) -> DataFrame:
    return top_k(z, order, limit, offset)
