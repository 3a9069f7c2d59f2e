"""Incremental forms: from the changelogs of the inputs to the changelog of the result, for a whole timeline at once.

Joins need none of their own (see :mod:`.relational`: the product of two changelogs is already the changelog of the join)
and linear operators are their own incremental form. What is here is not linear: distinct, set operations, aggregates and
top-k. :func:`by_snapshots` is the definition they are tested against: integrate, apply, differentiate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import T, W, consolidate, negate, quoted, record_columns, union_all
from . import relational as r


def _running(columns: list[str]):
    return Window.partitionBy(*quoted(columns)).orderBy(T).rowsBetween(Window.unboundedPreceding, 0)


def distinct(log: DataFrame) -> DataFrame:
    """+1 where the running weight of a record becomes positive, -1 where it stops being so."""
    now = F.sum(W).over(_running(record_columns(log)))
    rows = consolidate(log).withColumn("__now", now).withColumn("__was", now - F.col(W))
    step = (F.col("__now") > 0).cast("long") - (F.col("__was") > 0).cast("long")
    return rows.withColumn(W, step).where(F.col(W) != 0).drop("__now", "__was")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(union_all(a, b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct(union_all(a, negate(b)))


def aggregate(log: DataFrame, by: Sequence[str], values: dict[str, Column], results: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """Grouped aggregates that are functions of sums: at each time the old row of a changed group leaves, the new enters.

    ``values`` are summed with the weights (``count`` is always among the sums); each result is a function of the dict of
    sums. A group exists while any of its records has a non-zero weight, counted record by record; without ``by`` there
    is always a row from the first time on.
    """
    names = record_columns(log)
    alive = (F.col("__now") != 0).cast("long") - (F.col("__now") - F.col(W) != 0).cast("long")
    rows = consolidate(log).withColumn("__now", F.sum(W).over(_running(names))).withColumn("__alive", alive)
    sums = {"count": F.sum(W).cast("long")} | {k: F.sum(F.coalesce(v, F.lit(0)) * F.col(W)) for k, v in values.items()}
    ticks = rows.groupBy(*quoted([*by, T])).agg(F.sum("__alive").alias("__live"), *[v.alias(f"__s_{k}") for k, v in sums.items()])
    over = _running(list(by))
    new = {k: F.sum(f"__s_{k}").over(over) for k in sums}
    state = ticks.select(*quoted([*by, T]), F.sum("__live").over(over).alias("__n"), *[v.alias(f"__n_{k}") for k, v in new.items()])
    step = Window.partitionBy(*quoted(list(by))).orderBy(T)
    for c in [c for c in state.columns if c.startswith("__n")]:
        state = state.withColumn(c.replace("__n", "__o", 1), F.lag(c).over(step))
    result = lambda side: [f({k: F.col(f"__{side}_{k}") for k in sums}).alias(n) for n, f in results.items()]
    some = (lambda side: F.col(f"__{side}") != 0) if by else (lambda side: F.col(f"__{side}").isNotNull())
    entering = state.where(some("n")).select(*quoted([*by]), *result("n"), T, F.lit(1).cast("long").alias(W))
    leaving = state.where(some("o")).select(*quoted([*by]), *result("o"), T, F.lit(-1).cast("long").alias(W))
    return consolidate(entering.unionByName(leaving))


def count(s: dict[str, Column]) -> Column:
    return s["count"]


def total(name: str) -> Callable[[dict[str, Column]], Column]:
    return lambda s: s[name]


def average(name: str) -> Callable[[dict[str, Column]], Column]:
    return lambda s: s[name] / F.nullif(s["count"], F.lit(0))


def snapshots(log: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """The integral at every time of ``times`` (a column ``__t``; by default all times that occur), as one changelog-shaped
    table. A range join with the few times, which are broadcast by their size."""
    ticks = (log if times is None else times).select(F.col(T).alias("__at")).distinct()
    rows = consolidate(log).join(ticks, F.col(T) <= F.col("__at"))
    return consolidate(rows.withColumn(T, F.col("__at")).drop("__at"))


def _next_time(times: DataFrame) -> DataFrame:
    w = Window.orderBy(T)
    return times.select(T).distinct().select(T, F.lead(T).over(w).alias("__next"))


def differences(snaps: DataFrame, times: DataFrame) -> DataFrame:
    """Each snapshot minus the one at the time before it among ``times``."""
    following = snaps.join(_next_time(times), T).where(F.col("__next").isNotNull())
    return consolidate(union_all(snaps, negate(following.withColumn(T, F.col("__next")).drop("__next").select(*snaps.columns))))


def by_snapshots(per_tick: Callable[..., DataFrame], *logs: DataFrame) -> DataFrame:
    """Any operator that works per tick, made incremental by its definition."""
    times = logs[0].select(T)
    for log in logs[1:]:
        times = times.union(log.select(T))
    times = times.distinct()
    return differences(per_tick(*[snapshots(log, times) for log in logs]), times)


#: Of the blocks of 2^l times, l from 0 to ``__levels``, those that make up the span from ``__a`` up to ``__b``: a block that
#: lies in the span while the block of twice the size around it does not.
_NODES = """flatten(transform(sequence(0, __levels), l -> transform(filter(
    array_distinct(array(shiftright(__a + shiftleft(1L, l) - 1, l), shiftright(__b, l) - 1)),
    j -> shiftright(__a + shiftleft(1L, l) - 1, l) <= shiftright(__b, l) - 1 AND (l = __levels OR NOT (
        shiftleft(shiftright(j, 1), l + 1) >= __a AND shiftleft(shiftright(j, 1) + 1, l + 1) <= __b))),
    j -> struct(l AS level, j AS node))))"""


def top_k(log: DataFrame, order: Sequence[Column], k: int | None = None, offset: int = 0) -> DataFrame:
    """Which records enter and leave the window of ranks at each time. Put a unique tie-break last in ``order``.

    A record holds for spans of times. A binary tree over the times cuts each span into few nodes; of a node's records only
    the first ``k + offset`` can be in a window of any of its times, and a time finds its window among those of the nodes
    above it. Rows grow with the logarithm of the number of times, and no snapshot is made.
    """
    held = distinct(log)
    if k is None:
        return consolidate(union_all(held, negate(top_k(log, order, offset)))) if offset else held
    names = record_columns(log)
    ticks = held.select(T).distinct().withColumn("__at", F.row_number().over(Window.orderBy(T)).cast("long") - 1)
    levels = F.broadcast(ticks.agg(F.ceil(F.log2(F.max("__at") + 1)).cast("int").alias("__levels")))  # one row
    spans = held.withColumn("__until", F.lead(T).over(Window.partitionBy(*quoted(names)).orderBy(T))).where(F.col(W) > 0)
    spans = spans.join(ticks.select(F.col(T).alias("__t1"), F.col("__at").alias("__a")), F.col(T) == F.col("__t1"))
    spans = spans.join(ticks.select(F.col(T).alias("__t2"), F.col("__at").alias("__b")), F.col("__until") == F.col("__t2"), "left")
    spans = spans.crossJoin(levels).select(*quoted(names), "__a", "__levels", F.coalesce("__b", F.expr("shiftleft(1L, __levels)")).alias("__b"))
    nodes = spans.select(*quoted(names), F.explode(F.expr(_NODES)).alias("__node")).select(*quoted(names), "__node.level", "__node.node")
    first = nodes.withColumn("__rank", F.row_number().over(Window.partitionBy("level", "node").orderBy(*order))).where(F.col("__rank") <= k + offset)
    above = ticks.crossJoin(levels).select(T, F.explode(F.expr("transform(sequence(0, __levels), l -> struct(l AS level, shiftright(__at, l) AS node))")).alias("n")).select(T, "n.level", "n.node")
    near = first.drop("__rank").join(above, ["level", "node"]).drop("level", "node")
    near = near.withColumn("__rank", F.row_number().over(Window.partitionBy(T).orderBy(*order)))
    window = near.where((F.col("__rank") > offset) & (F.col("__rank") <= offset + k)).drop("__rank").withColumn(W, F.lit(1).cast("long"))
    return differences(window.select(*quoted([*names, T, W])), ticks)


def bilinear_by_integrals(a: DataFrame, b: DataFrame, product: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A bilinear operator by the older form I(a) x b + a x z^-1(I(b)): what the single product of changelogs is tested against.

    ``product`` works per tick and must keep the time of both sides equal.
    """
    times = a.select(T).union(b.select(T)).distinct()
    following = _next_time(times).where(F.col("__next").isNotNull())
    late = snapshots(b, times).join(following, T).withColumn(T, F.col("__next")).drop("__next").select(*b.columns)
    return consolidate(union_all(product(snapshots(a, times), b), product(a, late)))
