"""Recursive queries: iterate a monotone step until nothing new appears."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import W, record_columns, weighted
from ..operators.relational import distinct
from ..sources.state import StateStore, having


def fixed_point(seed: DataFrame, step: Callable[[DataFrame], DataFrame], store: StateStore, *, max_iterations: int | None = None) -> DataFrame:
    """Semi-naive least fixed point of ``x = distinct(seed + step(x))`` for a linear ``step``.

    Only what the last round has added goes through ``step``. Every round writes what it has added to ``store``, which cuts
    the lineage and survives lost executors; the loop ends when a round adds nothing, and only a given ``max_iterations``
    ends it earlier, with an error.
    """
    first = 0 if store.latest is None else store.latest + 1
    fresh = store.commit(distinct(seed))
    for _ in itertools.count() if max_iterations is None else range(max_iterations):
        found = store.read(*[v for v in store.versions if v >= first])
        names = record_columns(found)
        fresh = store.commit(having(distinct(step(fresh)), found, names, without=True))
        if fresh.isEmpty():
            return found
    raise RuntimeError(f"no fixed point after {max_iterations} rounds")


def _joined(paths: DataFrame, more: DataFrame) -> DataFrame:
    """Paths followed by those that begin where they end."""
    joined = paths.alias("p").join(more.alias("e"), F.col("p.dst") == F.col("e.src"))
    return joined.selectExpr("p.src AS src", "e.dst AS dst", f"p.{W} * e.{W} AS {W}")


def _single(edges: DataFrame, end: str) -> bool:
    """No node is this end of two edges. NULL joins with nothing and does not count."""
    return edges.where(F.col(end).isNotNull()).groupBy(end).count().where("count > 1").isEmpty()


def _doubled(jumps: StateStore, store: StateStore, forward: bool) -> DataFrame:
    """The closure where no node has two edges out (``forward``) or none has two in: a round doubles the length of paths.

    Paths of exactly 1, 2, 4, ... edges come first, no more of any length than edges. If they run out there is no cycle, a
    pair is joined by one path only, and each round adds new pairs without looking at those it has; else repeats are left out.
    """
    lengths = [jumps.read()]
    most = lengths[0].count()
    while (cyclic := not lengths[-1].isEmpty()) and 1 << (len(lengths) - 1) <= most:
        lengths.append(jumps.commit(_joined(lengths[-1], lengths[-1])))
    first = 0 if store.latest is None else store.latest + 1
    found = store.commit(lengths[0])
    for k in itertools.count():
        if k == len(lengths):
            lengths.append(jumps.commit(_joined(lengths[-1], lengths[-1])))
        more = _joined(found, lengths[k]) if forward else _joined(lengths[k], found)
        if cyclic:
            more = having(distinct(more), found, record_columns(found), without=True)
        if store.commit(more).isEmpty():
            return found
        found = store.read(*[v for v in store.versions if v >= first])


def transitive_closure(edges: DataFrame, store: StateStore) -> DataFrame:
    """Pairs (src, dst) joined by a path, from plain edges (src, dst).

    In trees, chains and other graphs in which no node has two edges out, or none has two in, rounds grow with the logarithm
    of the longest path; in others, where doubled paths could meet in many ways, with its length.
    """
    jumps = StateStore(store.spark)
    base = jumps.commit(distinct(weighted(edges.select("src", "dst"))))
    if (forward := _single(base, "src")) or _single(base, "dst"):
        return _doubled(jumps, store, forward)
    return fixed_point(base, lambda paths: _joined(paths, base), store)
