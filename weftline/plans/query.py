"""A fluent builder of queries over keyed tables, and views that follow the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import W, consolidate, unweighted, weighted
from ..operators import incremental as inc
from ..operators.relational import top_k
from ..sources.table import KeyedTable
from . import tree as p
from .maintain import Maintained

Order = str | Column


class Query:
    """A lazy query. Each method returns another one; nothing runs before :meth:`to_df`, :meth:`eval` or :meth:`reactive`."""

    def __init__(self, plan: p.Node, tables: dict[str, KeyedTable], order: tuple[Column, ...] = ()):
        self.plan, self.tables, self.order = plan, tables, order

    def _with(self, plan: p.Node, order: tuple[Column, ...] | None = None) -> Query:
        return Query(plan, self.tables, self.order if order is None else order)

    def where(self, condition: Column | str) -> Query:
        return self._with(p.Where((self.plan,), F.expr(condition) if isinstance(condition, str) else condition))

    def select(self, *columns: Column | str) -> Query:
        """Project without merging records that become equal."""
        return self._with(p.Project((self.plan,), columns, False), ())

    def distinct(self) -> Query:
        return self._with(p.Distinct((self.plan,)))

    def join(self, other: KeyedTable | Query, left_on: str | list[str], right_on: str | list[str] | None = None) -> Query:
        """Inner join, NULL keys equal. Clashing column names get ``l_`` and ``r_`` in front."""
        right = other if isinstance(other, Query) else create_query(other)
        keys = lambda k: tuple([k] if isinstance(k, str) else k)
        plan = p.EquiJoin((self.plan, right.plan), keys(left_on), keys(right_on or left_on))
        return Query(plan, self.tables | right.tables)

    def union(self, other: Query) -> Query:
        return Query(p.Union((self.plan, other.plan)), self.tables | other.tables)

    def difference(self, other: Query) -> Query:
        return Query(p.Difference((self.plan, other.plan)), self.tables | other.tables)

    def sort_by(self, *order: Order, descending: bool = False) -> Query:
        """Sort; equal rows become one. Name a unique column last for a stable order."""
        one = lambda c: c if isinstance(c, Column) else F.desc_nulls_last(c) if descending else F.asc_nulls_first(c)
        keys = tuple(one(c) for c in order)
        return self._with(p.TopK((self.plan,), keys), keys)

    def limit(self, n: int, offset: int = 0) -> Query:
        if not self.order:
            raise ValueError("limit needs a sort before it: rows have no order of their own")
        below = self.plan.inputs[0] if isinstance(self.plan, p.TopK) and self.plan.k is None and not self.plan.offset else self.plan
        return self._with(p.TopK((below,), self.order, n, offset))

    def group_by(self, *by: str) -> Grouped:
        return Grouped(self, by)

    def count(self) -> Query:
        return Grouped(self, ()).aggregate(count=inc.count)

    def sum(self, value: str) -> Query:
        return Grouped(self, ()).aggregate(sum=("sum", value))

    def average(self, value: str) -> Query:
        return Grouped(self, ()).aggregate(average=("average", value))

    def env(self) -> p.Env:
        return {k: t.to_zset() for k, t in self.tables.items()}

    def eval(self) -> DataFrame:
        """The result as a Z-set."""
        return consolidate(p.optimize(self.plan).eval(self.env()))

    def to_df(self, *, bag: bool = False) -> DataFrame:
        """The result's rows in the order of the last sort, each once (or as often as it holds)."""
        plan = p.optimize(self.plan)
        if self.order and not bag and isinstance(plan, p.TopK):
            return top_k(plan.inputs[0].eval(self.env()), plan.order, plan.k, plan.offset).drop(W)
        out = unweighted(plan.eval(self.env()), bag=bag)
        return out.orderBy(*self.order) if self.order else out

    def reactive(self) -> View:
        return View(self)


class Grouped:
    def __init__(self, query: Query, by: tuple[str, ...]):
        self.query, self.by = query, by

    def aggregate(self, **results) -> Query:
        """Named results: ``incremental.count``, ``("sum", column)``, ``("average", column)`` or a function of the sums."""
        values, named = {}, {}
        for name, spec in results.items():
            if callable(spec):
                named[name] = spec
            else:
                kind, column = spec
                values[f"v_{name}"] = F.col(column) if isinstance(column, str) else column
                named[name] = inc.total(f"v_{name}") if kind == "sum" else inc.average(f"v_{name}")
        return Query(p.Aggregate((self.query.plan,), self.by, values, named), self.query.tables)


class View:
    """A result kept in step with its tables. Contents are committed before anyone is told of a change."""

    def __init__(self, query: Query):
        self.query = query
        self.old = query.env()
        self.kept = Maintained(p.optimize(query.plan), next(iter(query.tables.values())).spark)
        self.kept.start(self.old.__getitem__)
        self.version, self.errors = 0, []
        self.subscribers: list[tuple[Callable, Callable | None]] = []
        self._end = [t.subscribe(lambda d, k=k: self._on(k, d)) for k, t in query.tables.items()]

    def _on(self, name: str, delta: DataFrame) -> None:
        """All subscribers are told, whatever one of them raises; errors are kept and the first is raised at the end."""
        self.version += 1
        change = self.kept.step(self.old.__getitem__, {name: delta}, self.version)
        self.old = self.old | {name: self.query.tables[name].to_zset()}
        failed = []
        for rows, changes in list(self.subscribers):
            try:
                rows(self.to_df())
                if changes and change is not None:
                    changes(change)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
        self.errors += failed
        if failed:
            raise failed[0]

    def to_df(self) -> DataFrame:
        out = self.kept.result.net().where(F.col(W) > 0).drop(W)
        return out.orderBy(*self.query.order) if self.query.order else out

    def subscribe(self, rows: Callable[[DataFrame], None], changes: Callable[[DataFrame], None] | None = None) -> Callable[[], None]:
        """Call ``rows`` with the contents now and after each change, ``changes`` with each change's Z-set."""
        entry = (rows, changes)
        self.subscribers.append(entry)
        rows(self.to_df())
        return lambda: self.subscribers.remove(entry) if entry in self.subscribers else None

    def close(self) -> None:
        for end in self._end:
            end()


def create_query(table: KeyedTable, name: str | None = None) -> Query:
    name = name or f"t{id(table)}"
    return Query(p.Source((), name, True), {name: table})


def standalone_aggregate(z: DataFrame, by: tuple[str, ...] = (), **results) -> DataFrame:
    """Aggregates of a Z-set without a table: the same specifications as :meth:`Grouped.aggregate`."""
    query = Grouped(Query(p.Source((), "z"), {}), by).aggregate(**results)
    return query.plan.eval({"z": weighted(z) if W not in z.columns else z})
