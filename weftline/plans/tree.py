"""A small lazy tree of relational operators with three readings.

``eval(env)``
    the result over Z-sets; Catalyst plans it.
``delta(env)``
    the changelog of the result over changelogs of the sources, a whole timeline in one job.
``step(old, change)``
    the change of the result for one change of the sources, given their old contents.

Each node knows whether it is linear (its own incremental form), bilinear (product rule) or neither (rule of its own), and
:func:`optimize` drops distincts that change nothing and joins adjacent filters. The rest is left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import T, W, consolidate, empty_like, negate, quoted, record_columns, subtract, union_all, weighted
from ..operators import incremental as inc
from ..operators import relational as r

Env = dict[str, DataFrame]


@dataclass(frozen=True, eq=False)
class Node:
    inputs: tuple[Node, ...] = ()
    linear = bilinear = False

    def apply(self, *zs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply_delta(self, *logs: DataFrame) -> DataFrame:
        """Incremental form over changelogs; that of linear and bilinear operators is the operator itself."""
        return self.apply(*logs)

    def product(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Of a bilinear operator: :meth:`apply` for inputs of which records may stand in several rows."""
        return self.apply(a, b)

    def eval(self, env: Env) -> DataFrame:
        return self.apply(*[x.eval(env) for x in self.inputs])

    def delta(self, env: Env) -> DataFrame:
        return self.apply_delta(*[x.delta(env) for x in self.inputs])

    def step(self, old: Env, change: Env) -> DataFrame:
        """Without state: operators that are not linear evaluate the new and the old contents. See :mod:`.maintain`."""
        if not self.sources() & set(change):
            return empty_like(self.eval(old))
        if self.linear:
            return self.apply(*[x.step(old, change) for x in self.inputs])
        if self.bilinear:
            a, b = self.inputs
            da, db = a.step(old, change), b.step(old, change)
            return union_all(self.product(da, union_all(b.eval(old), db)), self.product(a.eval(old), db))
        new = {k: union_all(v, change[k]) if k in change else v for k, v in old.items()}
        return subtract(self.eval(new), self.eval(old))

    def sources(self) -> set[str]:
        return set().union(*[x.sources() for x in self.inputs])

    @property
    def is_set(self) -> bool:
        """Whether every result has weight 1, given that."""
        return False


@dataclass(frozen=True, eq=False)
class Source(Node):
    name: str = ""
    unique: bool = False
    linear = True

    def eval(self, env):
        return env[self.name]

    delta = eval

    def step(self, old, change):
        return change.get(self.name, old[self.name].limit(0))

    def sources(self):
        return {self.name}

    @property
    def is_set(self):
        return self.unique


@dataclass(frozen=True, eq=False)
class Where(Node):
    condition: Column | str = ""
    linear = True

    def apply(self, z):
        return r.where(z, self.condition)

    @property
    def is_set(self):
        return self.inputs[0].is_set


@dataclass(frozen=True, eq=False)
class Project(Node):
    columns: tuple = ()
    merge: bool = True
    linear = True

    def apply(self, z):
        return r.project(z, *self.columns, merge=self.merge)


@dataclass(frozen=True, eq=False)
class UnionAll(Node):
    linear = True

    def apply(self, a, b):
        return union_all(a, b)


@dataclass(frozen=True, eq=False)
class Negate(Node):
    linear = True

    def apply(self, z):
        return negate(z)


@dataclass(frozen=True, eq=False)
class EquiJoin(Node):
    left_on: tuple[str, ...] = ()
    right_on: tuple[str, ...] = ()
    bilinear = True

    def apply(self, a, b):
        return r.equi_join(a, b, self.left_on, self.right_on or self.left_on, merge=False)

    @property
    def is_set(self):
        return all(x.is_set for x in self.inputs)


@dataclass(frozen=True, eq=False)
class ThetaJoin(Node):
    condition: Column | None = None
    bilinear = True

    def apply(self, a, b):
        return r.cartesian(a, b, merge=False) if self.condition is None else r.theta_join(a, b, self.condition, merge=False)

    @property
    def is_set(self):
        return all(x.is_set for x in self.inputs)


@dataclass(frozen=True, eq=False)
class Intersect(Node):
    bilinear = True

    def apply(self, a, b):
        return r.intersect(a, b)

    def product(self, a, b):
        names = record_columns(a)
        joined = r.equi_join(a, b.select(*quoted([*names, *([T] if T in b.columns else []), W])), names, merge=False)
        return joined.select(*[F.col(f"`l_{c}`").alias(c) for c in names], *([T] if T in joined.columns else []), W)

    @property
    def is_set(self):
        return all(x.is_set for x in self.inputs)


@dataclass(frozen=True, eq=False)
class Distinct(Node):
    def apply(self, z):
        return r.distinct(z)

    def apply_delta(self, log):
        return inc.distinct(log)

    @property
    def is_set(self):
        return True


@dataclass(frozen=True, eq=False)
class Union(Distinct):
    def apply(self, a, b):
        return r.union(a, b)

    def apply_delta(self, a, b):
        return inc.union(a, b)


@dataclass(frozen=True, eq=False)
class Difference(Distinct):
    def apply(self, a, b):
        return r.difference(a, b)

    def apply_delta(self, a, b):
        return inc.difference(a, b)


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    by: tuple[str, ...] = ()
    values: dict = field(default_factory=dict)
    results: dict = field(default_factory=dict)

    def apply(self, z):
        sums = {"count": r.count()} | {k: r.total(v) for k, v in self.values.items()}
        return r.aggregate(z, self.by, **{n: f(sums) for n, f in self.results.items()})

    def apply_delta(self, log):
        return inc.aggregate(log, self.by, self.values, self.results)

    @property
    def is_set(self):
        return True


@dataclass(frozen=True, eq=False)
class TopK(Node):
    order: tuple[Column, ...] = ()
    k: int | None = None
    offset: int = 0

    def apply(self, z):
        return r.top_k(z, self.order, self.k, self.offset)

    def apply_delta(self, log):
        return inc.top_k(log, self.order, self.k, self.offset)

    @property
    def is_set(self):
        return True


def optimize(node: Node) -> Node:
    """Rewrite from the leaves up: distinct of a set is the set; a distinct below another one, under filters, unions or
    joins of positive inputs, is not needed; filters on filters become one."""
    node = replace(node, inputs=tuple(optimize(x) for x in node.inputs)) if node.inputs else node
    if type(node) is Distinct:
        child = node.inputs[0]
        if child.is_set:
            return child
        if isinstance(child, (Where, EquiJoin, ThetaJoin)) and any(type(x) is Distinct for x in child.inputs):
            inner = tuple(x.inputs[0] if type(x) is Distinct and _positive(x.inputs[0]) else x for x in child.inputs)
            return replace(node, inputs=(replace(child, inputs=inner),))
    if type(node) is Union and any(type(x) is Distinct and _positive(x.inputs[0]) for x in node.inputs):
        return replace(node, inputs=tuple(x.inputs[0] if type(x) is Distinct and _positive(x.inputs[0]) else x for x in node.inputs))
    if isinstance(node, Where) and isinstance(node.inputs[0], Where) and isinstance(node.condition, Column) and isinstance(node.inputs[0].condition, Column):
        below = node.inputs[0]
        return replace(below, condition=below.condition & node.condition)
    return node


def _positive(node: Node) -> bool:
    """Weights cannot be negative: set sources, and positive operators over positive inputs."""
    if node.is_set:
        return True
    return isinstance(node, (Where, Project, UnionAll, EquiJoin, ThetaJoin, Intersect)) and all(map(_positive, node.inputs))


def naive_delta(node: Node, env: Env) -> DataFrame:
    """Snapshot differences of ``eval`` time by time: slow, and right by definition."""
    times = sorted({x[0] for log in env.values() for x in log.select(T).distinct().collect()})
    out, before = None, None
    for t in times:
        now = node.eval({k: consolidate(v.where(F.col(T) <= t).drop(T)) for k, v in env.items()})
        change = weighted(now if before is None else subtract(now, before), F.col("__w"), t)
        out, before = change if out is None else union_all(out, change), now
    return consolidate(out)
