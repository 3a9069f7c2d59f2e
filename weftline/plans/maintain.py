"""Plans whose results are kept: a change of a source becomes the change of the result, at the cost of the change.

Each node of a plan tree gets an operator that knows its rule. Linear ones hand the change on. Joins match the change of one
side with what the other side holds; a side that has not changed gives no term. Distinct, aggregates and top-k keep what
their rule needs: weights of records, sums of groups, and a window with some rows to spare. They read their state for the
records or groups of the change only, and write what has changed as a commit of its own.

Steps are numbered. State of a step that is there already stays as it is, and old values are read from before the step's
number, so that a repeated step gives the same change again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as types

from ..functions.weights import W, consolidate, negate, quoted, record_columns, union_all, weighted
from ..operators import relational as r
from ..sources.state import DeltaState, KeyedState, StateStore, new_path
from . import tree as p

Contents = Callable[[str], DataFrame]
#: Rows that a window of a top-k has to spare at least, so that few deletes lead beyond it.
SPARE = 64


class Weights:
    """The weight of each record so far, and how a change moves it."""

    def __init__(self, spark: SparkSession, path: str):
        self.state = DeltaState(spark, path)

    def start(self, z: DataFrame) -> DataFrame:
        return self.state.start(consolidate(z))

    def step(self, dz: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """The change, written, and (record, __o, __w): old weight and its change for each record of the change."""
        dz = self.state.append(consolidate(dz), version)
        names = record_columns(dz)
        old = self.state.of(dz.select(*quoted(names)), version)
        both = dz.withColumn("__o", F.lit(0).cast("long")).unionByName(old.withColumnRenamed(W, "__o").withColumn(W, F.lit(0).cast("long")))
        return dz, both.groupBy(*quoted(names)).agg(F.sum("__o").cast("long").alias("__o"), F.sum(W).cast("long").alias(W))


def _turns(moved: DataFrame) -> DataFrame:
    """+1 for records whose weight becomes positive, -1 for those where it stops being so."""
    step = (F.col("__o") + F.col(W) > 0).cast("long") - (F.col("__o") > 0).cast("long")
    return moved.withColumn(W, step).where(F.col(W) != 0).drop("__o")


class Kept:
    """The operator of one node. ``start`` computes its result, ``current`` gives it, ``step`` its change or None."""

    def __init__(self, node: p.Node, inputs: list[Kept], spark: SparkSession, path: str):
        self.node, self.inputs, self.spark, self.path = node, inputs, spark, path

    def start(self, contents: Contents) -> DataFrame:
        return self.node.apply(*[x.start(contents) for x in self.inputs])

    def current(self, contents: Contents, before: int | None) -> DataFrame:
        return self.node.apply(*[x.current(contents, before) for x in self.inputs])

    def step(self, contents: Contents, change: p.Env, version: int) -> DataFrame | None:
        raise NotImplementedError


class KeptSource(Kept):
    def start(self, contents):
        return contents(self.node.name)

    def current(self, contents, before):
        return contents(self.node.name)

    def step(self, contents, change, version):
        return change.get(self.node.name)


class KeptLinear(Kept):
    def step(self, contents, change, version):
        found = [x.step(contents, change, version) for x in self.inputs]
        if len(found) == 1:
            return None if found[0] is None else self.node.apply(found[0])
        some = next((x for x in found if x is not None), None)
        return None if some is None else self.node.apply(*[some.limit(0) if x is None else x for x in found])


class KeptProduct(Kept):
    """da x (b + db) + a x db, without the terms of a side that has not changed."""

    def step(self, contents, change, version):
        a, b = self.inputs
        da, db = a.step(contents, change, version), b.step(contents, change, version)
        terms = []
        if da is not None:
            held = b.current(contents, version)
            terms.append(self.node.product(da, held if db is None else union_all(held, db)))
        if db is not None:
            terms.append(self.node.product(a.current(contents, version), db))
        return reduce(union_all, terms) if terms else None


class KeptState(Kept):
    """What is not linear: the result is kept too, as operators above may need it."""

    def __init__(self, *args):
        super().__init__(*args)
        self.out = DeltaState(self.spark, f"{self.path}/out")

    def combined(self, zs: Sequence[DataFrame | None]) -> DataFrame | None:
        found = [negate(z) if k and isinstance(self.node, p.Difference) else z for k, z in enumerate(zs) if z is not None]
        return reduce(union_all, found) if found else None

    def start(self, contents):
        z = self.begin(self.combined([x.start(contents) for x in self.inputs]))
        return self.out.start(z)

    def current(self, contents, before):
        return self.out.read(before)

    def step(self, contents, change, version):
        zs = [x.step(contents, change, version) for x in self.inputs]
        if all(z is None for z in zs):
            return None
        return self.out.append(consolidate(self.move(self.combined(zs) if len(zs) == 1 or zs[0] is not None else negate(zs[1]) if isinstance(self.node, p.Difference) else zs[1], version)), version)

    def begin(self, z: DataFrame) -> DataFrame:
        raise NotImplementedError

    def move(self, dz: DataFrame, version: int) -> DataFrame:
        raise NotImplementedError


class KeptDistinct(KeptState):
    def __init__(self, *args):
        super().__init__(*args)
        self.weights = Weights(self.spark, f"{self.path}/weights")

    def begin(self, z):
        return r.distinct(self.weights.start(z))

    def move(self, dz, version):
        return _turns(self.weights.step(dz, version)[1])


class KeptAggregate(KeptState):
    """Sums by group. A group exists while a record of it has a weight; for inputs that are sets the count tells."""

    def __init__(self, *args):
        super().__init__(*args)
        node = self.node
        self.by, self.set = list(node.by), node.inputs[0].is_set
        self.sums = {"count": F.col(W)} | {k: F.coalesce(v, F.lit(0)) * F.col(W) for k, v in node.values.items()}
        self.groups = KeyedState(self.spark, self.by or ["__all"], f"{self.path}/groups")
        self.weights = None if self.set else Weights(self.spark, f"{self.path}/weights")

    def _grouped(self, rows: DataFrame, alive: Column) -> DataFrame:
        keys = quoted(self.by) or [F.lit(0).alias("__all")]
        return rows.groupBy(*keys).agg(F.sum(alive).cast("long").alias("__live"), *[F.sum(v).alias(f"__s_{k}") for k, v in self.sums.items()])

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Sums in the types that they are kept in; those of decimals have the most digits there are."""
        kinds = {f.name: f"decimal(38,{f.dataType.scale})" if isinstance(f.dataType, types.DecimalType) else f.dataType.simpleString() for f in rows.schema}
        return rows.select(*[F.col(f"`{c}`").cast(k).alias(c) if c.startswith("__s_") else F.col(f"`{c}`") for c, k in kinds.items()])

    def _rows(self, groups: DataFrame, weight: int) -> DataFrame:
        sums = {k: F.col(f"__s_{k}") for k in self.sums}
        there = groups.where(F.col("__live") != 0) if self.by else groups
        return there.select(*quoted(self.by), *[f(sums).alias(n) for n, f in self.node.results.items()], F.lit(weight).cast("long").alias(W))

    def begin(self, z):
        z = consolidate(z) if self.set else self.weights.start(z)
        groups = self._typed(self._grouped(z, F.lit(1)))
        if not self.by:  # one row even over no records
            groups = groups.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(groups.schema[c].dataType).alias(c) for c in groups.columns if c != "__all"]).withColumn("__all", F.lit(0)).select(*groups.columns)
        return self._rows(self.groups.start(groups.withColumn(W, F.lit(1))), 1)

    def move(self, dz, version):
        if self.set:  # a record's weights add up within its group
            rows, alive = dz, F.col(W)
        else:
            rows = self.weights.step(dz, version)[1]
            alive = (F.col("__o") + F.col(W) != 0).cast("long") - (F.col("__o") != 0).cast("long")
        keys = self.groups.keys
        change = self._grouped(rows, alive)
        old = self.groups.lookup(change.select(*quoted(keys)), version).drop(W)
        new = self._typed(union_all(old, change.select(*old.columns))).groupBy(*quoted(keys)).agg(*[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in keys])
        new = self.groups.append(new.withColumn(W, F.lit(1)), version).drop(W)
        old = self.groups.lookup(new.select(*quoted(keys)), version).drop(W)  # now without the change itself
        return union_all(self._rows(new, 1), self._rows(old, -1))


class TopKState:
    """The records of positive weight in order: a window with rows to spare, and all records to fill it up from."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[Column], k: int, offset: int = 0):
        self.order, self.k, self.offset = list(order), k, offset
        self.held = k + offset + max(SPARE, k + offset)
        self.weights, self.windows = Weights(spark, f"{path}/weights"), StateStore(spark, f"{path}/window")
        self.known: dict[int, tuple[int, bool]] = {}  # of a version: rows, and whether these are all there are

    def _fill(self, version: int) -> DataFrame:
        """The first rows of all records; ``__all`` says whether these are all there are."""
        rows = self.weights.state.net(version + 1).where(F.col(W) > 0).orderBy(*self.order).limit(self.held + 1)
        rows = rows.withColumn("__at", F.row_number().over(Window.orderBy(*self.order)))
        all_ = F.max("__at").over(Window.partitionBy()) <= self.held
        return self.windows.commit(rows.withColumn("__all", all_).where(F.col("__at") <= self.held).drop(W), version)

    def _about(self, version: int) -> tuple[int, bool]:
        if version not in self.known:
            n, all_ = self.windows.read(version).agg(F.count("*"), F.min("__all")).first()
            self.known[version] = n, all_ is not False
        return self.known[version]

    def window(self, rows: DataFrame) -> DataFrame:
        inside = rows.where((F.col("__at") > self.offset) & (F.col("__at") <= self.offset + self.k))
        return weighted(inside.drop("__at", "__all"))

    def start(self, z: DataFrame) -> DataFrame:
        self.weights.start(z)
        return self.window(self._fill(0))

    def current(self) -> DataFrame:
        return self.window(self.windows.read())

    def step(self, dz: DataFrame, version: int) -> DataFrame:
        last_version = max(v for v in self.windows.versions if v < version)
        before = self.windows.read(last_version)
        _, moved = self.weights.step(dz, version)
        turned = _turns(moved)
        if version in self.windows.versions:
            return union_all(self.window(self.windows.read(version)), negate(self.window(before)))
        names = record_columns(turned)
        complete = self._about(last_version)[1]
        coming = turned.where(F.col(W) > 0).drop(W).orderBy(*self.order).limit(self.held)
        going = turned.where(F.col(W) < 0).select(*quoted(names), F.lit(True).alias("__gone"))
        old = before.select(*quoted(names), F.lit(True).alias("__old"))
        rows = union_all(old, coming.withColumn("__old", F.lit(False))).alias("l").join(going.alias("r"), reduce(lambda x, y: x & y, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in names]), "left").select("l.*", F.col("r.__gone"))
        # Behind the last row of the old window others may stand that only the records tell.
        rows = rows.withColumn("__at", F.row_number().over(Window.orderBy(*self.order)))
        rows = rows.withColumn("__last", F.max(F.when(F.col("__old"), F.col("__at"))).over(Window.partitionBy()))
        rows = rows.where(F.col("__gone").isNull() & (F.lit(complete) | (F.col("__at") <= F.col("__last"))))
        rows = rows.withColumn("__at", F.row_number().over(Window.orderBy("__at"))).withColumn("__n", F.max("__at").over(Window.partitionBy()))
        rows = rows.withColumn("__all", F.lit(complete) & (F.col("__n") <= self.held)).where(F.col("__at") <= self.held)
        new = self.windows.commit(rows.select(*quoted(names), "__at", "__all"), version)
        if not complete and self._about(version)[0] < self.k + self.offset:
            self.windows.versions.remove(version)
            del self.known[version]
            new = self._fill(version)
        return union_all(self.window(new), negate(self.window(before)))

    def reset(self) -> None:
        self.weights.state.reset()
        self.windows.reset()
        self.known.clear()


class KeptTopK(KeptState):
    def __init__(self, *args):
        super().__init__(*args)
        self.state = TopKState(self.spark, f"{self.path}/top", self.node.order, self.node.k, self.node.offset)

    def begin(self, z):
        return self.state.start(z)

    def move(self, dz, version):
        return self.state.step(dz, version)


def keep(node: p.Node, spark: SparkSession, path: str) -> Kept:
    """The operators of a plan. A sort without limit is a distinct: its order is that of whoever reads the result."""
    inputs = [keep(x, spark, f"{path}/{k}") for k, x in enumerate(node.inputs)]
    if isinstance(node, p.TopK) and node.k is None and not node.offset:
        kind = KeptDistinct
    elif isinstance(node, p.TopK) and node.k is None:
        raise ValueError("an offset needs a limit")
    else:
        kind = next(k for t, k in ((p.Source, KeptSource), (p.TopK, KeptTopK), (p.Aggregate, KeptAggregate), (p.Distinct, KeptDistinct), (p.Node, KeptProduct if node.bilinear else KeptLinear)) if isinstance(node, t))
    return kind(node, inputs, spark, path)


class Maintained:
    """A plan's result, kept in step with its sources. ``contents`` gives what a source held before the step."""

    def __init__(self, plan: p.Node, spark: SparkSession, path: str | None = None):
        path = path or new_path(spark, "view")
        self.root = keep(plan, spark, f"{path}/plan")
        self.own = None if isinstance(self.root, KeptState) else DeltaState(spark, f"{path}/result")

    @property
    def result(self) -> DeltaState:
        return self.root.out if self.own is None else self.own

    def start(self, contents: Contents) -> DataFrame:
        z = self.root.start(contents)
        return z if self.own is None else self.own.start(consolidate(z))

    def step(self, contents: Contents, change: p.Env, version: int) -> DataFrame | None:
        """The change of the result, consolidated and written; None if nothing that the plan reads has changed."""
        dz = self.root.step(contents, change, version)
        return dz if dz is None or self.own is None else self.own.append(consolidate(dz), version)
