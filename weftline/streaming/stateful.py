"""Operators that keep their state between calls: equi-join and top-k over changes. Each call writes its change only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import W, consolidate, negate, quoted, record_columns, union_all
from ..operators import relational as r
from ..plans.maintain import TopKState, Weights, _turns
from ..sources.state import DeltaState, KeyedState, having, new_path


class StatefulEquiJoin:
    """Both inputs so far are kept; a change joins the other side's state, so that only matches of the change are made."""

    def __init__(self, spark: SparkSession, left_on: Sequence[str], right_on: Sequence[str] | None = None, path: str | None = None):
        self.spark, self.left_on, self.right_on = spark, list(left_on), list(right_on or left_on)
        path = path or new_path(spark, "join")
        self.left, self.right, self.view = (DeltaState(spark, f"{path}/{x}") for x in ("left", "right", "view"))

    def _join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return r.equi_join(a, b, self.left_on, self.right_on, merge=False)

    def initialize(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Bulk load into empty state; later calls count as changes."""
        if self.view.latest is not None:
            return self.increment(a, b)
        a, b = self.left.start(consolidate(a)), self.right.start(consolidate(b))
        return self.view.start(consolidate(self._join(a, b)))

    def increment(self, da: DataFrame | None, db: DataFrame | None) -> DataFrame:
        """The change of the join: da x (b + db) + a x db; None stands for no change. What is returned has been committed."""
        if self.view.latest is None:
            raise LookupError("initialize the join first")
        version, terms = self.view.next, []
        if db is not None:
            db = self.right.append(consolidate(db), version)
            terms.append(self._join(self.left.read(version), db))
        if da is not None:
            da = self.left.append(consolidate(da), version)
            terms.append(self._join(da, self.right.read(version + 1)))
        if not terms:
            return self.view.read().limit(0)
        return self.view.append(consolidate(terms[0] if len(terms) == 1 else union_all(*terms)), version)

    def state(self) -> tuple[DataFrame, DataFrame]:
        """Both inputs so far, each record once."""
        return self.left.net(), self.right.net()

    def indexes(self, keys: DataFrame | Sequence | None = None) -> tuple[DataFrame, DataFrame]:
        """Both inputs by key: the records of the given keys (all by default). A list of values of a single key column is
        told to the readers, which then pass over row groups that cannot hold them."""
        out = []
        for state, on in ((self.left, self.left_on), (self.right, self.right_on)):
            rows = state.read()
            if isinstance(keys, DataFrame):
                rows = having(rows, keys.toDF(*on), on)
            elif keys is not None:
                rows = rows.where(F.col(f"`{on[0]}`").isin(list(keys)))
            out.append(consolidate(rows))
        return out[0], out[1]

    def materialized_view(self) -> DataFrame:
        return self.view.net()

    def reset(self) -> None:
        for s in (self.left, self.right, self.view):
            s.reset()


#: The join as a circuit of its own; it has the same calls.
StatefulJoinCircuit = StatefulEquiJoin


def create_stateful_join(spark: SparkSession, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> StatefulJoinCircuit:
    return StatefulJoinCircuit(spark, left_on, right_on)


class StatefulTopK:
    """The records of positive weight so far are kept; a change gives what enters and leaves the window of ranks.

    ``key_cols`` names what identifies a record when that is less than all of its columns. The weights of a key's changes
    add up; a key of no positive weight goes, whatever record its delete names; else the last positive record of a change
    stands for the key (by ``seq`` if that is given, then by the greatest hash).
    """

    def __init__(self, spark: SparkSession, order: Sequence[Column], k: int | None = None, offset: int = 0, key_cols: Sequence[str] = (), path: str | None = None):
        if k is None and offset:
            raise ValueError("an offset needs a limit")
        self.order, self.k, self.key_cols = list(order), k, list(key_cols)
        path = path or new_path(spark, "topk")
        self.top = None if k is None else TopKState(spark, f"{path}/top", order, k, offset)
        self.all = Weights(spark, f"{path}/all") if k is None else None
        self.keyed = KeyedState(spark, self.key_cols, f"{path}/keys") if self.key_cols else None
        self.version = -1 if self._weights.state.latest is None else self._weights.state.latest

    @property
    def _weights(self) -> Weights:
        return self.top.weights if self.all is None else self.all

    def _by_key(self, change: DataFrame, version: int, seq: str | None) -> DataFrame:
        """A change of keys as a change of records: the record that stood for a key leaves, another one comes."""
        names = [c for c in record_columns(change) if c != seq]
        keys = [F.col(f"`{c}`") for c in self.key_cols]
        record = F.struct(*quoted(names))
        place = F.struct(F.col(f"`{seq}`") if seq else F.lit(0), F.xxhash64(*quoted(names)))
        net = consolidate(change).groupBy(*keys).agg(F.sum(W).alias("__d"), F.max_by(F.when(F.col(W) > 0, record), F.when(F.col(W) > 0, place)).alias("__new"))
        if self.keyed.latest is None:
            rows = net.where("__d > 0 AND __new IS NOT NULL").select("__new.*", F.col("__d").alias(W))
            return self.keyed.start(rows, version)
        old = self.keyed.lookup(net.select(*keys), version).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(self.key_cols)], F.struct(*quoted(names)).alias("__old"), F.col(W).alias("__o"))
        on = [F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(self.key_cols)]
        both = net.join(old, on, "left").withColumn("__n", F.coalesce("__o", F.lit(0)) + F.col("__d"))
        both = both.withColumn("__record", F.coalesce("__new", "__old")).where("__record IS NOT NULL")
        rows = self.keyed.append(both.select("__record.*", F.greatest(F.col("__n"), F.lit(0)).alias(W)), version)
        return union_all(rows, negate(self.keyed.lookup(rows.select(*keys), version)))

    def increment(self, change: DataFrame, *, seq: str | None = None) -> DataFrame:
        """Weights are netted over all changes, so that a delete may come before its insert."""
        self.version = version = self.version + 1
        change = self._by_key(change, version, seq) if self.keyed is not None else change
        if self.top is not None:
            return self.top.start(change) if version == 0 else consolidate(self.top.step(change, version))
        if version == 0:
            return r.distinct(self.all.start(change))
        return _turns(self.all.step(change, version)[1])

    initialize = increment

    def current(self) -> DataFrame:
        """The window in order."""
        rows = self.top.current() if self.top is not None else self.all_records()
        return rows.orderBy(*self.order).drop(W)

    def all_records(self) -> DataFrame:
        return self._weights.state.net().where(F.col(W) > 0)

    def stats(self) -> dict[str, int]:
        window = self.top.current() if self.top is not None else self.all_records()
        return {"records": self.all_records().count(), "window": window.count(), "versions": self.version + 1}

    def reset(self) -> None:
        self.top.reset() if self.top is not None else self.all.state.reset()
        if self.keyed is not None:
            self.keyed.reset()
        self.version = -1
