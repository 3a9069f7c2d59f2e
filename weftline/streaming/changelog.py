"""Streams of Z-sets over logical time, as changelogs, and the operators on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import T, W, add, consolidate, empty_like, negate, union_all, weighted
from ..operators import incremental as inc
from ..operators import relational as r
from ..operators.zset import Pair, ZSet

OUTER = "__t0"


@dataclass(frozen=True)
class Stream:
    """A Z-set for each integer time, most of them empty; held as one changelog DataFrame."""

    log: DataFrame

    @staticmethod
    def impulse(z: DataFrame, time: int = 0) -> Stream:
        """The stream that is ``z`` at one time and empty elsewhere."""
        return Stream(weighted(z, F.col(W), time))

    def at(self, time: int) -> DataFrame:
        return consolidate(self.log.where(F.col(T) == time).drop(T))

    def set(self, time: int, z: DataFrame) -> Stream:
        """The stream with another value at ``time``."""
        return Stream(union_all(self.log.where(F.col(T) != time), weighted(z, F.col(W), time)))

    def current_time(self) -> int:
        """The first time behind all that are set."""
        last = self.log.agg(F.max(T)).first()[0]
        return 0 if last is None else last + 1

    def times(self) -> list[int]:
        return [x[0] for x in self.log.select(T).distinct().orderBy(T).collect()]

    def entries(self) -> Iterator[tuple[int, DataFrame]]:
        return ((t, self.at(t)) for t in self.times())

    def lift(self, per_tick: Callable[[DataFrame], DataFrame]) -> Stream:
        """Pointwise: an operator that keeps the times apart is applied to all of them in one job."""
        return Stream(per_tick(self.log))

    def delay(self) -> Stream:
        return Stream(self.log.withColumn(T, F.col(T) + 1))

    def differentiate(self, until: int | None = None) -> Stream:
        """s[t] - s[t-1] at every time, also behind a gap; ``until`` cuts off what lies at or behind that time."""
        out = add(self.log, negate(self.delay().log))
        return Stream(out if until is None else out.where(F.col(T) < until))

    def integrate(self, until: int | None = None) -> Stream:
        """Running sums at every time from 0 to the last (or before ``until``)."""
        end = self.current_time() if until is None else until
        ticks = self.log.sparkSession.range(max(end, 0)).select(F.col("id").alias(T))
        return Stream(inc.snapshots(self.log, ticks))

    def integral(self, time: int | None = None) -> DataFrame:
        """The sum of all times, or of those up to ``time``."""
        return consolidate((self.log if time is None else self.log.where(F.col(T) <= time)).drop(T))

    def incrementalize(self, per_tick: Callable[[DataFrame], DataFrame]) -> Stream:
        """Differentiate after the operator after integrate: right for any operator that works per tick."""
        return Stream(inc.by_snapshots(per_tick, self.log))

    def is_zero_after(self, time: int) -> bool:
        return consolidate(self.log.where(F.col(T) > time)).isEmpty()

    def zero(self) -> Stream:
        return Stream(empty_like(self.log))


@dataclass(frozen=True)
class TupleStream:
    """Two streams as one of pairs: at each time that either has, a Z-set of both."""

    left: Stream
    right: Stream

    def at(self, time: int) -> Pair:
        return Pair(ZSet(self.left.at(time), True), ZSet(self.right.at(time), True))

    def times(self) -> list[int]:
        both = self.left.log.select(T).union(self.right.log.select(T))
        return [x[0] for x in both.distinct().orderBy(T).collect()]

    def entries(self) -> Iterator[tuple[int, Pair]]:
        return ((t, self.at(t)) for t in self.times())


def tuple_stream(left: Stream, right: Stream) -> TupleStream:
    return TupleStream(left, right)


@dataclass(frozen=True)
class Nested:
    """A stream of streams: a changelog with an outer time ``__t0`` beside the inner one."""

    log: DataFrame

    def at(self, outer: int) -> Stream:
        return Stream(self.log.where(F.col(OUTER) == outer).drop(OUTER))

    def times(self) -> list[int]:
        return [x[0] for x in self.log.select(OUTER).distinct().orderBy(OUTER).collect()]

    def set(self, outer: int, stream: Stream) -> Nested:
        return Nested(union_all(self.log.where(F.col(OUTER) != outer), stream.log.withColumn(OUTER, F.lit(outer).cast("long"))))

    def lift(self, operator: Callable[[Stream], Stream]) -> Nested:
        """The operator applied to each inner stream, in one job: the outer time goes along as a column of the record.

        Right for operators that treat records one by one or compare them for equality, as filter, delay, integrate (up to a
        stated end), differentiate and distinct do. Aggregates and top-k take ``__t0`` among their groups, or use
        :meth:`lift_each`.
        """
        return Nested(operator(Stream(self.log)).log)

    def lift_each(self, operator: Callable[[Stream], Stream]) -> Nested:
        """Any operator, applied to one inner stream after the other: a plan for each outer time, of which there are few."""
        found = [operator(self.at(t)).log.withColumn(OUTER, F.lit(t).cast("long")) for t in self.times()]
        return Nested(reduce(union_all, found)) if found else self


@dataclass(frozen=True)
class Circuit:
    """A function from changelogs to a changelog, made of named parts that can be put behind each other."""

    run: Callable[..., DataFrame]
    linear: bool = False
    parts: tuple[str, ...] = ()

    def compose(self, then: Circuit) -> Circuit:
        """The chain rule: the incremental form of a composition is the composition of the incremental forms."""
        return Circuit(lambda *logs: then.run(self.run(*logs)), self.linear and then.linear, self.parts + then.parts)

    def execute(self, *streams: Stream | TupleStream) -> Stream:
        flat = [x for s in streams for x in ((s.left, s.right) if isinstance(s, TupleStream) else (s,))]
        return Stream(self.run(*[s.log for s in flat]))

    @staticmethod
    def where(condition: Column | str) -> Circuit:
        return Circuit(lambda x: r.where(x, condition), True, ("where",))

    @staticmethod
    def project(*columns: Column | str) -> Circuit:
        return Circuit(lambda x: r.project(x, *columns), True, ("project",))

    @staticmethod
    def equi_join(left_on: list[str], right_on: list[str] | None = None) -> Circuit:
        return Circuit(lambda a, b: r.equi_join(a, b, left_on, right_on), parts=("equi_join",))

    @staticmethod
    def theta_join(condition: Column) -> Circuit:
        return Circuit(lambda a, b: r.theta_join(a, b, condition), parts=("theta_join",))

    @staticmethod
    def cartesian() -> Circuit:
        return Circuit(r.cartesian, parts=("cartesian",))

    @staticmethod
    def intersect() -> Circuit:
        """Bilinear like a join on all columns; time must not be among the keys, so both sides stay unconsolidated logs."""

        def run(a, b):
            names = [c for c in a.columns if c not in (T, W)]
            joined = r.equi_join(a, b, names, merge=False)
            return consolidate(joined.select(*[F.col(f"`l_{c}`").alias(c) for c in names], T, W))

        return Circuit(run, parts=("intersect",))

    @staticmethod
    def union() -> Circuit:
        return Circuit(inc.union, parts=("union",))

    @staticmethod
    def difference() -> Circuit:
        return Circuit(inc.difference, parts=("difference",))

    @staticmethod
    def distinct() -> Circuit:
        return Circuit(inc.distinct, parts=("distinct",))

    @staticmethod
    def top_k(order: list[Column], limit: int | None = None, offset: int = 0) -> Circuit:
        return Circuit(lambda x: inc.top_k(x, order, limit, offset), parts=("top_k",))

    order_by = top_k

    @staticmethod
    def per_tick(by: list[str], **columns: Column) -> Circuit:
        """Aggregates of each tick's change for itself."""
        return Circuit(lambda x: r.aggregate(x, by, **columns), parts=("per_tick",))

    @staticmethod
    def aggregate(by: list[str], values: dict, results: dict) -> Circuit:
        """The change of the aggregates of everything so far."""
        return Circuit(lambda x: inc.aggregate(x, by, values, results), parts=("aggregate",))

    @staticmethod
    def naive(per_tick: Callable[..., DataFrame]) -> Circuit:
        """Differentiate after operator after integrate; the definition that all others are tested against."""
        return Circuit(lambda *logs: inc.by_snapshots(per_tick, *logs), parts=("naive",))
