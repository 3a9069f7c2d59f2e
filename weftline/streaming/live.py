"""Views kept live by Structured Streaming.

Spark runs one stateful operator in a stream, without retractions. Queries of more stages run in ``foreachBatch``: each
micro-batch is a change of one source, the kept plan turns it into a change of the result, and all state is committed under
the batch's number, so that a repeated batch finds its version and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import W, consolidate, empty_like, union_all, weighted
from ..plans import tree as p
from ..plans.maintain import Maintained
from ..sources.state import DeltaState


class LiveView:
    """The result of ``plan`` while one of its sources streams; the other sources are Z-sets that stay."""

    def __init__(self, plan: p.Node, stream_name: str, fixed: p.Env, path: str, on_change: Callable[[DataFrame, int], None] | None = None):
        self.plan, self.name, self.fixed, self.on_change, self.path = p.optimize(plan), stream_name, fixed, on_change, path
        self.source: DeltaState | None = None
        self.kept: Maintained | None = None

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of rows with ``__w`` (1 if they have none). Its state has the number of the batch plus one."""
        if self.kept is None:
            self.source, self.kept = DeltaState(batch.sparkSession, f"{self.path}/source"), Maintained(self.plan, batch.sparkSession, f"{self.path}/view")
        version = batch_id + 1
        z = batch if W in batch.columns else weighted(batch)
        if 0 not in self.source.bases.versions:
            self.source.start(empty_like(consolidate(z)))
        contents = lambda name: self.source.read(version) if name == self.name else self.fixed[name]
        first = None
        if not any(v < version for v in self.kept.result.changes.versions):  # the first batch, perhaps repeated
            first = self.kept.start(lambda name: self.source.bases.read(0) if name == self.name else self.fixed[name])
        change = self.kept.step(contents, {self.name: self.source.append(consolidate(z), version)}, version)
        if self.on_change:
            self.on_change(change if first is None else consolidate(union_all(first, change)), batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def to_df(self) -> DataFrame:
        return self.kept.result.net().where(F.col(W) > 0).drop(W)


def stream_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Native inner join of two signed streams: Spark's symmetric hash join keeps both sides, weights multiply.

    NULL keys match. The output is not consolidated: add it up in the sink. Bound the state by watermarks on both sides.
    """
    a, b = left.alias("l"), right.alias("r")
    match = None
    for x, y in zip(left_on, right_on, strict=True):
        one = F.col(f"l.{x}").eqNullSafe(F.col(f"r.{y}"))
        match = one if match is None else match & one
    out = [F.col(f"l.{c}") for c in left.columns if c != W]
    out += [F.col(f"r.{c}").alias(f"r_{c}" if c in left.columns else c) for c in right.columns if c != W]
    return a.join(b, match).select(*out, (F.col(f"l.{W}") * F.col(f"r.{W}")).alias(W))


def stream_aggregate(stream: DataFrame, by: list[str], **values: str) -> DataFrame:
    """Native running sums of a signed stream (update mode emits the new row of each changed group)."""
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0)) * F.col(W)).alias(k) for k, v in values.items()]
    return stream.groupBy(*by).agg(F.sum(W).alias("count"), *sums)
