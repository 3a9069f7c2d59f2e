"""Keyed tables: rows with a unique id, changed by calls or by deltas, which tell subscribers what has changed.

Every operation is set-oriented: it takes a DataFrame of rows or ids, or a list for few. It looks up the rows that the ids
in question have now, commits the difference as a change of its own, and publishes it as a consolidated Z-set. The table
itself is read for those ids only (for few ids readers pass over row groups that cannot hold them) and is written anew only
now and then. Deltas are canonical: the difference of two states, whatever rows the caller passed.

An id is never NULL, and of rows with the same id one counts: the last of a list, the last in ``seq`` of a DataFrame, and
without ``seq`` the one of the greatest hash, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from ..functions.weights import W, consolidate, negate, quoted, union_all, weighted
from .state import FEW, KeyedState, StateStore, having, new_path

Delta = Callable[[DataFrame], None]
SEQ, OP = "__seq", "__op"


def last_by_id(rows: DataFrame, id_col: str, order: str | None = None) -> DataFrame:
    """Of the rows of each id, the last in ``order``, then that of the greatest hash. One partial maximum; no sort."""
    names = [c for c in rows.columns if c != order]
    place = [*([F.col(f"`{order}`")] if order else []), F.xxhash64(*quoted(names))]
    best = F.max_by(F.struct(*quoted(names)), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(place)])).alias("r")
    return rows.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(best).select("r.*")


class KeyedTable:
    """A table with an id column. ``seq`` names a column that orders rows of one id on creation (the last one stays)."""

    def __init__(self, df: DataFrame, id_col: str, *, seq: str | None = None, path: str | None = None):
        self.spark: SparkSession = df.sparkSession
        self.id_col, self.subscribers, self.errors = id_col, [], []
        path = path or new_path(self.spark, "table")
        self.state, self.staged = KeyedState(self.spark, [id_col], f"{path}/rows"), StateStore(self.spark, f"{path}/staged")
        self.state.start(weighted(last_by_id(df, id_col, seq)))
        self.schema = types.StructType([f for f in self.state.bases.schema if f.name != W])
        if not self.state.bases.read(0).where(F.col(f"`{id_col}`").isNull()).isEmpty():
            raise ValueError(f"an id is NULL: {id_col}")

    @property
    def df(self) -> DataFrame:
        return self.state.read().drop(W)

    def subscribe(self, callback: Delta) -> Callable[[], None]:
        """Call back with each delta, in order of subscription; the returned function ends that."""
        self.subscribers.append(callback)
        return lambda: self.subscribers.remove(callback) if callback in self.subscribers else None

    def to_df(self) -> DataFrame:
        return self.df

    def to_zset(self) -> DataFrame:
        return self.state.read()

    def get(self, key) -> Row | None:
        return None if key is None else self._now(self._listed([key]), [key]).drop(W).first()

    def has(self, key) -> bool:
        return self.get(key) is not None

    def size(self) -> int:
        return self.df.count()

    def _listed(self, ids: Sequence) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], types.StructType([self.schema[self.id_col]]))

    def _given(self, rows: DataFrame | Iterable[dict], columns: Sequence[str], seq: str | None = None) -> tuple[DataFrame, list | None, int]:
        """Rows as a table that is read more than once, their ids if they are few, and how many rows repeat an id.

        Of a list the last row of an id counts; a DataFrame is written once, so that its source is read once.
        """
        fields = types.StructType([self.schema[c] for c in columns])
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            last = {x[self.id_col]: tuple(x[c] for c in columns) for x in rows}
            if None in last:
                raise ValueError(f"an id is NULL: {self.id_col}")
            return self.spark.createDataFrame(list(last.values()), fields), list(last) if len(last) <= FEW else None, len(rows) - len(last)
        staged = self.staged.commit(rows.select(*quoted(list(dict.fromkeys([*columns, *([seq] if seq else [])])))))
        key = F.col(f"`{self.id_col}`")
        n, ids, nulls = staged.agg(F.count("*"), F.count_distinct(key), F.count_if(key.isNull())).first()
        if nulls:
            raise ValueError(f"an id is NULL: {self.id_col}")
        few = [r[0] for r in staged.select(key).distinct().collect()] if ids <= FEW else None
        return (last_by_id(staged, self.id_col, seq) if n > ids or seq else staged).select(*quoted(list(columns))), few, n - ids

    def _now(self, ids: DataFrame, few: list | None) -> DataFrame:
        """The rows that these ids have, with weight 1."""
        return self.state.lookup(ids.select(F.col(f"`{self.id_col}`")), values=few)

    def _change(self, new: DataFrame | None, old: DataFrame) -> DataFrame:
        """Commit and publish what leaves and what comes."""
        parts = negate(old) if new is None else union_all(weighted(new), negate(old))
        delta = self.state.append(consolidate(parts.select(*quoted([*self.schema.names, W]))))
        self.staged.vacuum(0)
        self._publish(delta)
        return delta

    def _publish(self, delta: DataFrame) -> None:
        """All subscribers are told, whatever one of them raises; errors are kept and the first is raised at the end."""
        failed = []
        for callback in list(self.subscribers):
            try:
                callback(delta)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
        self.errors += failed
        if failed:
            raise failed[0]

    def add(self, rows: DataFrame | Iterable[dict]) -> DataFrame:
        """Insert rows; an id that is there, or comes twice, is an error and nothing changes."""
        rows, few, repeated = self._given(rows, self.schema.names)
        now = self._now(rows, few)
        if repeated or not now.isEmpty():
            raise KeyError(f"an id is already in the table: {self.id_col}")
        return self._change(rows, now)

    def update(self, changes: DataFrame | Iterable[dict], *, seq: str | None = None) -> DataFrame:
        """Set the given columns of existing rows (NULL is a value too); a missing id is an error, ids never change.

        Several changes of one id in a list take effect one after the other.
        """
        if isinstance(changes, DataFrame):
            names = [c for c in self.schema.names if c in changes.columns and c != seq]
        else:
            folded: dict = {}
            for x in changes:
                folded[x[self.id_col]] = folded.get(x[self.id_col], {}) | x
            kinds = {tuple(sorted(x)) for x in folded.values()}
            if len(kinds) > 1:  # rows that set different columns are filled up from the table
                now = {r[self.id_col]: r.asDict() for r in self._now(self._listed(list(folded)), list(folded)[:FEW] if len(folded) <= FEW else None).drop(W).collect()}
                folded = {k: now.get(k, dict.fromkeys(self.schema.names)) | x for k, x in folded.items()}
            changes = list(folded.values())
            names = [c for c in self.schema.names if c in changes[0]] if changes else [self.id_col]
        changes, few, _ = self._given(changes, names, seq)
        now = self._now(changes, few)
        if not having(changes, now, [self.id_col], without=True).isEmpty():
            raise KeyError(f"an id is not in the table: {self.id_col}")
        pair = now.alias("l").join(changes.alias("r"), F.col(f"l.`{self.id_col}`") == F.col(f"r.`{self.id_col}`"))
        return self._change(pair.select(*[F.col(f"{'r' if c in names else 'l'}.`{c}`") for c in self.schema.names]), now)

    def remove(self, ids: DataFrame | Sequence) -> DataFrame:
        """Delete rows by id; ids that are not there, NULL among them, do nothing. The delta is empty if none was."""
        if not isinstance(ids, DataFrame):
            ids = [x for x in dict.fromkeys(ids) if x is not None]
            return self._change(None, self._now(self._listed(ids), ids if len(ids) <= FEW else None))
        ids = self.staged.commit(ids.select(F.col(f"`{self.id_col}`")).distinct())
        few = [r[0] for r in ids.limit(FEW + 1).collect()]
        return self._change(None, self._now(ids, few if len(few) <= FEW else None))

    safe_remove = remove

    def upsert(self, rows: DataFrame | Iterable[dict], *, seq: str | None = None) -> DataFrame:
        """Insert rows or replace those of the same id. Rows that stay the same leave no delta."""
        rows, few, _ = self._given(rows, self.schema.names, seq)
        return self._change(rows, self._now(rows, few))

    def apply_delta(self, delta: DataFrame, *, seq: str | None = None) -> DataFrame:
        """Apply a Z-set: after netting, positive rows replace their id, an id with negative rows only goes."""
        net = consolidate(delta.select(*quoted([*self.schema.names, *([seq] if seq else []), W])))
        op = F.when(F.col(W) > 0, "upsert").otherwise("remove").alias(OP)
        order = F.struct(F.col(W) > 0, F.col(seq) if seq else F.lit(0)).alias(SEQ)
        return self.batch(net.select(*quoted(self.schema.names), op, order))

    def clear(self) -> DataFrame:
        return self._change(None, self.state.read())

    def batch(self, operations: DataFrame) -> DataFrame:
        """Apply ordered operations with one commit and one delta.

        ``operations`` has the table's columns, ``__op`` ('upsert', 'remove' or 'delta'), ``__seq`` and, for deltas, ``__w``:
        a positive row of a delta replaces its id, a negative one removes it, one of weight 0 does nothing. Of each id the
        last operation counts; rows of one delta share their ``__seq``, and among them positive ones come last.
        """
        rows = operations
        if W in operations.columns:
            delta = F.col(OP) == "delta"
            rows = operations.where(~delta | (F.coalesce(F.col(W), F.lit(0)) != 0))
            order = F.struct(F.col(SEQ), F.coalesce(delta & (F.col(W) > 0), F.lit(False)))
            rows = rows.withColumn(SEQ, order).withColumn(OP, F.when(delta, F.when(F.col(W) > 0, "upsert").otherwise("remove")).otherwise(F.col(OP)))
        rows = rows.select(*quoted([*self.schema.names, OP, SEQ]))
        if not rows.where(F.col(f"`{self.id_col}`").isNull()).isEmpty():
            raise ValueError(f"an id is NULL: {self.id_col}")
        last = self.staged.commit(last_by_id(rows, self.id_col, SEQ))
        return self._change(last.where(F.col(OP) == "upsert").select(*quoted(self.schema.names)), self._now(last, None))
