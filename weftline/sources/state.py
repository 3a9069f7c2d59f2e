"""State in shared storage: versions of a DataFrame, Z-sets as a base with the changes since, and rows by key.

Whatever a commit has written stays until :meth:`StateStore.vacuum` is called, as DataFrames over it may be in use; a version
exists once Spark has marked its folder done, and a repeated commit of a version changes nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as types

from ..functions.weights import W, consolidate, quoted, record_columns, union_all

#: Changes after which a base is written anew; values of a key that are told to readers as a list.
COMPACT, FEW = 16, 1000
V = "__v"


def state_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the cluster names; only in one process (tests) a folder of our own if it is unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, kind: str = "state") -> str:
    return f"{state_root(spark)}/{kind}-{uuid.uuid4().hex}"


def same(names: Sequence[str], left: str = "l", right: str = "r"):
    """Equal in all the columns, NULL equal to NULL."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in names], F.lit(True))


def having(df: DataFrame, keys: DataFrame, names: Sequence[str], *, without: bool = False) -> DataFrame:
    """Rows of ``df`` whose columns ``names`` occur in ``keys`` (or do not). Few keys are broadcast by their size on disk."""
    return df.alias("l").join(keys.alias("r"), same(names), "left_anti" if without else "left_semi")


def told(keys: DataFrame, column: str) -> Column:
    """A condition that readers can use to pass over row groups: the values of ``column`` in ``keys``, if they are few."""
    found = {r[0] for r in keys.select(F.col(f"`{column}`")).limit(FEW + 1).collect()}
    return F.lit(True) if len(found) > FEW or None in found else F.col(f"`{column}`").isin(list(found))


class StateStore:
    """Versions of a DataFrame under one folder. Reading a version never sees files of an unfinished one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark)
        self.schema: types.StructType | None = None
        self.versions = self._found()

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _found(self) -> list[int]:
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in done)

    @property
    def latest(self) -> int | None:
        return self.versions[-1] if self.versions else None

    def commit(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """Write ``df`` as a version (the next one by default) and return its reader. A version that is there stays as it
        is, so that a repeated commit of a batch changes nothing."""
        version = (self.latest + 1 if self.versions else 0) if version is None else version
        if version not in self.versions:
            schema = types.StructType([types.StructField(f.name, f.dataType) for f in df.schema])
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
            self.versions = sorted([*self.versions, version])
            self.schema = schema
        return self.read(version)

    def read(self, *versions: int) -> DataFrame:
        """The given versions together, by default the last one."""
        if not (versions := versions or tuple(self.versions[-1:])):
            raise LookupError("nothing has been committed")
        paths = [f"{self.path}/v{v}" for v in versions]
        if self.schema is None:
            self.schema = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(self.schema).parquet(*paths)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions. DataFrames over the others can no longer be read."""
        for old in self.versions[:-keep] if keep else list(self.versions):
            fs, path = self._fs(f"{self.path}/v{old}")
            fs.delete(path, True)
            self.versions.remove(old)

    def reset(self) -> None:
        fs, root = self._fs(self.path)
        fs.delete(root, True)
        self.versions, self.schema = [], None


class DeltaState:
    """A Z-set as a base and the changes since, so that a commit writes its change and nothing else.

    Every :data:`COMPACT` changes a new base is written beside the old one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark)
        self.bases, self.changes = StateStore(spark, f"{self.path}/base"), StateStore(spark, f"{self.path}/changes")

    @property
    def latest(self) -> int | None:
        found = [x.latest for x in (self.bases, self.changes) if x.versions]
        return max(found) if found else None

    @property
    def next(self) -> int:
        return 0 if self.latest is None else self.latest + 1

    def start(self, z: DataFrame, version: int = 0) -> DataFrame:
        """The first contents, which must be consolidated."""
        return self.bases.commit(z, version)

    def append(self, change: DataFrame, version: int | None = None) -> DataFrame:
        """Commit a consolidated change; what is returned reads the files of this change only."""
        version = self.next if version is None else version
        out = self.changes.commit(change, version)
        if len(self._changes(None)) >= COMPACT:
            self.bases.commit(self.net(), version)
        return out

    def _base(self, before: int | None) -> int | None:
        return max((v for v in self.bases.versions if before is None or v < before), default=None)

    def _changes(self, before: int | None) -> list[int]:
        base = self._base(before)
        return [v for v in self.changes.versions if (base is None or v > base) and (before is None or v < before)]

    def _parts(self, before: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        base, changes = self._base(before), self._changes(before)
        return None if base is None else self.bases.read(base), self.changes.read(*changes) if changes else None

    def read(self, before: int | None = None) -> DataFrame:
        """The contents (those before a version) as a bag: enough for operators that are linear in it. No shuffle."""
        found = [x for x in self._parts(before) if x is not None]
        if not found:
            raise LookupError("nothing has been committed")
        return reduce(union_all, found)

    def net(self, before: int | None = None) -> DataFrame:
        """The contents, each record once. Only records that a change has touched are brought together."""
        base, changes = self._parts(before)
        if base is None or changes is None:
            return self.read(before) if changes is None else consolidate(changes)
        names = record_columns(base)
        touched = changes.select(*quoted(names)).distinct()
        moved = consolidate(union_all(having(base, touched, names), changes))
        return union_all(having(base, touched, names, without=True), moved)

    def of(self, records: DataFrame, before: int | None = None) -> DataFrame:
        """The weights of the given records, as a Z-set; the state is read but not shuffled, and for few records only where
        row groups can hold them."""
        rows = self.read(before)
        names = record_columns(rows)
        return consolidate(having(rows.where(told(records, names[0])), records, names))

    def vacuum(self) -> None:
        """Keep the last base and the changes since."""
        self.bases.vacuum(1)
        gone = [v for v in self.changes.versions if self.bases.versions and v <= self.bases.latest]
        if gone:
            self.changes.vacuum(len(self.changes.versions) - len(gone))

    def reset(self) -> None:
        self.bases.reset()
        self.changes.reset()


class KeyedState:
    """Rows by key, of which the last version counts; within a version the greatest ``__w``. A row of ``__w`` <= 0 ends its key."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], path: str | None = None):
        self.spark, self.keys, self.path = spark, list(keys), path or new_path(spark)
        self.bases, self.changes = StateStore(spark, f"{self.path}/base"), StateStore(spark, f"{self.path}/changes")

    _base, _changes, latest, next, vacuum, reset = (getattr(DeltaState, n) for n in ("_base", "_changes", "latest", "next", "vacuum", "reset"))

    def start(self, rows: DataFrame, version: int = 0) -> DataFrame:
        """The first rows, one for each key, with ``__w``."""
        return self.bases.commit(rows, version)

    def append(self, rows: DataFrame, version: int | None = None, *, compact: bool = True) -> DataFrame:
        """Commit rows of some keys; what is returned reads the files of this change only."""
        version = self.next if version is None else version
        out = self.changes.commit(rows.withColumn(V, F.lit(version)), version).drop(V)
        if compact and len(self._changes(None)) >= COMPACT:
            self.bases.commit(self.read(), version)
        return out

    def _last(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != V]
        best = F.max_by(F.struct(*quoted(names)), F.struct(V, W)).alias("r")
        return rows.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)]).agg(best).select("r.*")

    def read(self, before: int | None = None) -> DataFrame:
        """The rows that hold. Keys that no change has touched are read as they stand."""
        base, changes = self._base(before), self._changes(before)
        if base is None and not changes:
            raise LookupError("nothing has been committed")
        if not changes:
            return self.bases.read(base).where(F.col(W) > 0)
        log = self.changes.read(*changes)
        last = self._last(log).where(F.col(W) > 0)
        if base is None:
            return last
        kept = having(self.bases.read(base), log.select(*quoted(self.keys)).distinct(), self.keys, without=True)
        return union_all(kept.where(F.col(W) > 0), last)

    def lookup(self, keys: DataFrame, before: int | None = None, *, values: Sequence | None = None) -> DataFrame:
        """The rows that hold of some keys. Readers pass over row groups that cannot hold few of them; ``values`` is the list
        of all values of the first key column, if the caller has it."""
        base, changes = self._base(before), self._changes(before)
        few = told(keys, self.keys[0]) if values is None else F.col(f"`{self.keys[0]}`").isin(list(values))
        found = []
        if base is not None:
            found.append(having(self.bases.read(base).where(few), keys, self.keys).withColumn(V, F.lit(base)))
        if changes:
            found.append(having(self.changes.read(*changes).where(few), keys, self.keys))
        if not found:
            raise LookupError("nothing has been committed")
        rows = reduce(union_all, found)
        return (self._last(rows) if changes else rows.drop(V)).where(F.col(W) > 0)
