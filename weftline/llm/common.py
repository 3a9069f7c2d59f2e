"""Helpers shared by the training-data operators: tables, shared storage and stable hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A saved table of at most this many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only in one process, where nothing is to be shared, a folder of our own is set if none is named.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def saved(df: DataFrame, *, kind: str = "parquet") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and return a reader of those files.

    Lost executors do not matter afterwards, as the files live in shared storage.
    """
    spark, schema, path = df.sparkSession, df.schema, shared_folder(df.sparkSession)
    df.write.format(kind).option("compression", "zstd").save(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema])).format(kind).load(path)
    out._saved_in = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of saved tables that nothing will read again: all that was made from them is saved itself."""
    for df in frames:
        if path := df.__dict__.pop("_saved_in", None):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame) -> DataFrame:
    """Mark a saved table for broadcast if its counted rows stay below :data:`BROADCAST_ROWS`; else leave it as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def held_out(id_col: str = "doc_id"):
    """True where a label must not be learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


_OWNER: list = []


def own_cache(clear) -> None:
    """Python workers outlive a stage: the operator that now fills its cache has the one before it emptied."""
    if _OWNER and _OWNER[0] is not clear:
        _OWNER[0]()
    _OWNER[:] = [clear]


def no_cache() -> None:
    """An operator without a cache begins: that of the one before it goes."""
    own_cache(_nothing)


def _nothing() -> None:
    pass


def trim() -> None:
    """Give memory that a task has freed back to the system, as workers wait for their next task with all they hold."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def tidy(run):
    """A function from batches to batches after which :func:`trim` is called."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty. ``bytes.split()`` cuts at exactly the white space ``[\\x20\\x09-\\x0D]``."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, some at a time: together ``limit`` bytes or one longer text."""
    held, size = [], 0
    for k in range(0, len(column), 64):
        for text in as_bytes(column.slice(k, 64)):
            if held and size + len(text) > limit:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
    if held:
        yield held
