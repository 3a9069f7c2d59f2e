"""Token ids in ORC: sorted by document, run-length encoded, with row indexes and Bloom filters on the document id.

Documents are range-partitioned and sorted by id, encoded, and written by Spark's ORC writer, one file for a range. Each
row also holds its range's number and its offset inside the range, so that a reader of any stripe needs only the sums of
the ranges before its own to know where its ids begin in the whole. These stand in a small table beside the files, one row
for each range, which is written with them. A filter on ``doc_id`` prunes files, stripes and row groups through minima,
maxima and Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import no_cache, shared_folder, small, table, tidy
from .tokens import encoder

SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"
#: Where the sums stand, below the folder of the files: readers of ORC pass over names that begin with an underscore.
SHARDS = "_shards"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of every document, ``end_id`` behind each, in ascending id order to ORC files below ``path``.

    Defined results: a null or empty text is the end id alone; null ids come first; rows of one id stay rows of their own,
    in any order; an empty table gives files without rows; a text of any length is one row; other columns are not read,
    whatever their names.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, shard, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        last = int(end_id).to_bytes(2, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [encode.packed(t or "") + last for t in part.column(1).to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = np.frombuffer(b"".join(ids), "<u2").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                start = at + ends - n
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(start), pa.array(n), lists], names=["doc_id", "shard", "local_start", "n_tokens", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writer = ordered.mapInArrow(tidy(run), SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
    writer = writer.option("orc.create.index", "true").option("orc.row.index.stride", 2000)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


    rows = docs.sparkSession.read.schema(SCHEMA).orc(path)
    ends = rows.groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends.select("shard", before.alias("base")).coalesce(1).write.orc(f"{path}/{SHARDS}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before. Stripes are read in parallel.

    The only rows read besides the stripes are those of the table of sums. Files without rows give an empty table.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    bases = spark.read.schema("shard int, base long").orc(f"{path}/{SHARDS}").select(F.col("shard").alias("s_"), "base")
    joined = rows.join(small(bases), F.col("shard") == F.col("s_"))
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; metadata decides which stripes are opened. Ids that are not there give no row."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def digest(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: the crc32 of the ids as little-endian unsigned 32-bit integers. Row by row."""

    def run(batches):
        no_cache()
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), np.asarray(ids.values).astype("<u4")
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digest(read_tokens(spark, path))
