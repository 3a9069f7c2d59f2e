"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document draws an exponential key, ``-ln(u) / quality``; the smallest keys of a source form a sample in which
better documents are likelier. A source whose target exceeds its size is first taken whole as often as it fits
(complete epochs); the remaining words come from the documents with the smallest keys, found through prefix sums. All of
it is DataFrame work: sums by source and key bucket, windows over those sums, and windows over the one bucket of each
source in which its budget runs out, which is split again while it is large, so that no source is ever sorted in one task.
Windows over sources hold one row for each source.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, small, table

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 3
#: Rows of a source that are sorted in one task where its budget ends; more are split by their keys first.
SORTED_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """0.1 to 1: falls with the share of symbols among the characters and for texts under 20 words."""
    clean = F.length(F.translate(text, "#*$%&|<>", "")) / F.greatest(F.lit(1), F.length(text))
    weight = F.greatest(F.lit(0.0), 2 * clean - 1) * F.least(F.lit(1.0), size / 20)
    return F.greatest(F.lit(0.1), F.coalesce(weight, F.lit(0.1)))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality: Column | None) -> DataFrame:
    """``docs`` with ``__size`` and the exponential key ``__key``, which depends on nothing but the row itself."""
    text = F.col(text_col)
    docs = docs.withColumn("__size", word_count(text))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(source_col).cast("string"), text))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * 2.0**-52
    weight = quality_weight(text, F.col("__size")) if quality is None else F.greatest(quality.cast("double"), F.lit(1e-6))
    return docs.withColumn("__key", -F.log(u) / weight)


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """Add ``target`` to a table (source, source_size): the total shared by weight, none above ``max_epochs`` sizes.

    Sorted by size for a unit of weight, the capped sources come first; the level is that of the first source that stays
    below its cap when everything before it is capped. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cap = max_epochs * F.col("source_size")
    n = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("weight", F.element_at(n, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("ratio", cap / F.col("weight"))
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.sum("source_size").over(everything) - before) / after)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return x.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("ratio", "level")


def _crossing(rows: DataFrame, buckets: int, narrow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For rows (source, key, size, left): by source, the first key that no longer fits ``left``, and the sum before it.

    Sums by bucket of keys tell in which bucket a source's budget ends. A bucket with many rows is split again, over the
    range of keys that it really holds, until what is left to sort is few rows or one key.
    """
    over = F.col("base") + F.col("s") > F.col("left")
    sums = [F.sum("size").alias("s"), F.count("*").alias("n"), F.first("left").alias("left"), F.min("key").alias("lo"), F.max("key").alias("hi")]
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    ends = F.min(F.when(over, F.struct("bucket", "base", "n", "lo", "hi"))).alias("c")
    bucket = F.floor((1 - F.exp(-F.col("key"))) * buckets).alias("bucket")
    found = rows.groupBy("source", bucket).agg(*sums).withColumn("base", F.sum("s").over(by_bucket) - F.col("s"))
    found = total = saved(found.groupBy("source").agg(ends, F.sum("s").alias("all")).select("source", "c.base", "c.n", "c.lo", "c.hi", "all"))

    def inside():
        last = found.where("lo IS NOT NULL").select(F.col("source").alias("s_"), F.col("base").alias("from"), F.col("lo").alias("a_"), F.col("hi").alias("b_"))
        return rows.join(narrow(last), F.col("source").eqNullSafe(F.col("s_")) & (F.col("key") >= F.col("a_")) & (F.col("key") <= F.col("b_")))

    while not found.where((F.col("n") > SORTED_ROWS) & (F.col("lo") < F.col("hi"))).isEmpty():
        part = F.when(F.col("b_") > F.col("a_"), F.floor((F.col("key") - F.col("a_")) / (F.col("b_") - F.col("a_")) * buckets)).otherwise(0).alias("bucket")
        finer = inside().groupBy("source", part).agg(*sums, F.first("from").alias("from"))
        finer = finer.withColumn("base", F.col("from") + F.sum("s").over(by_bucket) - F.col("s"))
        found = saved(finer.groupBy("source").agg(ends).select("source", "c.base", "c.n", "c.lo", "c.hi"))
    one = inside().groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("left").alias("left"), F.first("from").alias("base"))
    end = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    first = one.withColumn("end", end).where("end > left").groupBy("source").agg(F.min(F.struct("key", "size", "end")).alias("f"))
    first = first.select(F.col("source").alias("s_"), "f")
    return total.join(first, F.col("source").eqNullSafe(F.col("s_")), "left").select(
        "source",
        F.coalesce("f.key", F.lit(math.inf)).alias("next_key"),
        F.coalesce("f.size", F.lit(0)).alias("next_size"),
        F.coalesce(F.col("f.end") - F.col("f.size"), F.col("all")).alias("used"),
    )


def plan_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, quality: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, plan). The plan has for each source its size, target, complete epochs and the bounds of its sample.

    After a first pass in key order a budget is left that the next document exceeds; two more passes look behind that
    document for ones that fit, and at the end one of the documents at the three bounds is taken if that comes nearer.
    """
    rows = keyed(docs, id_col, text_col, source_col, seed, quality)
    rows = saved(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size")) + 1e-9))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("int"))
    plan = saved(plan.withColumn("left0", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))))
    buckets = math.isqrt(rows.count()) + 1
    narrow = F.broadcast if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x  # one row for each source
    for k in range(ROUNDS):
        bound = plan.select(F.col("source").alias("s_"), F.col(f"left{k}").alias("left"), *([F.col(f"next{k}").alias("after")] if k else []))
        found = rows.where("size > 0").join(narrow(bound), F.col("source").eqNullSafe(F.col("s_")))
        if k:
            found = found.where((F.col("key") > F.col("after")) & (F.col("size") <= F.col("left")))
        found = _crossing(found.select("source", "key", "size", "left"), buckets, narrow)
        found = found.select(F.col("source").alias("s_"), "next_key", "next_size", "used")
        step = plan.join(found, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
        plan = step.withColumn(f"left{k + 1}", F.col(f"left{k}") - F.coalesce("used", F.lit(0)))
        plan = plan.withColumn(f"next{k + 1}", F.coalesce("next_key", F.lit(math.inf)))
        plan = plan.withColumn(f"size{k + 1}", F.coalesce("next_size", F.lit(0)))
        plan = saved(plan.drop("next_key", "next_size", "used"))
    left = F.col(f"left{ROUNDS}")
    bounds = [F.when((F.col(f"size{k}") > 0) & (F.col(f"size{k}") < 2 * left), F.struct(F.abs(F.col(f"size{k}") - left).alias("off"), F.col(f"next{k}").alias("key"))) for k in range(1, ROUNDS + 1)]
    return rows, plan.withColumn("nearest", F.array_min(F.array(*bounds))["key"])


def _copies() -> Column:
    """How often a row is taken, given its ``size`` and ``key`` beside the plan of its source."""
    chosen, key, size = F.col("key") < F.col("next1"), F.col("key"), F.col("size")
    for k in range(1, ROUNDS):
        chosen |= (key > F.col(f"next{k}")) & (size <= F.col(f"left{k}")) & (key < F.col(f"next{k + 1}"))
    chosen |= F.coalesce(key == F.col("nearest"), F.lit(False))
    return F.col("epochs") + F.when(chosen & (F.col("left0") > 0), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Defined results: a null source is a source of its own and comes last; null or empty texts have size 0, take no part
    in the budgets and are kept once in each complete epoch; rows that agree in id, source and text share a key and are
    taken together; an empty table gives an empty table. Columns of any other name are carried along; only names that
    begin with two underscores are reserved.
    """
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    _, plan = plan_mix(docs, **options)
    rows = keyed(docs, *names.values(), options.get("seed", 17), options.get("quality"))
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(names["source_col"]).alias("__source"), F.col("__size").alias("size"), F.col("__key").alias("key"))
    taken = own.join(small(plan), F.col("__source").eqNullSafe(F.col("source"))).withColumn("__n", _copies())
    return taken.where("__n > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))).alias("__copy")).select("__row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """For each row: id, size, source_size, target, copies and the words that the mix takes of it.

    Defined results: those of :func:`mix`; ids may be null or repeated, and each row is told for itself; texts of any length
    are counted whole; an empty table gives an empty table; other columns are not read.
    """
    rows, plan = plan_mix(docs, **options)
    plan = plan.withColumnRenamed("source", "s_")
    out = rows.join(small(plan), F.col("source").eqNullSafe(F.col("s_"))).withColumn("copies", _copies())
    return out.select("id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_report(docs).withColumnRenamed("id", "doc_id").drop("copies")
