"""Queries over the test tables, one or more for each operator, each with SQL that a plain engine runs on the same tables.

Weights and times are made from keys: orders hold with weight -1, 1, 2 or 3 and change at one of ten times. The SQL of
incremental queries is written as the difference of two snapshots, not as the rule that the engine uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import weights as w
from .functions.weights import T, W
from .operators import incremental as inc
from .operators import relational as r
from .operators.zset import Pair, ZSet
from .plans import tree as p
from .plans.query import create_query, standalone_aggregate
from .sources.state import StateStore
from .sources.table import KeyedTable
from .streaming.changelog import OUTER, Circuit, Nested, Stream, tuple_stream
from .streaming.recursion import transitive_closure
from .streaming.stateful import StatefulEquiJoin, StatefulTopK, create_stateful_join

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

WEIGHT = "CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 + o_orderkey % 3 END"
TIME = "o_orderkey % 10"
PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark, sf, *columns: str) -> DataFrame:
    """Orders as a Z-set over the given columns."""
    df = table(spark, sf, "orders").withColumn("price", F.expr(PRICE))
    return df.select(*columns, F.expr(WEIGHT).cast("long").alias(W))


def log(spark, sf, *columns: str) -> DataFrame:
    """Orders as a changelog."""
    df = table(spark, sf, "orders").withColumn("price", F.expr(PRICE))
    return df.select(*columns, F.expr(TIME).cast("long").alias(T), F.expr(WEIGHT).cast("long").alias(W))


def customers(spark, sf, *columns: str) -> DataFrame:
    """Customers as a changelog: weight 1 or 2, at one of ten times."""
    df = table(spark, sf, "customer")
    return df.select(*columns, (F.col("c_custkey") % 10).cast("long").alias(T), (1 + F.col("c_custkey") % 2).cast("long").alias(W))


def out(df: DataFrame) -> DataFrame:
    names = {W: "w", T: "t"}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


O = f"(SELECT *, CAST({WEIGHT} AS BIGINT) AS w, CAST({TIME} AS BIGINT) AS t, {PRICE} AS price FROM orders)"  # noqa: E741
C = "(SELECT *, CAST(1 + c_custkey % 2 AS BIGINT) AS w, CAST(c_custkey % 10 AS BIGINT) AS t FROM customer)"
OTHER = "CASE WHEN o_orderkey % 4 = 0 THEN -2 ELSE o_orderkey % 4 END"
#: Two operands over all orders, which differ in their weights.
LOW, HIGH = O, f"(SELECT * EXCLUDE (w), CAST({OTHER} AS BIGINT) AS w FROM {O})"


def merged(columns: str, source: str, weight: str = "w", where: str = "TRUE") -> str:
    names = ", ".join(str(k + 1) for k in range(len(columns.split(","))))
    return f"SELECT {columns}, CAST(SUM({weight}) AS BIGINT) AS w FROM {source} WHERE {where} GROUP BY {names} HAVING SUM({weight}) <> 0"


def by_snapshots(columns: str, snapshot: str) -> str:
    """SQL of a timeline: ``snapshot`` selects ``columns`` and w at the time ``x.t``; the change is now minus before."""
    names = ", ".join(columns.split(", "))
    return (
        f"WITH ticks AS (SELECT CAST(range AS BIGINT) AS t FROM range(0, 11)), snaps AS (SELECT x.t AS t, s.* FROM ticks x, LATERAL ({snapshot}) s), "
        f"moves AS (SELECT {names}, t, w FROM snaps UNION ALL SELECT {names}, t + 1 AS t, -w AS w FROM snaps WHERE t < 10) "
        f"SELECT {names}, t, CAST(SUM(w) AS BIGINT) AS w FROM moves GROUP BY {names}, t HAVING SUM(w) <> 0"
    )


# --- Z-set algebra ---------------------------------------------------------------------------------------------------

KEYS = ("o_custkey", "o_orderpriority")


def halves(s, d):
    return orders(s, d, *KEYS), orders(s, d, *KEYS, "o_orderkey").withColumn(W, F.expr(OTHER).cast("long")).drop("o_orderkey")


@query("zset_consolidate", merged("o_custkey, o_orderpriority", O))
def _(s, d):
    return out(ZSet(orders(s, d, *KEYS)).merge().data)


@query("zset_add", merged("o_custkey, o_orderpriority", f"(SELECT o_custkey, o_orderpriority, w FROM {LOW} UNION ALL SELECT o_custkey, o_orderpriority, w FROM {HIGH})"))
def _(s, d):
    a, b = halves(s, d)
    return out((ZSet(a) + ZSet(b)).df)


@query("zset_subtract", merged("o_custkey, o_orderpriority", f"(SELECT o_custkey, o_orderpriority, w FROM {LOW} UNION ALL SELECT o_custkey, o_orderpriority, -w FROM {HIGH})"))
def _(s, d):
    a, b = halves(s, d)
    return out((ZSet(a) - ZSet(b)).df)


@query("zset_negate", merged("o_custkey, o_orderpriority", O, "-w"))
def _(s, d):
    return out((-ZSet(orders(s, d, *KEYS))).merge().df)


@query("zset_multiply", merged("o_custkey, o_orderpriority", O, "w * -3"))
def _(s, d):
    return out(ZSet(orders(s, d, *KEYS)).multiply(-3).merge().df)


@query("zset_concat", f"SELECT o_custkey, o_orderpriority, w FROM {LOW} UNION ALL SELECT o_custkey, o_orderpriority, w FROM {HIGH}")
def _(s, d):
    a, b = halves(s, d)
    return out(ZSet(a).append(b).df)


@query("zset_zero", "SELECT o_custkey, o_orderpriority, CAST(1 AS BIGINT) AS w FROM orders WHERE FALSE")
def _(s, d):
    z = ZSet(orders(s, d, *KEYS))
    return out((z - z).df)


@query("zset_zero_element", merged("o_custkey, o_orderpriority", O))
def _(s, d):
    z = ZSet(orders(s, d, *KEYS))
    return out((z + z.zero()).df)


@query("zset_is_merged", "SELECT FALSE AS as_given, TRUE AS after_merge, TRUE AS after_add, FALSE AS after_append")
def _(s, d):
    z = ZSet(orders(s, d, "o_custkey"))
    return s.createDataFrame([(z.merged, z.merge().merged, (z + z).merged, z.append(z.df).merged)], "as_given boolean, after_merge boolean, after_add boolean, after_append boolean")


@query("zset_predicates", f"SELECT (SELECT bool_and(w = 1) FROM ({merged('o_orderkey', O)})) AS is_set, (SELECT bool_and(w >= 0) FROM ({merged('o_orderkey', O)})) AS is_positive, (SELECT count(*) = 0 FROM ({merged('o_orderkey', O)})) AS is_empty")
def _(s, d):
    z = ZSet(orders(s, d, "o_orderkey"))
    return s.createDataFrame([(z.is_set(), z.is_positive(), z.is_empty())], "is_set boolean, is_positive boolean, is_empty boolean")


@query("zset_pair_group", merged("side, o_custkey", f"(SELECT 'l' AS side, o_custkey, w FROM {LOW} UNION ALL SELECT 'l', o_custkey, -w FROM {HIGH} UNION ALL SELECT 'r', o_custkey, w FROM {HIGH} UNION ALL SELECT 'r', o_custkey, -w FROM {LOW})"))
def _(s, d):
    a, b = (ZSet(x.select("o_custkey", W)) for x in halves(s, d))
    pair = Pair(a, b) - Pair(b, a)
    return out(w.union_all(pair.left.df.withColumn("side", F.lit("l")), pair.right.df.withColumn("side", F.lit("r"))).select("side", "o_custkey", W))


@query("zset_makeset", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS w FROM orders")
def _(s, d):
    return out(ZSet.make(table(s, d, "orders").agg(F.count("*").alias("n"))).df)


# --- filter and project ----------------------------------------------------------------------------------------------


@query("filter", f"SELECT o_orderkey, CAST(price AS DOUBLE) AS price, w FROM {O} WHERE price > 200000")
def _(s, d):
    return out(r.where(orders(s, d, "o_orderkey", "price"), "price > 200000").withColumn("price", F.col("price").cast("double")))


@query("project_merge", merged("o_orderstatus, yr", f"(SELECT *, CAST(year(o_orderdate) AS INTEGER) AS yr FROM {O})"))
def _(s, d):
    return out(r.project(orders(s, d, "o_orderstatus", "o_orderdate"), "o_orderstatus", F.year("o_orderdate").alias("yr")))


@query("project_bag", f"SELECT o_orderstatus, w FROM {O}")
def _(s, d):
    return out(r.project(orders(s, d, "o_orderstatus"), "o_orderstatus", merge=False))


# --- joins -----------------------------------------------------------------------------------------------------------

NK = "NULLIF(c_nationkey % 5, 0)"


@query("equi_join", merged("o_orderkey, c_custkey, c_mktsegment", f"(SELECT o_orderkey, c_custkey, c_mktsegment, o.w * c.w AS w FROM {O} o JOIN {C} c ON o_custkey = c_custkey)"))
def _(s, d):
    a, b = orders(s, d, "o_orderkey", "o_custkey"), customers(s, d, "c_custkey", "c_mktsegment").drop(T)
    return out(r.equi_join(a, b, ["o_custkey"], ["c_custkey"]).drop("o_custkey"))


@query("equi_join_null_keys", f"SELECT s.s_suppkey, n.n_name, CAST(1 AS BIGINT) AS w FROM (SELECT s_suppkey, NULLIF(s_nationkey % 5, 0) AS k FROM supplier) s JOIN (SELECT n_name, NULLIF(n_nationkey % 5, 0) AS k FROM nation) n ON s.k IS NOT DISTINCT FROM n.k")
def _(s, d):
    key = lambda c: F.nullif(F.col(c) % 5, F.lit(0)).alias("k")
    a = w.weighted(table(s, d, "supplier").select("s_suppkey", key("s_nationkey")))
    b = w.weighted(table(s, d, "nation").select("n_name", key("n_nationkey")))
    return out(r.equi_join(a, b, ["k"]).drop("l_k", "r_k"))


@query("theta_join", "SELECT s_suppkey, p_partkey, CAST(1 AS BIGINT) AS w FROM supplier JOIN part ON s_nationkey = p_size AND s_acctbal > p_retailprice")
def _(s, d):
    a = w.weighted(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    b = w.weighted(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"))
    joined = r.theta_join(a, b, F.expr("l.s_nationkey = r.p_size AND l.s_acctbal > r.p_retailprice"), spread=16)
    return out(joined.select("s_suppkey", "p_partkey", W))


@query("cartesian", "SELECT r_name, n_name, CAST((1 + r_regionkey) * (n_nationkey - 3) AS BIGINT) AS w FROM region, nation WHERE n_nationkey <> 3")
def _(s, d):
    a = w.weighted(table(s, d, "region"), 1 + F.col("r_regionkey")).select("r_name", W)
    b = w.weighted(table(s, d, "nation"), F.col("n_nationkey") - 3).select("n_name", W)
    return out(r.cartesian(a, b))


# --- set operations --------------------------------------------------------------------------------------------------


def setop_sql(weight_b: str) -> str:
    return f"SELECT o_custkey, o_orderpriority, CAST(1 AS BIGINT) AS w FROM (SELECT o_custkey, o_orderpriority, w FROM {LOW} UNION ALL SELECT o_custkey, o_orderpriority, {weight_b} FROM {HIGH}) GROUP BY 1, 2 HAVING SUM(w) >= 1"


@query("distinct", f"SELECT o_custkey, o_orderpriority, CAST(1 AS BIGINT) AS w FROM {O} GROUP BY 1, 2 HAVING SUM(w) >= 1")
def _(s, d):
    return out(r.distinct(orders(s, d, *KEYS)))


@query("union", setop_sql("w"))
def _(s, d):
    return out(r.union(*halves(s, d)))


@query("difference", setop_sql("-w"))
def _(s, d):
    return out(r.difference(*halves(s, d)))


@query("intersect_weighted", f"SELECT a.o_custkey, a.o_orderpriority, CAST(a.w * b.w AS BIGINT) AS w FROM ({merged('o_custkey, o_orderpriority', LOW)}) a JOIN ({merged('o_custkey, o_orderpriority', HIGH)}) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority")
def _(s, d):
    return out(r.intersect(*halves(s, d)))


# --- aggregates ------------------------------------------------------------------------------------------------------

AVG = "CAST(SUM(price * w) AS DOUBLE) / NULLIF(SUM(w), 0)"


def avg(col="price"):
    return r.total(col).cast("double") / F.nullif(F.sum(W), F.lit(0))


@query("count", f"SELECT CAST(COALESCE(SUM(w), 0) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM {O}")
def _(s, d):
    return out(r.aggregate(orders(s, d, "o_orderkey"), [], n=r.count()))


@query("sum", f"SELECT CAST(COALESCE(SUM(price * w), 0) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS w FROM {O}")
def _(s, d):
    return out(r.aggregate(orders(s, d, "o_orderkey", "price"), [], total=r.total("price").cast("double")))


@query("average", f"SELECT {AVG} AS mean, CAST(1 AS BIGINT) AS w FROM {O}")
def _(s, d):
    return out(r.aggregate(orders(s, d, "o_orderkey", "price"), [], mean=avg()))


@query("aggregate_empty", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean")
def _(s, d):
    z = orders(s, d, "o_orderkey", "price").where("o_orderkey < 0")
    return r.aggregate(z, [], n=r.count(), total=r.total("price").cast("double"), mean=avg()).drop(W)


@query("average_sql_nulls", "SELECT c_nationkey, CAST(ROUND(SUM(v * w) / NULLIF(SUM(CASE WHEN v IS NOT NULL THEN w END), 0), 4) AS DOUBLE) AS mean, CAST(ROUND(SUM(COALESCE(v, 0) * w) / SUM(w), 4) AS DOUBLE) AS mean_all FROM (SELECT c_nationkey, NULLIF(c_custkey % 4, 0)::DOUBLE AS v, 1 + c_custkey % 2 AS w FROM customer) GROUP BY 1")
def _(s, d):
    z = customers(s, d, "c_custkey", "c_nationkey", F.nullif(F.col("c_custkey") % 4, F.lit(0)).cast("double").alias("v")).drop(T)
    return r.aggregate(z, ["c_nationkey"], mean=F.round(r.average("v", sql_nulls=True), 4), mean_all=F.round(r.average("v"), 4)).drop(W)


@query("group_agg", f"SELECT o_custkey, CAST(SUM(w) AS BIGINT) AS n, CAST(SUM(price * w) AS DOUBLE) AS total, {AVG} AS mean, CAST(1 AS BIGINT) AS w FROM {O} GROUP BY 1")
def _(s, d):
    z = orders(s, d, "o_orderkey", "o_custkey", "price")
    return out(r.aggregate(z, ["o_custkey"], n=r.count(), total=r.total("price").cast("double"), mean=avg()))


@query("group_by_index", "SELECT o_orderkey, o_orderpriority, CAST(1 + o_orderkey % 3 AS BIGINT) AS w FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_orderpriority, CAST(-1 AS BIGINT) AS w FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0")
def _(s, d):
    return out(r.group_by(orders(s, d, "o_orderkey", "o_orderpriority"), "o_orderpriority").get("1-URGENT"))


@query("group_extremes", f"SELECT o_orderpriority, CAST(MIN(price) AS DOUBLE) AS low, CAST(MAX(price) AS DOUBLE) AS high FROM {O} WHERE w > 0 GROUP BY 1")
def _(s, d):
    z = orders(s, d, "o_orderkey", "o_orderpriority", "price")
    return r.extremes(z, ["o_orderpriority"], low=F.min("price").cast("double"), high=F.max("price").cast("double")).drop(W)


# --- order and top-k -------------------------------------------------------------------------------------------------

def dearest() -> list:
    return [F.desc("o_totalprice"), F.asc("o_orderkey")]


def topk_sql(limit: str) -> str:
    return f"SELECT o_orderkey, o_totalprice, CAST(1 AS BIGINT) AS w FROM {O} WHERE w > 0 ORDER BY o_totalprice DESC, o_orderkey {limit}"


@query("topk", topk_sql("LIMIT 25"))
def _(s, d):
    return out(r.top_k(orders(s, d, "o_orderkey", "o_totalprice"), dearest(), 25))


@query("topk_offset", topk_sql("LIMIT 20 OFFSET 30"))
def _(s, d):
    return out(r.top_k(orders(s, d, "o_orderkey", "o_totalprice"), dearest(), 20, 30))


@query("order_limit", "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS INTEGER) AS rank FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40")
def _(s, d):
    z = w.weighted(table(s, d, "customer").select("c_custkey", "c_acctbal"))
    ranked = r.top_k(z, [F.asc("c_acctbal"), F.asc("c_custkey")], 40, rank=True)
    return ranked.select("c_custkey", "c_acctbal", F.col("__rank").alias("rank"))


@query("rank_all", f"SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS rank FROM {O} WHERE w > 0")
def _(s, d):
    return r.top_k(orders(s, d, "o_orderkey", "o_totalprice"), dearest(), rank=True).select("o_orderkey", "o_totalprice", F.col("__rank").alias("rank"))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("stream_at", merged("o_custkey", O, where="t = 4"))
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).at(4))


@query("delay", f"SELECT o_custkey, t + 1 AS t, CAST(SUM(w) AS BIGINT) AS w FROM {O} GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    return out(w.consolidate(Stream(log(s, d, "o_custkey")).delay().log))


@query("differentiate", f"SELECT o_custkey, t, CAST(SUM(w) AS BIGINT) AS w FROM (SELECT o_custkey, t, w FROM {O} UNION ALL SELECT o_custkey, t + 1, -w FROM {O}) WHERE t < 10 GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).differentiate(until=10).log)


INTEGRAL = f"SELECT o_custkey, x.t AS t, CAST(SUM(w) AS BIGINT) AS w FROM {O} o JOIN (SELECT range AS t FROM range(0, 10)) x ON o.t <= x.t GROUP BY 1, 2 HAVING SUM(w) <> 0"


@query("integrate", INTEGRAL)
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).integrate().log)


@query("integrate_inverse", f"SELECT o_custkey, t, CAST(SUM(w) AS BIGINT) AS w FROM {O} GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).integrate().differentiate(until=10).log)


@query("definite_integral", merged("o_custkey", O))
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).integral())


@query("lift_filter", f"SELECT o_custkey, CAST(price AS DOUBLE) AS price, t, CAST(SUM(w) AS BIGINT) AS w FROM {O} WHERE price > 250000 GROUP BY 1, 2, 3 HAVING SUM(w) <> 0")
def _(s, d):
    stream = Stream(log(s, d, "o_custkey", "price")).lift(lambda x: r.where(x, "price > 250000"))
    return out(w.consolidate(stream.log).withColumn("price", F.col("price").cast("double")))


@query("circuit_chain", f"SELECT o_orderpriority, t, CAST(SUM(w) AS BIGINT) AS w FROM {O} WHERE price > 250000 GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    circuit = Circuit.where("price > 250000").compose(Circuit.project("o_orderpriority"))
    return out(circuit.execute(Stream(log(s, d, "o_orderpriority", "price"))).log)


@query("zero_after", "SELECT FALSE AS after_8, TRUE AS after_9")
def _(s, d):
    x = Stream(log(s, d, "o_custkey"))
    return s.createDataFrame([(x.is_zero_after(8), x.is_zero_after(9))], "after_8 boolean, after_9 boolean")


@query("tuple_stream", merged("side, k", f"(SELECT 'l' AS side, o_custkey AS k, w FROM {O} WHERE t = 4 UNION ALL SELECT 'r', c_custkey, w FROM {C} WHERE t = 4)"))
def _(s, d):
    pair = tuple_stream(Stream(log(s, d, "o_custkey")), Stream(customers(s, d, "c_custkey"))).at(4)
    return out(w.union_all(pair.left.df.select(F.lit("l").alias("side"), F.col("o_custkey").alias("k"), W), pair.right.df.select(F.lit("r").alias("side"), F.col("c_custkey").alias("k"), W)))


@query("nested_lift", f"SELECT o_custkey, o_orderkey % 3 AS t0, x.t AS t, CAST(SUM(w) AS BIGINT) AS w FROM {O} o JOIN (SELECT range AS t FROM range(0, 10)) x ON o.t <= x.t WHERE price > 100000 GROUP BY 1, 2, 3 HAVING SUM(w) <> 0")
def _(s, d):
    nested = Nested(log(s, d, "o_custkey", "price", (F.col("o_orderkey") % 3).alias(OUTER)))
    lifted = nested.lift(lambda x: Stream(r.project(r.where(x.log, "price > 100000"), "o_custkey", OUTER)).integrate(until=10))
    return out(lifted.log.withColumnRenamed(OUTER, "t0"))


@query("delta0", merged("o_custkey, t", f"(SELECT o_custkey, 0::BIGINT AS t, w FROM {O})"))
def _(s, d):
    return out(w.consolidate(Stream.impulse(orders(s, d, "o_custkey")).log))


# --- incremental operators -------------------------------------------------------------------------------------------

SNAP = "{0}.t <= x.t"
JOINED = f"SELECT o_orderpriority, c_mktsegment, SUM(o.w * c.w) AS w FROM {O} o JOIN {C} c ON o_custkey = c_custkey WHERE o.t <= x.t AND c.t <= x.t GROUP BY 1, 2 HAVING SUM(o.w * c.w) <> 0"


@query("inc_join", by_snapshots("o_orderpriority, c_mktsegment", JOINED))
def _(s, d):
    joined = Circuit.equi_join(["o_custkey"], ["c_custkey"]).compose(Circuit.project("o_orderpriority", "c_mktsegment"))
    return out(joined.execute(Stream(log(s, d, "o_custkey", "o_orderpriority")), Stream(customers(s, d, "c_custkey", "c_mktsegment"))).log)


def _tick_join(a, b):
    """Orders and customers of the same time, by the columns of the query."""
    right = b.select("c_custkey", "c_mktsegment", F.col(T).alias("__tc"), F.col(W).alias("__wc"))
    joined = a.join(right, (F.col("o_custkey") == F.col("c_custkey")) & (F.col(T) == F.col("__tc")))
    return w.consolidate(joined.select("o_orderpriority", "c_mktsegment", T, (F.col(W) * F.col("__wc")).alias(W)))


@query("naive_join", by_snapshots("o_orderpriority, c_mktsegment", JOINED))
def _(s, d):
    return out(Circuit.naive(_tick_join).execute(Stream(log(s, d, "o_custkey", "o_orderpriority")), Stream(customers(s, d, "c_custkey", "c_mktsegment"))).log)


@query("bilinear_old_form", by_snapshots("o_orderpriority, c_mktsegment", JOINED))
def _(s, d):
    return out(inc.bilinear_by_integrals(log(s, d, "o_custkey", "o_orderpriority"), customers(s, d, "c_custkey", "c_mktsegment"), _tick_join))


SUPP = "(SELECT s_suppkey, s_acctbal, s_nationkey, CAST(1 + s_suppkey % 2 AS BIGINT) AS w, CAST(s_suppkey % 5 AS BIGINT) AS t FROM supplier)"
NATION = "(SELECT n_name, n_nationkey, CAST(CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE 1 END AS BIGINT) AS w, CAST(n_nationkey % 7 AS BIGINT) AS t FROM nation)"


def suppliers(s, d, *columns):
    return table(s, d, "supplier").select(*columns, (F.col("s_suppkey") % 5).cast("long").alias(T), (1 + F.col("s_suppkey") % 2).cast("long").alias(W))


def nations(s, d, *columns):
    return table(s, d, "nation").select(*columns, (F.col("n_nationkey") % 7).cast("long").alias(T), F.expr("CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE 1 END").cast("long").alias(W))


@query("inc_theta", by_snapshots("n_name", f"SELECT n_name, SUM(a.w * b.w) AS w FROM {SUPP} a JOIN {NATION} b ON a.s_nationkey > b.n_nationkey AND a.s_acctbal > 0 WHERE a.t <= x.t AND b.t <= x.t GROUP BY 1 HAVING SUM(a.w * b.w) <> 0"))
def _(s, d):
    c = Circuit.theta_join(F.expr("l.s_nationkey > r.n_nationkey AND l.s_acctbal > 0")).compose(Circuit.project("n_name"))
    return out(c.execute(Stream(suppliers(s, d, "s_suppkey", "s_nationkey", "s_acctbal")), Stream(nations(s, d, "n_name", "n_nationkey"))).log)


@query("inc_cartesian", by_snapshots("s_suppkey, n_name", f"SELECT s_suppkey, n_name, SUM(a.w * b.w) AS w FROM {SUPP} a, {NATION} b WHERE a.t <= x.t AND b.t <= x.t GROUP BY 1, 2 HAVING SUM(a.w * b.w) <> 0"))
def _(s, d):
    return out(Circuit.cartesian().execute(Stream(suppliers(s, d, "s_suppkey")), Stream(nations(s, d, "n_name"))).log)


def half_logs(s, d):
    return log(s, d, "o_custkey"), log(s, d, "o_custkey", "o_orderkey").withColumn(W, F.expr(OTHER).cast("long")).drop("o_orderkey")


def half_snapshots(pick: str) -> str:
    a, b = (f"SELECT o_custkey, SUM(w) AS w FROM {h} WHERE t <= x.t GROUP BY 1" for h in (LOW, HIGH))
    return pick.format(a=f"({a})", b=f"({b})")


@query("inc_intersect", by_snapshots("o_custkey", half_snapshots("SELECT a.o_custkey, a.w * b.w AS w FROM {a} a JOIN {b} b ON a.o_custkey = b.o_custkey WHERE a.w * b.w <> 0")))
def _(s, d):
    a, b = half_logs(s, d)
    return out(Circuit.intersect().execute(Stream(a), Stream(b)).log)


@query("inc_distinct", by_snapshots("o_custkey", f"SELECT o_custkey, 1 AS w FROM {O} WHERE t <= x.t GROUP BY 1 HAVING SUM(w) >= 1"))
def _(s, d):
    return out(Circuit.distinct().execute(Stream(log(s, d, "o_custkey"))).log)


@query("inc_union", by_snapshots("o_custkey", half_snapshots("SELECT o_custkey, 1 AS w FROM (SELECT * FROM {a} UNION ALL SELECT * FROM {b}) GROUP BY 1 HAVING SUM(w) >= 1")))
def _(s, d):
    a, b = half_logs(s, d)
    return out(Circuit.union().execute(Stream(a), Stream(b)).log)


@query("inc_difference", by_snapshots("o_custkey", half_snapshots("SELECT o_custkey, 1 AS w FROM (SELECT * FROM {a} UNION ALL SELECT o_custkey, -w AS w FROM {b}) GROUP BY 1 HAVING SUM(w) >= 1")))
def _(s, d):
    a, b = half_logs(s, d)
    return out(Circuit.difference().execute(Stream(a), Stream(b)).log)


@query("incrementalize", by_snapshots("o_custkey", f"SELECT o_custkey, 1 AS w FROM {O} WHERE t <= x.t GROUP BY 1 HAVING SUM(w) >= 1"))
def _(s, d):
    return out(Stream(log(s, d, "o_custkey")).incrementalize(r.distinct).log)


@query("inc_count", by_snapshots("n", f"SELECT CAST(SUM(w) AS BIGINT) AS n, 1 AS w FROM {O} WHERE t <= x.t"))
def _(s, d):
    return out(inc.aggregate(log(s, d, "o_orderkey"), [], {}, {"n": inc.count}))


@query("inc_sum", by_snapshots("total", f"SELECT CAST(SUM(price * w) AS DOUBLE) AS total, 1 AS w FROM {O} WHERE t <= x.t"))
def _(s, d):
    return out(inc.aggregate(log(s, d, "o_orderkey", "price"), [], {"v": F.col("price")}, {"total": lambda x: x["v"].cast("double")}))


@query("inc_average", by_snapshots("o_orderpriority, mean", f"SELECT o_orderpriority, ROUND(SUM(CAST(price AS DOUBLE) * w) / NULLIF(SUM(w), 0), 4) AS mean, 1 AS w FROM {O} WHERE t <= x.t GROUP BY 1"))
def _(s, d):
    results = {"mean": lambda x: F.round(inc.average("v")({"v": x["v"].cast("double"), "count": x["count"]}), 4)}
    return out(inc.aggregate(log(s, d, "o_orderkey", "o_orderpriority", "price"), ["o_orderpriority"], {"v": F.col("price")}, results))


@query("inc_group_agg", by_snapshots("o_custkey, n, total", f"SELECT o_custkey, CAST(SUM(w) AS BIGINT) AS n, CAST(SUM(price * w) AS DOUBLE) AS total, 1 AS w FROM {O} WHERE t <= x.t GROUP BY 1"))
def _(s, d):
    results = {"n": inc.count, "total": lambda x: x["v"].cast("double")}
    return out(inc.aggregate(log(s, d, "o_orderkey", "o_custkey", "price"), ["o_custkey"], {"v": F.col("price")}, results))


@query("tick_count", f"SELECT t, CAST(SUM(w) AS BIGINT) AS n FROM {O} GROUP BY 1")
def _(s, d):
    return out(Circuit.per_tick([], n=r.count()).execute(Stream(log(s, d, "o_orderkey"))).log.select(T, "n"))


@query("tick_sum", f"SELECT t, o_orderpriority, CAST(SUM(price * w) AS DOUBLE) AS total, {AVG} AS mean FROM {O} GROUP BY 1, 2")
def _(s, d):
    z = log(s, d, "o_orderkey", "o_orderpriority", "price")
    return out(r.aggregate(z, ["o_orderpriority"], total=r.total("price").cast("double"), mean=avg()).select(T, "o_orderpriority", "total", "mean"))


@query("tick_sum_circuit", f"SELECT t, o_orderpriority, CAST(SUM(price * w) AS DOUBLE) AS total FROM {O} GROUP BY 1, 2")
def _(s, d):
    tick = Circuit.per_tick(["o_orderpriority"], total=r.total("price"))
    return tick.execute(Stream(log(s, d, "o_orderkey", "o_orderpriority", "price"))).log.select(F.col(T).alias("t"), "o_orderpriority", F.col("total").cast("double").alias("total"))


@query("circuit_order_by", by_snapshots("o_orderkey, o_totalprice", f"SELECT o_orderkey, o_totalprice, 1 AS w FROM {O} WHERE w > 0 AND t <= x.t ORDER BY o_totalprice, o_orderkey LIMIT 40"))
def _(s, d):
    return out(Circuit.order_by([F.asc("o_totalprice"), F.asc("o_orderkey")], 40).execute(Stream(log(s, d, "o_orderkey", "o_totalprice"))).log)


@query("inc_topk", by_snapshots("o_orderkey, o_totalprice", f"SELECT o_orderkey, o_totalprice, 1 AS w FROM {O} WHERE w > 0 AND t <= x.t ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5"))
def _(s, d):
    return out(Circuit.top_k(dearest(), 15, 5).execute(Stream(log(s, d, "o_orderkey", "o_totalprice"))).log)


@query("plan_delta", by_snapshots("c_mktsegment, n", f"SELECT c_mktsegment, CAST(SUM(o.w * c.w) AS BIGINT) AS n, 1 AS w FROM {O} o JOIN {C} c ON o_custkey = c_custkey WHERE o.t <= x.t AND c.t <= x.t AND price > 100000 GROUP BY 1"))
def _(s, d):
    joined = p.EquiJoin((p.Where((p.Source((), "o"),), F.expr("price > 100000")), p.Source((), "c")), ("o_custkey",), ("c_custkey",))
    plan = p.optimize(p.Aggregate((joined,), ("c_mktsegment",), {}, {"n": inc.count}))
    return out(plan.delta({"o": log(s, d, "o_orderkey", "o_custkey", "price"), "c": customers(s, d, "c_custkey", "c_mktsegment")}))


@query("eliminate_distinct", f"SELECT o_custkey, CAST(1 AS BIGINT) AS w FROM {O} WHERE w > 0 AND o_custkey % 2 = 0 GROUP BY 1")
def _(s, d):
    inner = p.Distinct((p.Where((p.Source((), "o"),), F.col(W) > 0),))
    plan = p.Distinct((p.Where((p.Project((inner,), ("o_custkey",), False),), F.expr("o_custkey % 2 = 0")),))
    better = p.optimize(plan)
    return out(better.eval({"o": orders(s, d, "o_orderkey", "o_custkey")}))


@query("is_linear", "SELECT * FROM (VALUES ('Source', TRUE, FALSE), ('Where', TRUE, FALSE), ('Project', TRUE, FALSE), ('UnionAll', TRUE, FALSE), ('Negate', TRUE, FALSE), ('EquiJoin', FALSE, TRUE), ('ThetaJoin', FALSE, TRUE), ('Intersect', FALSE, TRUE), ('Distinct', FALSE, FALSE), ('Union', FALSE, FALSE), ('Difference', FALSE, FALSE), ('Aggregate', FALSE, FALSE), ('TopK', FALSE, FALSE)) v(node, linear, bilinear)")
def _(s, d):
    kinds = (p.Source, p.Where, p.Project, p.UnionAll, p.Negate, p.EquiJoin, p.ThetaJoin, p.Intersect, p.Distinct, p.Union, p.Difference, p.Aggregate, p.TopK)
    return s.createDataFrame([(k.__name__, k.linear, k.bilinear) for k in kinds], "node string, linear boolean, bilinear boolean")


# --- state between calls ---------------------------------------------------------------------------------------------


@query("stateful_join", f"SELECT o_orderkey, c_mktsegment, CAST(SUM(o.w * c.w) AS BIGINT) AS w FROM {O} o JOIN {C} c ON o_custkey = c_custkey WHERE o.t >= 5 OR c.t >= 5 GROUP BY 1, 2 HAVING SUM(o.w * c.w) <> 0")
def _(s, d):
    o, c = orders(s, d, "o_orderkey", "o_custkey"), customers(s, d, "c_custkey", "c_mktsegment").drop(T)
    early = lambda z, k: (z.where(f"{k} % 10 < 5"), z.where(f"{k} % 10 >= 5"))
    (o0, o1), (c0, c1) = early(o, "o_orderkey"), early(c, "c_custkey")
    join = StatefulEquiJoin(s, ["o_custkey"], ["c_custkey"])
    join.initialize(o0, c0)
    return out(r.project(join.increment(o1, c1), "o_orderkey", "c_mktsegment"))


@query("stateful_topk", f"SELECT o_orderkey, o_totalprice, CAST(SUM(w) AS BIGINT) AS w FROM ((SELECT o_orderkey, o_totalprice, 1 AS w FROM {O} WHERE w > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) UNION ALL (SELECT o_orderkey, o_totalprice, -1 AS w FROM {O} WHERE w > 0 AND t < 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30)) GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    o = orders(s, d, "o_orderkey", "o_totalprice")
    top = StatefulTopK(s, dearest(), 30)
    top.initialize(o.where("o_orderkey % 10 < 5"))
    return out(top.increment(o.where("o_orderkey % 10 >= 5")))


TOP30 = "SELECT o_orderkey, o_totalprice, {w} AS w FROM ({rows}) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30"
HELD = "SELECT o_orderkey, o_totalprice FROM orders"
#: Every seventh key moves to another price, with a delete that names a stale one; every eleventh goes by a stale delete.
MOVED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(1000 + o_orderkey % 500000 AS DOUBLE) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0"


@query("stateful_topk_keyed", f"SELECT o_orderkey, o_totalprice, CAST(SUM(w) AS BIGINT) AS w FROM (({TOP30.format(w=1, rows=MOVED)}) UNION ALL ({TOP30.format(w=-1, rows=HELD)})) GROUP BY 1, 2 HAVING SUM(w) <> 0")
def _(s, d):
    o = w.weighted(table(s, d, "orders").select("o_orderkey", "o_totalprice"))
    top = StatefulTopK(s, dearest(), 30, key_cols=["o_orderkey"])
    top.initialize(o)
    stale = o.where("o_orderkey % 7 = 0 OR o_orderkey % 11 = 0").withColumn("o_totalprice", F.lit(-1.0)).withColumn(W, F.lit(-1).cast("long"))
    moved = o.where("o_orderkey % 7 = 0").withColumn("o_totalprice", (1000 + F.col("o_orderkey") % 500000).cast("double"))
    return out(top.increment(stale.unionByName(moved)))


@query("topk_stats", f"SELECT CAST(count(*) AS BIGINT) AS records, CAST(30 AS BIGINT) AS in_window, CAST(2 AS BIGINT) AS versions FROM {O} WHERE w > 0")
def _(s, d):
    o = orders(s, d, "o_orderkey", "o_totalprice")
    top = StatefulTopK(s, dearest(), 30)
    top.initialize(o.where("o_orderkey % 10 < 5"))
    top.increment(o.where("o_orderkey % 10 >= 5"))
    n = top.stats()
    return s.createDataFrame([(n["records"], n["window"], n["versions"])], "records long, in_window long, versions long")


@query("join_circuit_view", merged("o_orderkey, o_custkey, c_custkey, c_mktsegment", f"(SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment, o.w * c.w AS w FROM {O} o JOIN {C} c ON o_custkey = c_custkey)"))
def _(s, d):
    o, c = orders(s, d, "o_orderkey", "o_custkey"), customers(s, d, "c_custkey", "c_mktsegment").drop(T)
    circuit = create_stateful_join(s, ["o_custkey"], ["c_custkey"])
    circuit.initialize(o.where("o_orderkey % 10 < 5"), c)
    circuit.increment(o.where("o_orderkey % 10 >= 5"), None)
    return out(circuit.materialized_view())


@query("join_indexes", f"SELECT 'l' AS side, o_orderkey AS k, o_custkey AS on_key, CAST(w AS BIGINT) AS w FROM {O} WHERE o_custkey <= 40 UNION ALL SELECT 'r', c_custkey, c_custkey, CAST(w AS BIGINT) FROM {C} WHERE c_custkey <= 40")
def _(s, d):
    join = StatefulEquiJoin(s, ["o_custkey"], ["c_custkey"])
    join.initialize(orders(s, d, "o_orderkey", "o_custkey"), customers(s, d, "c_custkey").drop(T))
    left, right = join.indexes(list(range(41)))
    return out(w.union_all(left.select(F.lit("l").alias("side"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("on_key"), W), right.select(F.lit("r").alias("side"), F.col("c_custkey").alias("k"), F.col("c_custkey").alias("on_key"), W)))


# --- keyed tables ----------------------------------------------------------------------------------------------------

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
#: As many customers again, under ids that are not in the table.
MORE = "c_custkey + 10000000 AS c_custkey, c_name, c_nationkey, c_acctbal"


def keyed(s, d):
    return KeyedTable(table(s, d, "customer").select(*CUST), "c_custkey")


def delta_sql(new: str) -> str:
    cols = ", ".join(CUST)
    return f"SELECT {cols}, CAST(SUM(w) AS BIGINT) AS w FROM (SELECT {cols}, 1 AS w FROM ({new}) UNION ALL SELECT {cols}, -1 AS w FROM customer) GROUP BY {cols} HAVING SUM(w) <> 0"


@query("table_create", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def _(s, d):
    t = KeyedTable(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("seq")), "o_custkey", seq="seq")
    return t.to_df()


@query("table_add", f"SELECT {MORE}, CAST(1 AS BIGINT) AS w FROM customer")
def _(s, d):
    return out(keyed(s, d).add(table(s, d, "customer").selectExpr(*MORE.split(", "))))


@query("table_upsert", delta_sql(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT {MORE} FROM customer"))
def _(s, d):
    rows = table(s, d, "customer").select(*CUST).where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!")))
    return out(keyed(s, d).upsert(rows.unionByName(table(s, d, "customer").selectExpr(*MORE.split(", ")))))


@query("table_upsert_repeated", delta_sql("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '9' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer"))
def _(s, d):
    t, times = keyed(s, d), F.explode(F.sequence(F.lit(7), F.lit(9))).alias("seq")
    rows = table(s, d, "customer").select(*CUST, times).where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.col("seq").cast("string")))
    delta = t.upsert(rows, seq="seq")
    assert t.df.groupBy("c_custkey").count().where("count > 1").isEmpty()
    return out(delta)


@query("table_update", delta_sql("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 1 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal FROM customer"))
def _(s, d):
    rows = table(s, d, "customer").where("c_custkey % 7 = 1").select("c_custkey", F.lit(None).cast("int").alias("c_nationkey"))
    return out(keyed(s, d).update(rows))


@query("table_remove", delta_sql("SELECT * FROM customer WHERE c_custkey % 4 <> 0"))
def _(s, d):
    return out(keyed(s, d).remove(table(s, d, "customer").where("c_custkey % 4 = 0")))


@query("table_clear", delta_sql("SELECT * FROM customer WHERE FALSE"))
def _(s, d):
    return out(keyed(s, d).clear())


@query("table_batch", delta_sql("SELECT c_custkey, c_name || '+' AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 NOT IN (0, 1)"))
def _(s, d):
    rows = table(s, d, "customer").select(*CUST)
    up = rows.where("c_custkey % 6 IN (0, 1)").withColumn("c_name", F.concat("c_name", F.lit("+"))).withColumn("__op", F.lit("upsert")).withColumn("__seq", F.lit(1))
    gone = rows.where("c_custkey % 6 = 1").withColumn("__op", F.lit("remove")).withColumn("__seq", F.lit(2))
    return out(keyed(s, d).batch(up.unionByName(gone)))


@query("table_batch_delta", delta_sql("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_name || '+' ELSE c_name || '-' END AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 IN (0, 2) UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 6 IN (3, 4, 5)"))
def _(s, d):
    rows = table(s, d, "customer").select(*CUST)
    step = lambda x, op, seq, weight=None: x.withColumn("__op", F.lit(op)).withColumn("__seq", F.lit(seq)).withColumn(W, F.lit(weight).cast("long"))
    named = lambda k, mark: rows.where(f"c_custkey % 6 = {k}").withColumn("c_name", F.concat("c_name", F.lit(mark)))
    parts = [step(named(0, "+"), "upsert", 1), step(named(1, "+"), "upsert", 1), step(named(1, "+"), "delta", 2, -1), step(named(2, "x"), "remove", 1)]
    parts += [step(named(2, ""), "delta", 2, -1), step(named(2, "-"), "delta", 2, 3), step(named(4, "?"), "delta", 1, 0)]
    ops = parts[0]
    for x in parts[1:]:
        ops = ops.unionByName(x)
    return out(keyed(s, d).batch(ops))


@query("table_apply_delta", delta_sql("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 9 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 9 <> 4"))
def _(s, d):
    rows = table(s, d, "customer").select(*CUST)
    new = w.weighted(rows.where("c_custkey % 9 = 2").withColumn("c_acctbal", F.col("c_acctbal") + 1), 5)
    return out(keyed(s, d).apply_delta(new.unionByName(w.weighted(rows.where("c_custkey % 9 = 4"), -1))))


@query("table_subscribe", delta_sql("SELECT * FROM customer WHERE c_custkey % 4 <> 0"))
def _(s, d):
    seen = []
    t = keyed(s, d)
    t.subscribe(seen.append)
    t.remove(table(s, d, "customer").where("c_custkey % 4 = 0"))
    return out(seen[0])


@query("table_get_size", "SELECT count(*) AS n, bool_or(c_custkey = 7) AS has_7, bool_or(c_custkey = -10) AS has_10 FROM customer")
def _(s, d):
    t = keyed(s, d)
    return s.createDataFrame([(t.size(), t.has(7), t.has(-10))], "n long, has_7 boolean, has_10 boolean")


# --- builder and views -----------------------------------------------------------------------------------------------


def order_table(s, d):
    return KeyedTable(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


def customer_table(s, d):
    return KeyedTable(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey")


@query("builder_join_select_sort_limit", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def _(s, d):
    q = create_query(order_table(s, d)).join(customer_table(s, d), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice")
    return q.sort_by("o_totalprice", "o_orderkey", descending=True).limit(10).to_df()


@query("builder_joined_where", "SELECT o_orderkey, c_custkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 20 * c_acctbal AND c_mktsegment = 'BUILDING'")
def _(s, d):
    q = create_query(order_table(s, d)).join(customer_table(s, d), "o_custkey", "c_custkey")
    return q.where("o_totalprice > 20 * c_acctbal AND c_mktsegment = 'BUILDING'").select("o_orderkey", "c_custkey", "o_totalprice", "c_acctbal").to_df()


@query("builder_group", "SELECT o_orderpriority, count(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*), 4) AS DOUBLE) AS mean FROM orders GROUP BY 1")
def _(s, d):
    price = F.expr(PRICE)
    g = create_query(order_table(s, d)).group_by("o_orderpriority").aggregate(n=inc.count, total=("sum", price), mean=("average", price))
    return g.to_df().select("o_orderpriority", "n", F.col("total").cast("double").alias("total"), F.round(F.col("total").cast("double") / F.col("n"), 4).alias("mean"))


@query("builder_scalar", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def _(s, d):
    return create_query(order_table(s, d)).where("o_totalprice > 100000").count().to_df().withColumnRenamed("count", "n")


@query("builder_sum", "SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def _(s, d):
    t = KeyedTable(table(s, d, "orders").select("o_orderkey", F.expr(PRICE).alias("price")), "o_orderkey")
    return create_query(t).sum("price").to_df().select(F.col("sum").cast("double").alias("total"))


@query("builder_average", "SELECT CAST(ROUND(AVG(o_orderkey), 4) AS DOUBLE) AS mean FROM orders")
def _(s, d):
    return create_query(order_table(s, d)).average("o_orderkey").to_df().select(F.round("average", 4).alias("mean"))


@query("builder_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 12 OFFSET 7")
def _(s, d):
    return create_query(order_table(s, d)).select("o_orderkey", "o_totalprice").sort_by("o_totalprice", "o_orderkey", descending=True).limit(12, 7).to_df()


@query("view_topk", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def _(s, d):
    o = order_table(s, d)
    q = create_query(o).join(customer_table(s, d), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice")
    view = q.sort_by("o_totalprice", "o_orderkey", descending=True).limit(10).reactive()
    o.remove(table(s, d, "orders").where("o_orderkey % 3 = 0"))
    view.close()
    return view.to_df()


@query("builder_bag", "SELECT o_orderpriority FROM orders")
def _(s, d):
    return create_query(order_table(s, d)).select("o_orderpriority").to_df(bag=True)


@query("builder_sort_dedup", "SELECT DISTINCT o_orderpriority FROM orders")
def _(s, d):
    return create_query(order_table(s, d)).select("o_orderpriority").sort_by("o_orderpriority").to_df()


@query("builder_union_difference", "SELECT o_custkey FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    o, c = create_query(order_table(s, d)), create_query(customer_table(s, d))
    key = F.col("c_custkey").alias("o_custkey")
    return o.select("o_custkey").union(c.select(key)).difference(c.where("c_mktsegment = 'BUILDING'").select(key)).to_df()


@query("view_after_changes", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0 AND c_custkey % 13 <> 0 GROUP BY 1")
def _(s, d):
    o, c = order_table(s, d), customer_table(s, d)
    view = create_query(o).join(c, "o_custkey", "c_custkey").group_by("c_mktsegment").aggregate(n=inc.count).reactive()
    o.remove(table(s, d, "orders").where("o_orderkey % 11 = 0"))
    c.remove(table(s, d, "customer").where("c_custkey % 13 = 0"))
    view.close()
    return view.to_df()


@query("aggregate_builder", f"SELECT CAST(SUM(w) AS BIGINT) AS n, CAST(SUM(price * w) AS DOUBLE) AS total FROM {O}")
def _(s, d):
    z = standalone_aggregate(orders(s, d, "o_orderkey", "price"), n=inc.count, total=("sum", "price"))
    return z.select("n", F.col("total").cast("double").alias("total"))


@query("fixpoint_closure", "WITH RECURSIVE e AS (SELECT n_nationkey AS src, CAST((n_nationkey * 7 + 3) % 25 AS INTEGER) AS dst FROM nation WHERE n_nationkey % 4 <> 0), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def _(s, d):
    edges = table(s, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("src"), F.expr("CAST((n_nationkey * 7 + 3) % 25 AS INT)").alias("dst"))
    return transitive_closure(edges, StateStore(s)).drop(W)


@query("closure_tree", "WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def _(s, d):
    edges = table(s, d, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("src"), F.expr("CAST(c_custkey DIV 2 AS BIGINT)").alias("dst"))
    return transitive_closure(edges.select(F.col("src").cast("long").alias("src"), "dst"), StateStore(s)).drop(W)


# --- Spark's own, over the same model --------------------------------------------------------------------------------


@query("window_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS prev FROM orders QUALIFY rn <= 3")
def _(s, d):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = table(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("rn"), F.lag("o_orderkey").over(by).alias("prev"))
    return x.where("rn <= 3")


@query("outer_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    c = table(s, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["builder_join_select_sort_limit"](spark, sf_dir)
