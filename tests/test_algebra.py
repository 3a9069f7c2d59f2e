"""Laws on seeded random Z-sets and changelogs; golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.weights import T, W, consolidate, negate, union_all
from weftline.operators import incremental as inc
from weftline.operators import relational as r
from weftline.operators.zset import Pair, ZSet
from weftline.plans import tree as p
from weftline.streaming.changelog import Circuit, Stream

NAMES = "k string, v int"


def rows(df):
    return sorted(map(tuple, consolidate(df).collect()), key=repr)


def random_zset(spark, seed, n=25):
    rng = random.Random(seed)
    return ZSet.of(spark, [(rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, None]), rng.randint(-3, 3)) for _ in range(n)], NAMES)


def random_log(spark, seed, n=40):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, 3]), rng.randint(0, 5), rng.randint(-2, 2)) for _ in range(n)]
    return spark.createDataFrame(data, f"{NAMES}, {T} long, {W} long")


def test_group_laws(spark):
    a, b, c = (random_zset(spark, s) for s in (1, 2, 3))
    assert rows((a + b).df) == rows((b + a).df)
    assert rows(((a + b) + c).df) == rows((a + (b + c)).df)
    assert rows((a + a.zero()).df) == rows(a.df)
    assert (a - a).is_empty() and (a + -a).is_empty()
    assert (Pair(a, b) - Pair(a, b)).left.is_empty() and (Pair(a, b) + -Pair(a, b)).right.is_empty()
    assert rows(a.multiply(3).df) == rows((a + a + a).df) and a.multiply(0).is_empty()


def test_golden_cases(spark):
    z = lambda *x: ZSet.of(spark, x, "n string")
    both = z(("joe", 1), ("anne", -1)) + z(("joe", 2), ("bob", 1))
    assert rows(both.df) == [("anne", -1), ("bob", 1), ("joe", 3)]
    assert rows((z(("x", 2), ("y", 1)) - z(("x", 2), ("y", -4))).df) == [("y", 5)]
    assert rows(r.distinct(z(("a", 3), ("b", -1), ("b", 3), ("c", 1), ("d", 0)).df)) == [("a", 1), ("b", 1), ("c", 1)]
    assert rows(r.distinct(z(("a", 3), ("b", 1), ("b", -3), ("c", 1)).df)) == [("a", 1), ("c", 1)]
    assert rows(r.intersect(z(("x", 2), ("y", 3), ("z", 1)).df, z(("x", 4), ("y", 2)).df)) == [("x", 8), ("y", 6)]
    assert not z(("a", 2)).is_set() and z(("a", 1), ("a", 1), ("a", -1)).is_set() and not z(("a", -1)).is_positive()
    two = r.cartesian(z(("x", 2), ("y", 3)).df, z(("a", 1), ("b", 4)).df.withColumnRenamed("n", "m"))
    assert rows(two) == [("x", "a", 2), ("x", "b", 8), ("y", "a", 3), ("y", "b", 12)]


def test_streams_are_inverse(spark):
    s = Stream(random_log(spark, 4))
    assert rows(s.integrate().differentiate(until=6).log) == rows(s.log)
    assert rows(s.differentiate().integrate(until=6).log) == rows(s.log)
    gap = Stream(spark.createDataFrame([("a", 1, 0, 1), ("b", 2, 3, 1)], f"{NAMES}, {T} long, {W} long"))
    assert rows(gap.integrate().at(1)) == [("a", 1, 1)]
    assert rows(gap.differentiate().at(1)) == [("a", 1, -1)]
    assert gap.current_time() == 4 and gap.is_zero_after(3)
    assert [t for t, _ in gap.set(5, gap.at(0)).entries()] == [0, 3, 5]


@pytest.mark.parametrize("seed", [5, 6])
def test_rules_equal_their_definition(spark, seed):
    a, b = random_log(spark, seed), random_log(spark, seed + 50)
    sources = p.Source((), "a"), p.Source((), "b")
    plans = [
        p.EquiJoin(sources, ("k",), ("k",)),
        p.ThetaJoin(sources, F.col("l.v") < F.col("r.v")),
        p.Intersect(sources),
        p.Union(sources),
        p.Difference(sources),
        p.Distinct((p.Project((sources[0],), ("k",)),)),
        p.Aggregate((sources[0],), ("k",), {"s": F.col("v")}, {"n": inc.count, "s": inc.total("s")}),
        p.TopK((sources[0],), (F.desc_nulls_last("v"), F.asc_nulls_first("k")), 2, 1),
    ]
    for plan in plans:
        env = {k: v for k, v in {"a": a, "b": b}.items() if k in plan.sources()}
        assert rows(plan.delta(env)) == rows(p.naive_delta(plan, env)), type(plan).__name__


def test_step_equals_difference(spark):
    a, b, da = (random_zset(spark, s).df for s in (11, 12, 13))
    plan = p.Distinct((p.Project((p.EquiJoin((p.Source((), "a"), p.Source((), "b")), ("k",), ("k",)),), ("l_k",)),))
    old = {"a": a, "b": b}
    want = union_all(plan.eval({"a": union_all(a, da), "b": b}), negate(plan.eval(old)))
    assert rows(plan.step(old, {"a": da})) == rows(want)
    joined = plan.inputs[0].inputs[0]
    want = union_all(joined.eval({"a": union_all(a, da), "b": b}), negate(joined.eval(old)))
    assert rows(joined.step(old, {"a": da})) == rows(want)


def test_optimizer_keeps_results(spark):
    a, b = (r.distinct(random_zset(spark, s).df) for s in (21, 22))
    sources = p.Source((), "a", True), p.Source((), "b", True)
    inner = p.Distinct((p.UnionAll(sources),))
    plan = p.Distinct((p.Where((p.Where((inner,), F.col("v") > 0),), F.col("v") < 9),))
    better = p.optimize(plan)
    assert rows(better.eval({"a": a, "b": b})) == rows(plan.eval({"a": a, "b": b}))
    assert p.optimize(p.Distinct((sources[0],))) is not None and isinstance(p.optimize(p.Distinct((sources[0],))), p.Source)


def test_circuit_composition(spark):
    c = Circuit.where("v > 1").compose(Circuit.project("k")).compose(Circuit.distinct())
    log = random_log(spark, 31)
    naive = Circuit.naive(lambda x: r.distinct(r.project(r.where(x, "v > 1"), "k")))
    assert rows(c.execute(Stream(log)).log) == rows(naive.execute(Stream(log)).log)
    assert c.parts == ("where", "project", "distinct") and not c.linear


def test_products_are_merged_on_their_sides(spark):
    """No shuffle holds the product, and repeats, cancelled records, NULLs and blocks change no weight."""
    a, b = (union_all(random_zset(spark, s, 60).df, random_zset(spark, s + 1, 60).df) for s in (11, 13))
    a = a.withColumnRenamed("v", "u")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for on in ("l.k = r.k AND l.u <= r.v", "l.u < r.v"):
        want = rows(r.theta_join(a, b, F.expr(on), merge=False))
        for spread in (1, 3):
            got = r.theta_join(a, b, F.expr(on), spread=spread)
            assert sorted(map(tuple, got.collect()), key=repr) == want
            assert 0 < plan(got).find("Join") < plan(got).find("Aggregate")
    assert plan(r.theta_join(a, b, F.expr("l.u < r.v"), spread=3)).count("SortMergeJoin") == 1
    for got, want in ((r.cartesian(a, b), r.cartesian(a, b, merge=False)), (r.equi_join(a, b, ["k"]), r.equi_join(a, b, ["k"], merge=False))):
        assert sorted(map(tuple, got.collect()), key=repr) == rows(want)
