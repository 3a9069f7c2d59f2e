"""Keyed tables, views, live streams and state."""

import pytest
from pyspark.sql import functions as F

from weftline.functions.weights import W, weighted
from weftline.operators import incremental as inc
from weftline.plans import tree as p
from weftline.plans.query import create_query
from weftline.sources.files import read_changelog, read_table, write_changelog
from weftline.sources.state import StateStore
from weftline.sources.table import KeyedTable
from weftline.streaming.live import LiveView, stream_join
from weftline.streaming.recursion import transitive_closure
from weftline.streaming.stateful import StatefulTopK


def table(spark):
    return KeyedTable(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "id long, name string, v long"), "id")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_crud(spark):
    t, seen = table(spark), []
    end = t.subscribe(lambda d: seen.append(got(d)))
    t.add([{"id": 4, "name": "d", "v": 40}])
    t.update([{"id": 1, "name": None}])
    t.upsert([{"id": 2, "name": "b", "v": 20}, {"id": 9, "name": "z", "v": 9}])
    t.remove([3, 77])
    end()
    t.clear()
    assert seen == [[(4, "d", 40, 1)], [(1, "a", 10, -1), (1, None, 10, 1)], [(9, "z", 9, 1)], [(3, None, 30, -1)]]
    assert t.size() == 0 and not t.has(1)
    with pytest.raises(KeyError):
        table(spark).add([{"id": 1, "name": "x", "v": 0}])
    with pytest.raises(KeyError):
        table(spark).update([{"id": 8, "name": "x"}])


def test_apply_delta_is_canonical(spark):
    t = table(spark)
    delta = spark.createDataFrame([(1, "new", 5, 5), (2, "b", 20, -1)], f"id long, name string, v long, {W} long")
    assert got(t.apply_delta(delta)) == [(1, "a", 10, -1), (1, "new", 5, 1), (2, "b", 20, -1)]


def test_errors_do_not_stop_others(spark):
    t, seen = table(spark), []

    def broken(_):
        raise ValueError("mine")

    t.subscribe(broken)
    t.subscribe(lambda d: seen.append(1))
    with pytest.raises(ValueError):
        t.remove([1])
    assert seen == [1] and t.size() == 2


def test_view_follows_tables(spark):
    t = table(spark)
    view = create_query(t).where("v >= 20").group_by().aggregate(n=inc.count, s=("sum", "v")).reactive()
    seen = []
    view.subscribe(lambda df: seen.append(got(df)))
    t.add([{"id": 5, "name": "e", "v": 50}])
    t.remove([2])
    assert seen == [[(2, 50)], [(3, 100)], [(2, 80)]]
    view.close()
    with pytest.raises(ValueError):
        create_query(t).limit(3)


def test_live_view_is_idempotent(spark, tmp_path):
    fixed = weighted(spark.createDataFrame([(1, "x"), (2, "y")], "g long, name string"))
    plan = p.Aggregate((p.EquiJoin((p.Source((), "s"), p.Source((), "f")), ("g",), ("g",)),), ("name",), {}, {"n": inc.count})
    live = LiveView(plan, "s", {"f": fixed}, str(tmp_path / "live"))
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], f"id long, g long, {W} long")
    two = spark.createDataFrame([(1, 1, -1), (3, 2, 1)], f"id long, g long, {W} long")
    for batch, k in ((one, 0), (two, 1), (two, 1)):
        live.on_batch(batch, k)
    assert got(live.to_df()) == [("x", 1), ("y", 1)]


def test_streams_run(spark, tmp_path):
    schema = f"id long, g long, {W} long"
    spark.createDataFrame([(1, 1, 1), (2, None, 2)], schema).write.parquet(str(tmp_path / "in"))
    plan = p.Project((p.Source((), "s"),), ("g",))
    live = LiveView(plan, "s", {}, str(tmp_path / "state"))
    live.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert got(live.to_df()) == [(1,), (None,)]
    left, right = (spark.readStream.schema(schema).parquet(str(tmp_path / "in")) for _ in "lr")
    q = stream_join(left, right, ["g"], ["g"]).writeStream.format("memory").queryName("joined").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert sorted(r[W] for r in spark.sql("SELECT * FROM joined").collect()) == [1, 4]


def test_state_and_files(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.commit(spark.range(3))
    store.commit(spark.range(5), 0)
    assert store.read().count() == 3 and StateStore(spark, str(tmp_path / "s")).latest == 0
    log = weighted(spark.range(4), 1, F.col("id") % 2)
    write_changelog(log, str(tmp_path / "log"))
    assert read_changelog(spark, str(tmp_path / "log")).where("__t = 1").count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "x", "csv")


def test_closure_and_topk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    paths = transitive_closure(edges, StateStore(spark)).select("src", "dst")
    assert paths.count() == 10
    top = StatefulTopK(spark, [F.desc("v"), F.asc("id")], 2)
    z = lambda *x: spark.createDataFrame(list(x), f"id long, v long, {W} long")
    top.initialize(z((1, 1000, 1), (2, 800, 1), (3, 600, 1)))
    assert got(top.increment(z((4, 2000, 1)))) == [(2, 800, -1), (4, 2000, 1)]
    assert got(top.increment(z((4, 2000, -1)))) == [(2, 800, 1), (4, 2000, -1)]
    assert top.stats()["records"] == 3


@pytest.mark.parametrize("edges", [
    [(k, k // 2) for k in range(2, 80)],  # a tree, to the root and from it
    [(k // 2, k) for k in range(2, 80)],
    [(k, k + 1) for k in range(39)] + [(None, 5), (39, None)],  # a chain
    [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 6)],  # cycles with paths into them
    [(1, 2), (2, 1), (2, 3), (3, 4), (1, 4), (4, 5)],  # neither end is single
])
def test_closure_equals_search(spark, edges, monkeypatch):
    store, written = StateStore(spark), []
    commit = StateStore.commit
    monkeypatch.setattr(StateStore, "commit", lambda self, *x: written.append(self.path) or commit(self, *x))
    found = [tuple(x) for x in transitive_closure(spark.createDataFrame(edges, "src long, dst long"), store).select("src", "dst").collect()]
    want, before = set(edges), None
    while want != before:
        before, want = want, want | {(a, d) for a, b in want for c, d in edges if b == c and b is not None}
    assert len(found) == len(set(found)) and set(found) == want
    if len(edges) == 41:
        assert written.count(store.path) <= 8  # 40 edges in a row, but not as many rounds
