"""Migration ladder and accepted baselines."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import guards as G
from quillspark.sources import ladder as L
from quillspark.sources import store


def _steps(broken=()):
    def doubled(t):
        return {**t, "a": t["a"].withColumn("x", F.col("x") * 2)}

    def added(t):
        return {**t, "a": t["a"].withColumn("y", F.raise_error(F.lit("lost")) if 3 in broken else F.lit("new"))}

    return [L.Step(3, "a has y", added), L.Step(2, "x doubles", doubled), L.Step(4, "x doubles again", doubled)]


def _world(spark, path):
    L.write_world({"a": spark.createDataFrame([(1,), (2,)], "x long"), "old": spark.createDataFrame([(1,)], "z int")}, path, 1)


def test_steps_go_in_order_and_once(spark, tmp_path):
    path = str(tmp_path / "w")
    _world(spark, path)
    assert L.pending(2, _steps()) == ["layout 2 -> 3: a has y", "layout 3 -> 4: x doubles again"]
    assert len(L.climb(spark, path, _steps())) == 3
    tables, manifest = L.read_world(spark, path)
    assert manifest["layout"] == 4 and sorted(map(tuple, tables["a"].collect())) == [(4, "new"), (8, "new")]
    assert L.climb(spark, path, _steps()) == [] and store.read_corpus(spark, path)[1].endswith("v000004")
    with pytest.raises(ValueError, match="missing or double"):
        L.climb(spark, path, [*_steps(), L.Step(6, "", lambda t: t)])


def test_a_failed_step_is_where_the_next_run_goes_on(spark, tmp_path):
    path = str(tmp_path / "w")
    _world(spark, path)
    with pytest.raises(Exception, match="lost"):
        L.climb(spark, path, _steps(broken={3}))
    tables, manifest = L.read_world(spark, path)
    assert manifest["layout"] == 2 and sorted(r["x"] for r in tables["a"].collect()) == [2, 4]
    L.climb(spark, path, _steps())
    tables, manifest = L.read_world(spark, path)
    assert manifest["layout"] == 4 and sorted(r["x"] for r in tables["a"].collect()) == [4, 8]


def test_policy(spark):
    tables = {
        "s": spark.createDataFrame([("tone", 1, "x"), ("lost", 2, "y"), ("lost", 3, None), (None, 4, None)], "key string, v int, more string"),
        "log": spark.createDataFrame([(1,), (2,)], "id long"),
        "old": spark.createDataFrame([(1,)], "z int"),
        "empty": spark.createDataFrame([], "z int"),
    }
    layout = L.Layout({"s": {"key": ("string", ""), "v": ("long", 0), "w": ("string", "d")}, "log": {"id": ("long", 0)}, "fresh": {"k": ("int", 0)}}, {"s": ("tone", "pace")}, ("log",))
    out, gone = L.keep(tables, layout)
    assert [tuple(r) for r in out["s"].collect()] == [("tone", 1, "d")] and out["log"].count() == 0 and out["fresh"].count() == 0 and sorted(out) == ["fresh", "log", "s"]
    assert {tuple(r) for r in gone.collect()} == {("table", "old", 1), ("s key", "lost", 2), ("s key", None, 1), ("emptied", "log", 2)}


def test_baseline(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id long")
    first = G.measured(F.max("id"), seeds=rows(["a", "a", "b", "c"]), identity=rows(["p"]))
    assert G.accepted(spark, path) is None
    assert {tuple(r) for r in G.against_baseline(first, None).collect()} == {("seeds", None, None, None, "low"), ("identity", None, None, None, "low")}
    G.accept(first, path)
    assert G.against_baseline(first, G.accepted(spark, path)).count() == 0
    now = G.measured(F.max("id"), seeds=rows(["a", "b", "b", "d"]), identity=rows(["p"]))
    assert {tuple(r) for r in G.against_baseline(now, G.accepted(spark, path)).collect()} == {("seeds", "a", 1, 2, "high"), ("seeds", "b", 2, 1, "low"), ("seeds", "c", 0, 1, "high"), ("seeds", "d", 1, None, "low")}
    G.accept(now, path)
    assert G.against_baseline(now, G.accepted(spark, path)).count() == 0
    assert now.filter("part = 'meta'").first()["n"] == 3
