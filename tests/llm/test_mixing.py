import math
import random
from collections import Counter, defaultdict

import duckdb

from quillspark.llm import mixing


def _docs(spark, n=400):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(None, None, "a"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (None, "", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_matches_sql(spark):
    rows, df = _docs(spark)
    documents = df.toPandas()  # noqa: F841
    want = sorted(duckdb.sql("with d as (select 1) select * from (" + mixing.ORACLE.replace("FROM documents", "FROM (select doc_id::BIGINT doc_id, text, source from documents)") + ")").fetchall(), key=repr)
    got = sorted((tuple(r) for r in mixing.mixed(df).collect()), key=repr)
    assert got == want


def test_deviation_is_below_one_block(spark):
    rows, df = _docs(spark, 3000)
    for weights in (None, {"a": 5, "b": 3, "c": 1}):
        got = mixing.mixed(df, weights, block_bytes=2000, period=50).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
        slots, share, last = {}, {}, defaultdict(int)
        for r in got:
            slots.setdefault(r["slot"], r["source"])
            assert slots[r["slot"]] == r["source"]
            share[r["source"]] = r["share"]
            last[r["source"]] = max(last[r["source"]], r["slot"])
        period = sum(share.values())
        had = Counter()
        for t in range(min(last.values())):
            had[slots.get(t)] += 1
            for s, n in share.items():
                assert abs(had[s] - (t + 1) * n / period) < 1


def test_native_and_edges(spark):
    _, df = _docs(spark)
    out = mixing.mixed(df.selectExpr("*", "1 as skey", "2 as block", "3 as n"))
    assert out.count() == df.count()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mixed(df.filter("false")).count() == 0


def test_given_weights_are_exact(spark):
    """Measured against the weights as given, not against the shares that come out."""
    rows = [(i, "x" * 99, "a" if i % 2 else "b") for i in range(40)] + [(100 + i, "x" * 99, "c") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 7, "b": 700, "c": 3003}
    got = mixing.mixed(df, weights, block_bytes=100).collect()
    total = sum(weights.values())
    place = {(r["source"], r["block"]): r["slot"] for r in got}
    for (source, block), slot in place.items():
        # In its slot a block is released, and not past its deadline.
        assert block * total // weights[source] <= slot < -(-(block + 1) * total // weights[source])
    assert {r["source"]: r["share"] for r in got} == {"a": 1, "b": 100, "c": 429}
    one = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    assert {r["source"]: r["share"] for r in mixing.mixed(one, {"a": 1, "b": 9999}).collect()} == {"a": 1, "b": 9999}


def test_many_sources_keep_their_targets(spark):
    rows = [(i, "x" * 40_000, "big") for i in range(20)] + [(100 + i, "x" * 500, f"s{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = {r["source"]: r["share"] for r in mixing.mixed(df).collect()}
    roots = {"big": math.isqrt(20 * 40_001)} | {f"s{i}": math.isqrt(501) for i in range(300)}
    total, period = sum(roots.values()), sum(share.values())
    assert all(abs(share[s] - max(1, r / total * mixing.SOURCE_SLOTS * 301)) <= 1 for s, r in roots.items())
    assert abs(share["big"] / period - roots["big"] / total) < 0.01


def test_one_large_source_beside_thousands(spark):
    for small in (500, 1000, 2000, 6000):
        rows = [("s:big", (small * 40) ** 2)] + [(f"s:{i}", 40**2) for i in range(small)]
        share = {r["skey"]: r["n"] / r["period"] for r in mixing.shares(spark.createDataFrame(rows, "skey string, bytes long"), None, mixing.PERIOD).collect()}
        assert abs(share["s:big"] - 0.5) < 0.001 and max(abs(share[f"s:{i}"] * 2 * small - 1) for i in range(small)) < 0.1


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, "a"), (2, "y", "a"), (3, "z", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["block"], r["block_offset"], r["n_bytes"]) for r in mixing.mixed(df).collect()}
    assert got[1][2] == 3_000_001 and sorted(got) == [1, 2, 3]
