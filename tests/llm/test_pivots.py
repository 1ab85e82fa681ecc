import math

import numpy as np
import pytest

from quillspark.llm import pivots


def _brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({i: q for i, q in sorted(ok, reverse=True) if i % 50 == 0}.items()):
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def _got(df, **sizes):
    return sorted(map(tuple, pivots.top_scores(df, **sizes).select("query_id", "rank", "vec_id", "score").collect()))


def _rows(n=900, d=12):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (9, d))
    x = centres[rng.integers(0, 9, n)] + rng.normal(0, 0.1, (n, d))
    x *= rng.uniform(0.2, 1.5, n)[:, None]
    x[: n // 3] = x[0]
    return [(int(i), [float(np.float32(a)) for a in v]) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("sizes", [{}, {"first_rings": 1, "block_rows": 16, "ring_rows": 20, "pivots": 6, "fit_rows": 300}])
def test_against_brute_force(spark, sizes):
    rows = _rows()
    bad = [(None, rows[0][1]), (100_000, None), (100_100, []), (100_200, [float("nan")] * 12), (100_300, [None] * 12), (100_400, [float("inf")] + [0.0] * 11)]
    zero = [(100_500, [0.0] * 12), (50, rows[5][1]), rows[7]]
    df = spark.createDataFrame(rows + bad + zero, "vec_id long, embedding array<float>").selectExpr("*", "1 as ring", "2 as q", "3 as score")
    assert _got(df, **sizes) == _brute(rows + zero)


def test_few_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    assert _got(spark.createDataFrame([], schema)) == []
    assert _got(spark.createDataFrame([(0, [1.0, 2.0])], schema)) == []
    rows = [(0, [1e7, 2.0]), (1, [1e6, -3.0]), (2, [1e6, -3.0]), (50, [-1e6, 5.0])]
    assert _got(spark.createDataFrame(rows, schema)) == _brute(rows)
    assert _got(spark.createDataFrame([(0, [1e15]), (1, [1e15]), (2, [-1e15])], schema)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_bounds_hold_and_prune(spark):
    rows = [(i, v) for i, v in _rows() if i % 3]
    fitted = pivots.fit(pivots.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 256, "vec_id", "embedding"), ring_rows=20)
    keyed, rings = fitted
    held = {r["ring"]: [] for r in keyed.select("ring").distinct().collect()}
    for r in keyed.collect():
        held[r["ring"]].append(np.array(r["v"], float))
    for q in [np.array(v[0]) for v in list(held.values())[:10]]:
        order, bound = pivots.ring_order(rings, q)
        assert sorted(order) == sorted(held) and (np.diff(bound) >= 0).all()
        for ring, least in zip(order, bound, strict=True):
            near = min((q**2).sum() + rings.square - 2 * (q @ v) for v in held[ring])
            assert math.sqrt(max(near, 0)) >= least
        assert bound[-1] > 0
