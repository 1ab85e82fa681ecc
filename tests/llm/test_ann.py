import math

import numpy as np

from quillspark.llm import ann


def _brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
    return out


def _rows(n=3000, d=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, d))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.4, (n, d))
    x[: n // 3] = x[0]
    return [(int(i), [float(np.float32(a)) for a in v]) for i, v in zip(rng.permutation(n), x, strict=True)]


def test_recall_ties_and_scores(spark):
    rows = _rows()
    bad = [(None, rows[0][1]), (100_000, None), (100_100, [0.0] * 16), (100_200, [float("nan")] * 16), (100_300, [None] * 16), (100_400, [float("inf")] + [0.0] * 15), (100_500, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as leaf", "2 as q")
    got: dict = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = _brute(rows)
    assert got.keys() == want.keys()
    vectors = {i: np.array(v) for i, v in rows}
    hits = total = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        found = [got[q][n] for n in range(1, 11)]
        assert found == sorted(found)
        assert all(s == float(np.sqrt(((vectors[j] - vectors[q]) ** 2).sum())) for s, j in found)
        hits += len(set(found) & set(best))
        total += len(best)
    assert hits / total >= 0.95


def test_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0]), (200, [4.0, 6.0])], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 3, 0.0), (0, 2, 5, 0.0), (0, 3, 200, 5.0), (200, 1, 0, 5.0), (200, 2, 3, 5.0), (200, 3, 5, 5.0)]
