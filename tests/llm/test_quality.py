import math
import random

import numpy as np

from quillspark.llm import quality


def _rows(rng, n, bad):
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 120))]
        is_bad = rng.random() < bad
        out.append((i, " ".join(w.upper() + "!!" if is_bad else w for w in words), not is_bad))
    return out


def test_held_out_accuracy(spark):
    rows = _rows(random.Random(1), 1500, 0.3)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (7, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(good)) for i, _, good in rows if i % 2] + [(None, 1)], "doc_id long, quality int")
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: good for i, _, good in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] != 7]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_prior_and_edges(spark):
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, (1500, 3)), rng.normal(-2, 1, (1500, 3))
    assert abs(quality.estimate_prior(p, np.concatenate([p[:900], n[:600]])) - 0.6) < 0.1
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.classified(docs, none).select("score", "predicted").collect()] == [(0.5, 1)]
    assert quality.classified(docs.filter("false"), none).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"a b\na b\n\nc", "é É | x!".encode(), b" \n ", b"one two three one two three"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = quality.features(data, off)
    assert together.shape[1] == quality.N_FEATURES
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], together[i])


def _slow_risk(fp, fu, prior):
    """Both terms in plain loops."""
    loss = lambda f: math.log(1 + math.exp(-f))
    positive = sum(prior * loss(f) for f in fp) / len(fp)
    negative = sum(loss(-f) for f in fu) / len(fu) - sum(prior * loss(-f) for f in fp) / len(fp)
    return positive, negative


def test_risk_against_plain_loops():
    rng = np.random.default_rng(2)
    turned = set()
    for _ in range(40):
        prior = float(rng.uniform(0.1, 0.9))
        fp, fu = rng.normal(rng.uniform(-2, 2), 1, 7), rng.normal(rng.uniform(-2, 2), 1, 9)
        want = _slow_risk(fp.tolist(), fu.tolist(), prior)
        assert np.allclose(quality.risk_parts(fp, fu, prior), want)
        turned.add(want[1] < 0)
        # The whole risk falls along the gradient, or, below zero, the second term rises.
        value = (lambda p, u: -_slow_risk(p, u, prior)[1]) if want[1] < 0 else (lambda p, u: sum(_slow_risk(p, u, prior)))
        gp, gu = quality.risk_gradients(fp, fu, prior)
        for k in range(7):
            step = 1e-6 * (np.arange(7) == k)
            assert abs((value((fp + step).tolist(), fu.tolist()) - value((fp - step).tolist(), fu.tolist())) / 2e-6 - gp[k]) < 1e-5
        for k in range(9):
            step = 1e-6 * (np.arange(9) == k)
            assert abs((value(fp.tolist(), (fu + step).tolist()) - value(fp.tolist(), (fu - step).tolist())) / 2e-6 - gu[k]) < 1e-5
    assert turned == {True, False}


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c")] * 3 + [(2, "A!! B!!"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pid", "2 as x", "3 as score", "4 as kind")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    got = quality.classified(docs, labels).collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == [0, 1, 1, 1, 2] and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
