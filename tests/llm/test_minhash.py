import random

import numpy as np

from quillspark.llm.graph import components
from quillspark.llm.minhash import fast_sketches, near_duplicates

from . import brute


def _result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 5, 6, 40, 80, 200)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 6) if len(words) > 20 else 0):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        rows.append((i * 3, text.upper() if rng.random() < 0.2 else text))
    rows += [(None, rows[0][1]), (None, None), (1, None), (2, ""), (4, " \n"), rows[5], rows[9]]
    assert _result(spark, rows) == sorted(brute.near(rows), key=repr)


def _words(name, n=60):
    return [f"{name}{i}" for i in range(n)]


def test_several_texts_under_one_id(spark):
    a, b, c = (" ".join(_words(x)) for x in "abc")
    near_a, near_b = (" ".join([*_words(x)[:-1], "changed"]) for x in "ab")
    one = [(1, a), (2, b), (3, c), (9, a), (9, b), (9, c)]
    two = [(5, a), (5, b), (7, near_a), (8, near_b)]
    both = [(0, c), (0, near_b), (4, near_a), (4, near_b), (6, a), (6, c)]
    for rows in (one, two, both, [*two, *two], [(i, t) for i in (3, 3, 1) for t in (a, b, near_a)]):
        assert _result(spark, rows) == sorted(brute.near(rows), key=repr)
    rng = random.Random(9)
    texts = [" ".join([*_words(x, 30)[:k], *_words("z", 2), *_words(x, 30)[k:]]) for x in "abcdef" for k in range(0, 30, 3)]
    rows = [(rng.randint(0, 40), rng.choice(texts)) for _ in range(90)]
    assert _result(spark, rows) == sorted(brute.near(rows), key=repr)


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(_words("long", 60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, "Short  TEXT")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as did", "2 as th", "3 as n", "4 as rep", "5 as component", "6 as key", "7 as lo")
    got = sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == [(1, 59_996, 1, True), (2, 59_997, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_empty(spark):
    assert _result(spark, []) == []
    assert _result(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    s = fast_sketches([np.unique(a), np.unique(b), a[:1], a[:0]], 256)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (5, 5), (None, 3)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
