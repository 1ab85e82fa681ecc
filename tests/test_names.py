"""Names within lines, and wrap-ups, against brute force."""

import random
import re

import pytest

from quillspark.operators import names as N
from quillspark.operators import wrapup as U


def _lines():
    rng = random.Random(2)
    words = ["ann", "annabel", "bo", "cid", "漢字", "é", "x", "Bob", "an", "nab"]
    lines = [(rng.randint(1, 6), i, " ".join(rng.choice(words) for _ in range(4))) for i in range(300)]
    lines += [(7, 1000 + i, "Bob again") for i in range(200)] + [(1, 2000, None), (None, 2001, "ann"), (9, 2002, "")]
    names = [(1, "ann"), (1, "nnab"), (2, "bo"), (3, "字"), (3, "漢字"), (4, "x"), (5, "ann"), (6, "b c"), (7, "Bo"), (7, "Bo"), (8, "zz"), (None, "ann"), (2, None)]
    return lines, names


@pytest.mark.parametrize("sizes", [{}, {"piece_bytes": 40, "part_bytes": 300}])
def test_lines_with_their_speakers_names(spark, sizes):
    lines, names = _lines()
    rows = spark.createDataFrame(lines, "who int, k int, said string")
    known = spark.createDataFrame(names, "who int, name string").selectExpr("*", "'x' as said")
    own = {}
    for who, name in names:
        if who is not None and name is not None and len(name) >= 2:
            own.setdefault(who, set()).add(name)
    want = sorted((who, k) for who, k, said in lines if said and any(x in said for x in own.get(who, ())))
    assert sorted(map(tuple, N.own_name_lines(rows, known, "who", "name", "k", "said", **sizes).collect())) == want
    leaks = {r["who"]: (r["leaks"], r["n"]) for r in N.name_leaks(rows, known, "who", "name", "k", "said", 2, **sizes).collect()}
    assert leaks[7] == (200, 200) and leaks[4][0] == 0 and 9 not in leaks and None not in leaks


def test_no_names_and_no_lines(spark):
    lines, names = _lines()
    rows, known = spark.createDataFrame(lines, "who int, k int, said string"), spark.createDataFrame(names, "who int, name string")
    assert N.own_name_lines(rows, known.limit(0), "who", "name", "k", "said").count() == 0
    nothing = N.name_leaks(rows.limit(0), known, "who", "name", "k", "said")
    assert nothing.count() == 0 and N.leak_share(nothing).first()["share"] is None


def _pairs(text):
    plain = re.sub(r"[\W_]", "", text or "").lower()
    return plain, {plain[i : i + 2] for i in range(len(plain) - 1)}


def _brute(held, proposed):
    out, worlds = {}, {r[0] for r in [*held, *proposed]}
    for world in worlds:
        there = [r for r in held if r[0] == world]
        written = {}
        for r in sorted((r for r in proposed if r[0] == world), key=lambda r: (r[1], r[2])):
            _, _, i, author, kind, audience, about, due, text, wrap = r
            plain, own = _pairs(text)
            near = [x[2] for x in there if x[4] == kind == "fact" and x[3] == author and x[6] == about and not (len(x) == 10 and x[9] is True) and own | _pairs(x[8])[1] and len(own & _pairs(x[8])[1]) * 100 // len(own | _pairs(x[8])[1]) >= 45]
            same = [x[2] for x in there if x[4] == kind and x[5] == audience and _pairs(x[8])[0] == plain]
            if not plain:
                got = ("empty", None)
            elif written.get(wrap, 0) >= 2:
                got = ("over_limit", None)
            elif kind == "commitment" and due is None:
                got = ("no_due", None)
            elif near:
                got = ("similar", min(near))
            elif same:
                got = ("duplicate", min(same))
            else:
                got = ("written", None)
                written[wrap] = written.get(wrap, 0) + 1
                there.append((*r[:9], False))
            out[i] = got
    return out


def test_wrap_ups(spark):
    rng = random.Random(5)
    stems = ["likes tea in the morning", "likes tea in the evening", "has a grey cat", "has a grey dog", "went to the sea", "Likes TEA, in the morning!", "", "?!", None, "a", "ab"]
    held = [(w, 0, w * 1000 + i, rng.choice(["a", None]), "fact", "here", None, None, rng.choice(stems), rng.random() < 0.5) for w in range(6) for i in range(3)]
    proposed = []
    for w in range(6):
        for i in range(60):
            kind = rng.choice(["fact", "fact", "commitment"])
            proposed.append((w, i // 3, w * 1000 + 100 + i, rng.choice(["a", "b", None]), kind, rng.choice(["here", None]), rng.choice(["user", None]), rng.choice([None, 5]), rng.choice(stems), i // 6))
    schema = "world int, ms int, id long, author string, kind string, audience string, about string, due int, text string"
    out = U.wrap_up(spark.createDataFrame(held, f"{schema}, retracted boolean"), spark.createDataFrame(proposed, f"{schema}, wrap int"))
    got = {r["id"]: (r["outcome"], r["existing"]) for r in out.collect()}
    want = _brute(held, proposed)
    assert got == want
    assert {"written", "empty", "over_limit", "no_due", "similar", "duplicate"} == {x for x, _ in want.values()}


@pytest.mark.parametrize("percent", [30, 45, 80])
def test_similar_sets(spark, percent):
    rng = random.Random(percent)
    sets = [(i, i % 3 or None, sorted(rng.sample("abcdefghijkl", rng.randint(0, 9)))) for i in range(150)]
    got = sorted(map(tuple, U.similar_sets(spark.createDataFrame(sets, "id long, g int, items array<string>"), ["g"], "id", "items", percent).collect()))
    want = [(i, j) for i, g, x in sets for j, h, y in sets if i < j and g == h and x and y and len(set(x) & set(y)) * 100 >= percent * len(set(x) | set(y))]
    assert got == sorted(want)
