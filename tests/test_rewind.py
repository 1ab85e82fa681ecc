"""Rewinds and the trust ledger."""

import pytest

from quillspark.operators import rewind as R
from quillspark.operators import trust as T
from quillspark.sources import store


def _world(spark):
    make = spark.createDataFrame
    return {
        "channel": make([(1, 9, 30, None), (2, 22, None, None), (3, 31, None, 5), (4, 42, None, None)], "id long, read_up_to long, segment long, deleted_at long"),
        "message": make(
            [(1, 1, "user", 10, None), (2, 1, "ann", 20, "p1"), (5, 1, "user", 50, "p2"), (6, 1, "ann", 60, None), (9, 1, "user", 90, None), (21, 2, "user", 15, "p3"), (22, 2, "bo", 55, None), (31, 3, "user", 1, None), (41, 4, "user", 70, None), (42, 4, "cid", 80, None), (50, None, "user", 99, None)],
            "id long, channel long, author string, ms long, picture string",
        ),
        "fact": make(
            [
                (1, "ann", "fact", 1, 20, False, False, "ann", None),
                (2, "ann", "fact", 1, 60, False, False, "ann", None),
                (3, "user", "fact", 1, 60, False, False, None, None),  # the user's own edit stays
                (4, "user", "hurt", 1, 60, False, False, "ann", -12.5),
                (5, "user", "hurt", 1, 61, False, True, "ann", -4.0),  # retracted: was given back already
                (6, "ann", "commitment", 1, 21, True, False, "ann", None),
                (7, "bo", "commitment", 2, 21, True, False, "bo", None),
                (8, "ann", "fact", None, 60, False, False, "ann", None),
            ],
            "id long, author string, kind string, channel long, created long, delivered boolean, retracted boolean, person string, trust_delta double",
        ),
        "seed": make(
            [(1, "memory", "2", None, None, None), (2, "memory", "1", None, None, None), (3, "words", "5", None, None, None), (4, "words", "1", None, None, None), (5, "visit", "x", 1, 6, 60), (6, "commitment", "6", 1, None, 60), (7, "commitment", "7", 2, None, 60), (8, "visit", "y", 1, None, 20)],
            "id long, kind string, ref string, channel long, message long, delivered_at long",
        ),
        "session": make([(1, 1, 5), (2, 1, 55), (3, 2, 55)], "id long, channel long, opened long"),
        "segment": make([(10, 1, 1, 5), (20, 1, 2, 25), (30, 1, 3, 55), (40, 2, 1, 60)], "id long, channel long, seq long, opened long"),
        "entry": make([(1, 10, 7), (2, 20, 30), (3, 20, 51), (4, 30, 60), (5, 40, 60), (6, None, 60)], "id long, segment long, ms long"),
        "summary": make([(1, 1, 20), (2, 1, 50), (3, 2, 60)], "id long, channel long, ms long"),
        "picture": make([("p1",), ("p2",), ("p3",), ("p4",)], "hash string"),
        "bond": make([("ann", 60.0), ("bo", 195.0)], "person string, trust double"),
    }


def _ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_everything_that_came_of_a_message_goes(spark, tmp_path):
    path = str(tmp_path / "world")
    R.commit_world(_world(spark), path)
    asked = spark.createDataFrame([(1, 5), (1, 9), (4, 41), (1, 6), (2, 5), (3, 31), (2, 999), (77, 1)], "channel long, message long")
    refused = {(r["channel"], r["message"]): r["why"] for r in R.rewind(spark, path, asked).collect()}
    assert refused == {(1, 6): "not the user's own", (2, 5): "not in the channel", (3, 31): "the channel is closed", (2, 999): "not in the channel", (77, 1): "the channel is closed"}
    _, version = store.read_corpus(spark, path)
    assert version.endswith("v000002")
    left = {name: spark.read.parquet(f"{version}/{name}") for name in _world(spark)}
    assert _ids(left["message"]) == [1, 2, 21, 22, 31, 50]
    assert _ids(left["fact"]) == [1, 3, 6, 7, 8]
    assert {r["id"]: r["delivered"] for r in left["fact"].filter("kind = 'commitment'").collect()} == {6: False, 7: True}
    assert _ids(left["seed"]) == [2, 4, 7, 8]
    assert _ids(left["session"]) == [1, 3] and _ids(left["segment"]) == [10, 20, 40] and _ids(left["entry"]) == [1, 2, 5, 6] and _ids(left["summary"]) == [1, 3]
    assert _ids(left["picture"], "hash") == ["p1", "p3"]
    assert {r["person"]: r["trust"] for r in left["bond"].collect()} == {"ann": 72.5, "bo": 195.0}
    assert {r["id"]: (r["read_up_to"], r["segment"]) for r in left["channel"].collect()} == {1: (2, 20), 2: (22, None), 3: (31, None), 4: (None, None)}


def test_nothing_to_take_back_makes_no_version(spark, tmp_path):
    path = str(tmp_path / "world")
    R.commit_world(_world(spark), path)
    R.rewind(spark, path, spark.createDataFrame([(1, 6)], "channel long, message long"))
    assert store.read_corpus(spark, path)[1].endswith("v000001")
    assert R.rewound(_world(spark), spark.createDataFrame([], "channel long, message long"))["seed"].count() == 8


def test_a_failure_between_tables_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "world")
    R.commit_world(_world(spark), path)
    broken = _world(spark)
    broken["session"] = broken["session"].selectExpr("id", "channel", "if(id = 2, raise_error('lost'), opened) as opened")
    with pytest.raises(Exception, match="lost"):
        R.commit_world(broken, path)
    _, version = store.read_corpus(spark, path)
    assert version.endswith("v000001") and spark.read.parquet(f"{version}/message").count() == 11
    R.rewind(spark, path, spark.createDataFrame([(1, 1)], "channel long, message long"))
    assert spark.read.parquet(f"{store.read_corpus(spark, path)[1]}/message").filter("channel = 1").count() == 0


def _plain(steps):
    out, state = [], {}
    for key, ms, i, step, ref in sorted(steps, key=lambda x: (str(x[0]), x[1], x[2])):
        trust, deltas, undone = state.get(key, (50.0, {}, set()))
        after = trust
        if step == "grow":
            after = min(200.0, trust + 0.5 * (1 if trust <= 100 else max(0, 1 - ((trust - 100) / 100) ** 2)))
        elif step == "hurt":
            after = max(0.0, trust - 15 * (0.5 + trust / 200))
            deltas[i] = after - trust
        elif step == "undo" and ref in deltas and ref not in undone:
            after = min(200.0, trust - deltas[ref])
            undone.add(ref)
        elif step == "redo" and ref in undone:
            after = max(0.0, trust + deltas[ref])
            deltas[ref] = after - trust
            undone.remove(ref)
        state[key] = (after, deltas, undone)
        out.append((key, ms, i, step, trust, after))
    return out


def test_ledger_takes_back_what_a_step_took(spark):
    steps = [("a", 1, 1, "hurt", None), ("a", 2, 2, "hurt", None), ("a", 3, 3, "undo", 1), ("a", 3, 4, "undo", 1), ("a", 4, 5, "redo", 1), ("a", 5, 6, "redo", 1), ("a", 6, 7, "undo", 99), ("a", 7, 8, "grow", None), ("a", 8, 9, "rest", None)]
    steps += [("b", i, i, "grow", None) for i in range(400)] + [("b", 500, 500, "hurt", None), ("b", 501, 501, "undo", 500)]
    steps += [("c", i, i, "hurt", None) for i in range(9)] + [(None, 1, 1, "grow", None)]
    df = spark.createDataFrame(steps, "who string, ms long, id long, step string, ref long").repartition(4)
    ledger = T.trust_ledger(df, "who")
    got = sorted(map(tuple, ledger.collect()), key=lambda x: (str(x[0]), x[1], x[2]))
    assert got == _plain(steps)
    by_id = {(r[0], r[2]): r for r in got}
    assert by_id["b", 501][5] == pytest.approx(by_id["b", 500][4])  # the value before the hurt
    assert {r["who"]: r["trust"] for r in T.trust_now(ledger, "who").collect()}[None] == 50.5
