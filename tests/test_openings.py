"""Opening plans and time away."""

from quillspark.operators import openings as O
from quillspark.operators import world as W

HOUR, DAY = 3_600_000, 86_400_000
FREE = {"presence": True, "away": False, "open": True, "quiet": False, "talking": False, "spent": 0, "part": 0, "come": True}


def _one(candidates, opened=(), last=None, ms=10 * HOUR, limits=None, **conditions):
    row = {**FREE, **conditions, "ms": ms, "candidates": candidates}
    return O.planned(row, list(opened), last, limits or O.Limits())


def _c(person, channel=1, grp=False):
    return {"person": person, "channel": channel, "grp": grp}


def test_each_condition_in_its_order():
    every = {"away": True, "candidates": None, "open": False, "quiet": True, "talking": True, "spent": 3}
    left = dict(every)
    for name, outcome in (("away", "away"), ("candidates", "no_seed"), ("open", "quota"), ("quiet", "quiet_hours"), ("talking", "in_conversation"), ("spent", "daily_total")):
        assert _one(left.get("candidates", [_c(1)]), **{k: v for k, v in left.items() if k != "candidates"}) == (outcome, None)
        del left[name]
    assert _one([_c(1)], last=10 * HOUR - 1) == ("too_soon", None)
    assert _one([_c(1)], last=10 * HOUR - 1, presence=False) == ("open", _c(1))
    assert _one([_c(1)], come=False) == ("not_yet", None)
    assert _one([_c(1)]) == ("open", _c(1))


def test_places_of_a_part_and_shares_of_a_day():
    direct, group = (0, 7, 1, False), (0, 8, 2, True)
    assert _one([_c(1)], [direct, group], last=0)[0] == "not_yet"
    assert _one([_c(1), _c(2, 3, True)], [direct], last=0) == ("open", _c(2, 3, True))  # the direct one waits
    assert _one([_c(1)], [direct], last=0) == ("not_yet", None)
    assert _one([_c(1)], [direct], last=0, part=1) == ("open", _c(1))
    assert _one([_c(7)], [direct], last=0, part=1) == ("per_person", None)
    assert _one([_c(8, 2, True)], [group], last=0, part=1) == ("per_person", None) and _one([_c(8, 9, True)], [group], last=0, part=1)[0] == "open"
    assert _one([_c(8)], [group], last=0)[0] == "open"  # a word in a group is no opening of his own
    assert _one([_c(7), _c(1)], [direct], last=0, limits=O.Limits(per_person=2), part=1) == ("open", _c(7))


def test_days_and_users_are_folded_apart(spark):
    rows = []
    for user in ("a", "b", None):
        for n in range(12):
            rows.append((user, n * 6 * HOUR, n, *[FREE[k] for k in ("presence", "away", "open", "quiet", "talking", "spent")], n % 4, True, [(n % 2, 1, False)]))
    df = spark.createDataFrame(rows, "user string, ms long, id long, presence boolean, away boolean, open boolean, quiet boolean, talking boolean, spent int, part int, come boolean, candidates array<struct<person:long,channel:long,grp:boolean>>").repartition(5)
    got = {(r["user"], r["id"]): (r["outcome"], r["person"]) for r in O.opening_plan(df, "user").collect()}
    want = [("open", 0), ("open", 1), ("per_person", None), ("per_person", None)] * 3
    assert got == {(u, n): want[n] for u in ("a", "b", None) for n in range(12)}


def test_time_away(spark):
    day = 19_700 * DAY
    stays = spark.createDataFrame([("a", day + HOUR, day + 20 * HOUR), ("a", day + 23 * HOUR, day + DAY + 12 * HOUR), ("b", day, day + 1)], "who string, since long, until long")
    due = spark.createDataFrame([("a", day + HOUR, True), ("a", day + HOUR + 1, True), ("a", day + 20 * HOUR, False), ("a", day + 21 * HOUR, False), ("b", day + 5, True)], "who string, due long, own boolean")
    got = {(r["who"], r["since"] - day): (r["slots"], r["kept"], r["lapsed"]) for r in W.away_settled(stays, due, "who", 240, 6, 3).collect()}
    assert {k: v[1:] for k, v in got.items()} == {("a", HOUR): (1, 1), ("a", 23 * HOUR): (0, 0), ("b", 0): (0, 0)}
    # Of six slots of four hours, those of the whole parts between have come for certain.
    assert 3 <= got["a", HOUR][0] <= 6 and 2 <= got["a", 23 * HOUR][0] <= 4
