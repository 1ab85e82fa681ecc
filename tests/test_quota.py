"""Quota history: the batch form against a plain loop, the stream against the batch form."""

import random

import pytest

from quillspark.operators import world as W
from quillspark.streaming import streams as S

HOUR = 3_600_000


def _plain(rows, limit, quiet):
    out = []
    for key, ms in sorted({(k, m) for k, m, c in rows if c > 0}):
        hour = sorted((m, c) for k, m, c in rows if k == key and c > 0 and ms - HOUR < m <= ms)
        used = sum(c for _, c in hour)
        band = "exhausted" if used >= limit else "quiet" if used >= quiet else "open"
        release, left = None, used
        if band != "open":
            for m, c in hour:
                left -= c
                if left < (limit if band == "exhausted" else quiet):
                    release = m + HOUR
                    break
        out.append((key, ms, used, band, release))
    return out


def _rows(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, 10 * 3600) * 1000, rng.choice([0, 1, 2, 5])) for _ in range(n)]


@pytest.mark.parametrize("seed,limit,quiet", [(1, 40, 30), (2, 20, 1), (3, 10_000, 9000), (4, 15, 15)])
def test_history_of_an_hour(spark, seed, limit, quiet):
    rows = _rows(seed) + [("a", 7_200_000, 3), ("a", 7_200_000, 3), ("a", 3_600_000, 1), ("a", 3_600_001, 1)]
    got = W.quota_history(spark.createDataFrame(rows, "shape string, ms long, cost long"), ["shape"], limit, quiet)
    assert sorted(map(tuple, got.select("shape", "ms", "used", "band", "release").collect())) == _plain(rows, limit, quiet)


def test_marks_and_empty_input(spark):
    empty = spark.createDataFrame([], "shape string, ms long, cost long")
    assert W.quota_history(empty, ["shape"], 5, 5).count() == 0
    with pytest.raises(ValueError):
        W.quota_history(empty, ["shape"], 5, 0)


def test_stream_in_several_batches_with_late_rows(spark, tmp_path):
    minute = 60_000
    first = [("a", m * minute, 2) for m in range(7, 120, 7)] + [("b", 30 * minute, 9)]
    second = [("a", 113 * minute, 4), ("a", 125 * minute, 1)]  # late but in time; in order
    third = [("a", 240 * minute, 1), ("a", 40 * minute, 100), ("b", 241 * minute, 3)]  # the second is too late
    fourth = [("c", 300 * minute, 1)]
    for n, rows in enumerate([first, second, third, fourth]):
        made = spark.createDataFrame([(k, m, c) for k, m, c in rows], "shape string, ms long, cost long").selectExpr("*", "timestamp_millis(ms) as at")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/batch={n}"))
    schema = "shape string, ms long, cost long, at timestamp"
    stream = S.tail(spark, str(tmp_path / "in"), schema, files_per_trigger=1).select("at", "shape", "ms", "cost")
    made = S.drained(S.quota_history(stream, ["shape"], 12, 6), "quota-test")
    got = sorted(map(tuple, made.select("shape", "ms", "used", "band", "release").collect()))
    kept = [r for r in first + second + third + fourth if r[2] != 100]
    # What is less than ten minutes behind the newest row still waits.
    assert got == [r for r in _plain(kept, 12, 6) if r[1] <= 290 * minute]


def test_stream_state_is_keyed_by_hour_with_one_timer(spark, tmp_path):
    # Hours meet at their edges, come in several batches and are asked for again after their state has gone.
    rows = sorted(_rows(7, 400) + [("a", HOUR * h + d, 2) for h in range(1, 10) for d in (-1, 0, 1)], key=lambda r: r[1])
    batches = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    for n, part in enumerate(batches):
        made = spark.createDataFrame(part, "shape string, ms long, cost long").selectExpr("*", "timestamp_millis(ms) as at")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/batch={n}"))
    stream = S.tail(spark, str(tmp_path / "in"), "shape string, ms long, cost long, at timestamp", files_per_trigger=1).select("at", "shape", "ms", "cost")
    made = S.drained(S.quota_history(stream, ["shape"], 40, 15), "quota-hours")
    until = max(r[1] for r in rows) - 600_000
    assert sorted(map(tuple, made.select("shape", "ms", "used", "band", "release").collect())) == [r for r in _plain(rows, 40, 15) if r[1] <= until]
    ms, cost = S._by_instant([([HOUR, 0], [1, 2]), ([HOUR], [4])])
    assert (ms.tolist(), cost.tolist()) == ([0, HOUR], [2, 5]) and len(S._by_instant([])[0]) == 0
    with pytest.raises(ValueError):
        S.quota_history(stream, ["shape"], 5, 0)
