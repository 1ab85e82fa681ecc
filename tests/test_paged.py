"""Sources behind a cursor."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paged as P
from quillspark.streaming.streams import drained


def test_walk_follows_cursors_and_refuses_one_that_stays():
    pages = {None: ([1, 2], "a"), "a": ([3], "b"), "b": ([], "c"), "c": ([4], None)}
    assert list(P.walk(pages.__getitem__)) == [1, 2, 3, 4]
    for stuck in ({None: ([1], "a"), "a": ([2], "a")}, {None: ([1], "a"), "a": ([2], "b"), "b": ([3], "a")}):
        with pytest.raises(P.CursorError):
            list(P.walk(stuck.__getitem__))


def test_changes_back_to_the_watermark():
    feed = [(9, "x"), (8, "y"), (7, "x"), (5, "z"), (3, "w")]
    assert P.changed_since(feed, 5) == ({"x": 9, "y": 8}, 9, True)
    assert P.changed_since(feed, 9) == ({}, 9, True)
    assert P.changed_since(feed, 0) == ({"x": 9, "y": 8, "z": 5, "w": 3}, 9, False)  # the feed ends before it
    assert P.changed_since(feed, 3, limit=1) == ({"x": 9, "y": 8}, 9, False)
    assert P.changed_since([], 4) == ({}, 4, False)


def test_titles_of_seeds(spark, tmp_path):
    rows = [(f"s{i % 3}", f"t{i:03d}", i) for i in range(200)]
    path = P.answers(spark.createDataFrame(rows, "seed string, title string, n int"), str(tmp_path), ["n"], seed="seed", page_rows=7)
    got = P.titles(spark, path, ["s0", "s2", "missing"]).collect()
    assert sorted((r["seed"], r["title"]) for r in got) == sorted((s, t) for s, t, _ in rows if s != "s1")
    one = [r["title"] for r in P.walk(P.Answers(path, "s1"))]
    assert one == [t for s, t, _ in rows if s == "s1"]


def test_feed_in_batch_and_stream(spark, tmp_path):
    rows = [(i, f"t{i % 13}") for i in range(1, 900)]
    path = P.answers(spark.createDataFrame(rows, "rcid long, title string"), str(tmp_path), [F.desc("rcid")], page_rows=50)
    for watermark, limit in ((600, 5000), (600, 5), (0, 5000)):
        batch = sorted(map(tuple, P.changes(spark, path, watermark, limit).collect()))
        touched, newest, reached = P.changed_since(sorted(rows, reverse=True), watermark, limit)
        assert batch == sorted((t, r, newest, reached) for t, r in touched.items())
        assert sorted(map(tuple, drained(P.changes(spark, path, watermark, limit, stream=True), "feed-test").collect())) == batch
    reader = P._FeedStream({"path": path, "watermark": "880"})
    got, end = reader.read(reader.initialOffset())
    assert end == {"watermark": 899} and sorted(got) == sorted(reader.readBetweenOffsets({"watermark": 880}, end))
    assert list(reader.read(end)[0]) == []
