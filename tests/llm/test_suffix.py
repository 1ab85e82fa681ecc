import random

from pyspark.sql import functions as F

from quillspark.llm import suffix
from quillspark.llm.suffix import remove_repeated_bytes

from . import brute


def _result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as did", "2 as node", "3 as spans")
    out = remove_repeated_bytes(df, **kw)
    total = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]), F.lit(0))
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", total, F.size("spans"), F.sha2("kept", 256)).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghé ") for _ in range(rng.randint(150, 900))) for _ in range(10)] + ["a" * 700, "ab" * 300]
    rows = []
    for i in range(90):
        text = ""
        while rng.random() < 0.7:
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            text += b[a : a + rng.randint(0, 500)]
            if rng.random() < 0.4:
                text += rng.choice("xyzü")
        rows.append((i, text))
    rows += [(None, rows[3][1]), (None, None), (7, ""), (8, "short"), rows[5], (200, rows[6][1][1:])]
    assert _result(spark, rows) == sorted(brute.byte_repeats(rows), key=repr)
    assert _result(spark, rows, window=70, k=16) == sorted(brute.byte_repeats(rows, 70), key=repr)


def test_hot_cores(spark, monkeypatch):
    """One core before many ends and after many heads: its key is split into windows."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, tails = word(185), [word(60) for _ in range(12)]
    rows = [(i, word(30) + core + rng.choice(tails)[: rng.randint(5, 60)] + word(40)) for i in range(80)]
    want = sorted(brute.byte_repeats(rows), key=repr)
    assert sum(r[2] for r in want) > 0
    asked = []
    counted = suffix._counted_windows
    monkeypatch.setattr(suffix, "_counted_windows", lambda *a: (asked.append(1), counted(*a))[1])
    assert _result(spark, rows) == want and not asked
    monkeypatch.setattr(suffix.repeated_byte_spans, "__defaults__", (suffix.WINDOW, suffix.MINIMISER, 2000))
    assert _result(spark, rows) == want and asked


def test_edges(spark):
    assert _result(spark, []) == []
    rng = random.Random(1)
    lone = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, lone + lone[100:400]), (2, "q" * 199), (3, "q" * 199)]
    assert _result(spark, rows) == sorted(brute.byte_repeats(rows), key=repr)


def test_many_equal_rows(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    rows = [(1, text)] * 600 + [(2, "short")] * 600 + [(3, "x" + text[300:600])]
    out = suffix.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])): r["n"] for r in out.groupBy("doc_id", "n_bytes", "kept", "spans").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 900, b"", 1): 600, (2, 5, b"short", 0): 600, (3, 301, b"x", 1): 1}
