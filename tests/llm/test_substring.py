import random

from quillspark.llm.substring import remove_repeated_spans, unitigs, word_paths
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import brute


def _result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeated_spans(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 160))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        while rng.random() < 0.8:
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            words += b[a : a + rng.randint(0, 90)]
            if rng.random() < 0.5:
                words.append(rng.choice(vocabulary))
        rows.append((rng.randint(0, 50), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(None, rows[3][1]), (None, None), (7, None), (8, ""), (9, " \n"), rows[5], rows[5]]
    for window, k in ((50, 10), (12, 5)):
        assert _result(spark, rows, window=window, k=k) == sorted(brute.substring(rows, window), key=repr)


def test_edges(spark):
    assert _result(spark, []) == []
    one = " ".join(map(str, range(50)))
    assert _result(spark, [(1, one), (2, one), (3, one[:-3])]) == sorted(brute.substring([(1, one), (2, one), (3, one[:-3])]), key=repr)
    long = " ".join(str(i * i % 977) for i in range(60_000))
    rows = [(1, long), (2, "x " + long[1000:90000])]
    assert _result(spark, rows) == sorted(brute.substring(rows), key=repr)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "z", None)], "doc_id long, text string, did long, th string, start int")
    assert remove_repeated_spans(df).count() == 1


def test_unitigs(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    text = " ".join(words)

    def chains(rows):
        paths = word_paths(spark.createDataFrame(rows, "did long, th long, text string"), 50, 10).cache()
        low = F.min("did").over(Window.partitionBy("node"))
        times = F.count("*").over(Window.partitionBy("node"))
        same = (F.count("before").over(Window.partitionBy("node")) == times) & (F.min("before").over(Window.partitionBy("node")) == F.max("before").over(Window.partitionBy("node")))
        plain = paths.select("did", "th", "start", "n", "node", "path", low.alias("low"), times.alias("times"), F.when(same, F.col("before")).alias("before"))
        return paths.count(), sorted(r["n"] for r in unitigs(plain).collect())

    # Two equal documents are one nonbranching chain; a third that begins with another chain splits it.
    assert chains([(1, 1, text), (2, 1, text)])[1] == [2951]
    n, found = chains([(1, 1, text), (2, 1, text), (3, 2, " ".join(words[1000:2000]))])
    assert sum(found) >= 2951 and len(found) <= 5 < n
    # Equal counts alone are no degree: one ends a text, the other begins one.
    halves = [(1, 1, text), (2, 2, " ".join(words[:1500])), (3, 3, " ".join(words[1500:]))]
    assert len(chains(halves)[1]) > 1
    rows = [(1, text), (2, text), (3, " ".join(words[1000:2000])), (4, " ".join(words[:1500])), (5, " ".join(words[1500:]) + " x " + text)]
    assert _result(spark, rows) == sorted(brute.substring(rows), key=repr)
