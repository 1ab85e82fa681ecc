import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.llm.common import stored  # noqa: E402

from . import brute  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 9000)}"
    line = lambda: " ".join(word() for _ in range(rng.randint(8, 14)))
    rows, labels = [], []
    for i in range(700):
        bad = rng.random() < 0.2
        text = "\n".join(line() for _ in range(rng.randint(6, 12)))
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split(" ")) if bad else text, "en", rng.choice(["a", "a", "b", None]), None))
        labels.append((i, 0 if bad else 1, 0))
    good = [r for r, y in zip(rows, labels, strict=True) if y[1]]
    for n, (i, text, *_) in enumerate(good[:20]):
        rows.append((1000 + n, text, "en", "c", 1))  # exact copies
        words = text.split(" ")
        rows.append((2000 + n, " ".join([*words[:9], "changed", *words[10:]]).replace("\n", " "), "en", "c", 1))  # near copies in one line
    rows += [(None, good[30][1] + "\nand its own last line of words", "en", None, None), (3000, None, None, None, None), (3001, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, dict((i, q) for i, q, _ in labels)


def test_stages(spark, tables):
    path, rows, quality = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "minhash dedup", "source mixing", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "test")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    accepted, cut, single, mixed = kept
    assert sum((i in accepted) == bool(q) for i, q in quality.items()) >= 690
    assert not any(1000 <= (i or 0) < 1020 for i in cut)  # exact copies lose every line
    near = brute.near(list(cut.items()))
    assert single.keys() == {i for i, _, _, stays in near if stays}
    assert not any(2000 <= (i or 0) < 2020 for i in single)
    assert mixed == single
    pieces = corpus_pipeline.packing(spark, docs, path).collect()
    tokens = {}
    for r in pieces:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens.keys() == mixed.keys() and all(tokens[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_run_and_empty(spark, tables, tmp_path):
    path, _, _ = tables
    assert corpus_pipeline.run(spark, path).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_shared_ids(spark, tmp_path):
    words = lambda a: " ".join(f"w{a}x{i}" for i in range(60))
    rows = [(1, words(1)), (1, words(2)), (1, words(1)), (2, words(3)), (5, words(3) + " end"), (None, words(4)), (None, None)]
    clash = {c: "1" for c in ("row", "id", "th", "rest", "did", "gone_id", "_file", "_row", "_metadata", "slot", "share", "n", "kept_text", "n_removed", "score", "group", "spans")}
    extra = ", ".join(f"{c} string" for c in clash)
    data = [(i, t, "en", "a", 1, *clash.values()) for i, t in rows]
    frame = spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == frame.columns
        if name == "minhash dedup":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()) == sorted([(1, words(1)), (1, words(2)), (2, words(3)), (0, words(4)), (0, "")])
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()} == {1, 2, None}
    # Frames that come from no file.
    assert corpus_pipeline.packing(spark, frame.limit(3), str(tmp_path)).count() == 3


def test_near_copies_leave_no_stumps(spark, tmp_path):
    """A document linked to an earlier one goes in one of the two stages; one below the threshold keeps its own line."""
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(10))
    base = [[line() for _ in range(12 if n < 8 else 10)] for n in range(12)]
    rows = [(n, "\n".join(b)) for n, b in enumerate(base)]
    rows += [(100 + n, "\n".join([*b[:4], line(), *b[5:]])) for n, b in enumerate(base)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.minhash_dedup):
        docs = stored(stage(spark, docs, ""), "test")
    texts = dict(rows)
    assert {i for i, *_, stays in brute.near(rows) if not stays} == {100 + n for n in range(8)}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {**{n: texts[n] for n in range(12)}, **{100 + n: texts[100 + n].split("\n")[4] for n in range(8, 12)}}


def test_own_text_stays_however_much_is_shared(spark):
    shared = [f"shared line number {i} of a long passage" for i in range(1400)]
    own = [f"own line number {i} that no other document holds anywhere, with some words more {i * i}" for i in range(300)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(shared + own)), (3, "\n".join(["short own line", *shared[:50]]))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    left = "\n".join(own)
    assert cut == {1: (rows[0][1], len(rows[0][1])), 2: (left, len(left)), 3: ("short own line", 14)}
