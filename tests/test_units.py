"""Small cases of the operators: edges that the driver's tables don't have."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.functions import text as X
from quillspark.operators import corpus as C
from quillspark.operators import evaluate as E
from quillspark.operators import guards as G
from quillspark.operators import hooks as H
from quillspark.operators import persona as P
from quillspark.operators import relational as R
from quillspark.operators import retrieval as V
from quillspark.operators import world as W
from quillspark.operators.contain import contained_in
from quillspark.sources import store


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("AB-12 x.y 50%", ["ab", "12", "x", "y", "50"]),
        ('"quoted" <= op', ["quoted", "op"]),
        ("a\nb\tc", ["a", "b", "c"]),
        ("Ａｂ１，ｘ", ["ab1", "x"]),
        ("one　two—three", ["one", "two", "three"]),
        ("...!?", []),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens, text) == want


def test_bigrams(spark):
    assert one(spark, X.bigram_tokens, "Go 東京都 x 人") == ["go", "東京", "京都", "x", "人"]
    assert one(spark, X.bigram_tokens, "") == []
    assert one(spark, X.token_estimate, "東京abcde") == 4


def test_query_tokens_keep_all_stopwords(spark):
    assert one(spark, lambda c: X.query_tokens(c, ["the", "of"]), "the of the") == ["the", "of", "the"]
    assert one(spark, lambda c: X.query_tokens(c, ["the"]), "the cat the cat") == ["cat", "cat"]


def test_text_functions(spark):
    assert one(spark, X.trimmed_punctuation, "«¡hola, tú!» ") == "hola, tú"
    assert one(spark, X.citation_ids, "a [#x1, #y] b [#z] [no]") == ["x1", "y", "z"]
    assert one(spark, X.without_citations, "a [#x1, #y] b") == "a b"
    assert one(spark, lambda c: X.cut_at_leak(c, ["Turn {n}: {text}"]), "hi\nTurn 3: secret\nmore") == "hi\n"
    verdict = lambda c: X.reply_verdict(c, ["find"], ["as an ai"], [], ["ok"])
    assert [one(spark, verdict, t) for t in (None, " ! ", '```json\n{"a": 1}\n```', "find(x)", "As  an AI I", "OK.", "fine words")] == ["empty", "empty", "json", "tool call", "boilerplate", "boilerplate", "fine"]
    assert one(spark, lambda c: X.crumbs(F.split(c, "/"), ["x"]), "a/a/x/a/b/b") == ["a", "b"]
    assert [r["speaker"] for r in one(spark, X.speaker_lines, "Ann: hi\nplain\nBob: yo")] == ["Ann", "Bob"]


def test_times(spark):
    assert [one(spark, S.hhmm, t) for t in ("7:05", "23：59", "24:00", "7:5", None)] == ["07:05", "23:59", None, None, None]
    assert [one(spark, S.day_month, t) for t in ("02-29", "2023-02-29", "02-30", "x")] == ["02-29", "02-29", None, None]
    assert one(spark, S.due_ms, "2024-01-01T00:00:00+02:00") == 1704060000000
    quiet = lambda a, b: (lambda c: S.in_quiet_hours(c, a, b))
    assert [one(spark, quiet(1380, 420), m, "int") for m in (1380, 419, 420)] == [True, True, False]
    assert one(spark, quiet(5, 5), 5, "int") is False
    assert S.ratios(2.0, 0.5, 8.0) == (0.25, 4.0) and S.ratios(0, 1, 1) == (0.25, 4.0)


def test_percentiles(spark):
    v = [10, 20, 30, 40, 50]
    got = lambda c: one(spark, c, v, "array<int>")
    assert got(lambda c: R.floor_percentile(c, 0.95)) == 40 and got(R.upper_median) == 30 and got(lambda c: R.nearest_rank(c, 0.9)) == 50
    assert got(lambda c: R.even_quantiles(c, 3)) == [10, 30, 50] and one(spark, R.upper_median, [], "array<int>") is None


def test_every_nth_and_division(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0)], "g string, i int")
    assert sorted(r["i"] for r in R.every_nth(df, ["g"], ["i"], F.lit(4)).filter("g = 'a'").collect()) == [0, 2, 5, 7]
    seen = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "item int, who int")
    assert [r["item"] for r in R.seen_by_all(seen, "item", "who", spark.createDataFrame([(1,), (2,)], "who int")).collect()] == [1]
    assert R.seen_by_all(seen, "item", "who", spark.createDataFrame([], "who int")).count() == 0


def test_whole_word(spark):
    df = spark.createDataFrame([("the cat",), ("cats",), ("東cat京",), ("Cat",), ("a.cat!",)], "t string")
    assert df.filter(R.has_whole_word(F.col("t"), "cat")).count() == 3


def test_bm25_case(spark):
    units = spark.createDataFrame([(0, "lantern on the pier", "lore"), (1, "lantern lantern", "lore"), (2, "fish and boats", "dialogue")], "ord long, text string, template string")
    index = V.build_index(units)
    queries = spark.createDataFrame([(1, "lantern"), (2, "lantern lantern"), (3, "nothing known")], "qid long, text string")
    hits = {(r["qid"], r["ord"]): r["score"] for r in V.bm25(index, V.query_terms(queries, "qid", "text")).collect()}
    assert {k[0] for k in hits} == {1, 2} and abs(hits[2, 1] - 2 * hits[1, 1]) < 2e-6
    out = V.search(index, units, queries)
    assert {r["qid"] for r in out.collect()} == {1, 2}
    with pytest.raises(ValueError):
        V.search(index, units, queries, rerank="always")
    people = V.people(V.top_hits(V.bm25(index, V.query_terms(queries, "qid", "text")), 5), spark.createDataFrame([(1, 7), (1, 8), (0, 7)], "unit long, person long"), V.People())
    first = {r["qid"]: r["person"] for r in people.filter("place = 1").collect()}
    assert first[1] == 7


def test_index_round_trip(spark, tmp_path):
    index = V.build_index(spark.createDataFrame([(0, "a b a"), (1, None)], "ord long, text string"))
    index.write(str(tmp_path))
    back = V.Index.read(spark, str(tmp_path))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.collect())) == [("a", 0, 2, 3), ("b", 0, 1, 3)]


def test_aliases(spark):
    aliases = spark.createDataFrame([("Ann", "Anna"), ("Kay", "Kay One"), ("Kay", "Kay Two"), ("LX", "Lex")], "alias string, target string")
    states = {r["alias"]: r["state"] for r in V.alias_targets(aliases).collect()}
    assert states == {"ann": "resolved", "kay": "ambiguous", "lx": "resolved"}
    queries = spark.createDataFrame([(1, "kay and kay two"), (2, "the LX there"), (3, "aLX"), (4, "LX, then Ann")], "qid long, text string")
    assert [tuple(r) for r in V.resolve_qualified(queries, aliases).collect()] == [(1, "kay", "Kay Two")]
    assert [tuple(r) for r in V.resolve_inside(queries, aliases).collect()] == [(2, "Lex")]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 5, 1), (3, 9, 1)], "qid long, ord long, grade int")
    neg = spark.createDataFrame([(2, 6)], "qid long, ord long")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 6, 1), (2, 5, 2)], "qid long, ord long, rank long")
    got = {r["qid"]: r for r in E.scores(hits, gold, neg, 10).collect()}
    assert got[1]["ndcg"] == 1.0 and got[1]["recall"] == 1.0 and got[1]["rr"] == 1.0 and not got[1]["negative_won"]
    assert got[2]["negative_won"] and got[2]["rr"] == 0.5 and got[3]["empty"] and got[3]["ndcg"] == 0.0


def test_bootstrap(spark):
    def p(before, after, iterations=200):
        rows = [(i * 7, b, a) for i, (b, a) in enumerate(zip(before, after, strict=True))]
        return tuple(E.paired_bootstrap(spark.createDataFrame(rows, "qid long, before double, after double"), iterations).first())

    assert p([], []) == (0, None)
    assert p([0.5] * 20, [0.5] * 20)[1] == 1.0
    base = [0.30 + (i % 5) * 0.01 for i in range(60)]
    assert p(base, [b + 0.25 for b in base])[1] < 0.05
    noise = [0.1, 0.4, 0.3, 0.7, 0.2]
    assert p(noise, noise[::-1]) == p(noise, noise[::-1]) and p(noise, noise[::-1])[1] > 0.5


def test_calibration_against_a_grid_search(spark):
    import random

    rng = random.Random(2)
    rows = [(f"f{i % 3}", float(rng.randint(1, 20)), rng.randint(0, 10) / 10, rng.random() < 0.5) for i in range(120)]
    rows = [(f, t, e, a or t > 14) for f, t, e, a in rows]
    got = E.calibrate(spark.createDataFrame(rows, "family string, top1 double, entropy double, answered boolean"))
    size = {f: sum(r[0] == f for r in rows) for f in ("f0", "f1", "f2")}
    weight = [1 / (size[r[0]] * 3) for r in rows]
    positive = sum(w for r, w in zip(rows, weight, strict=True) if r[3])
    best = max(
        (
            (
                round(sum(w for r, w in zip(rows, weight, strict=True) if r[3] and r[1] >= t and r[2] <= e) / positive - sum(w for r, w in zip(rows, weight, strict=True) if not r[3] and r[1] >= t and r[2] <= e) / (1 - positive), 9)
                for t in sorted({r[1] for r in rows})
                for e in [*sorted({r[2] for r in rows}), 1.0]
            )
        )
    )
    assert abs(got["separation"] - best) < 1e-6
    assert E.calibrate(spark.createDataFrame([], "family string, top1 double, entropy double, answered boolean")) is None


def test_tables_and_sections():
    nested = "a<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>b<table>open"
    assert C.strip_tables(nested) == "ab"
    grid = C.table_grid('<table><tr><th rowspan="2">A</th><th colspan=2>B</th></tr><tr><td>1</td><td>2</td></tr></table>')
    assert grid == [["A", "B", "B"], ["A", "1", "2"]]
    parts = C.split_sections("intro<h1>One</h1>a<h2>Two</h2>b<h1>Three</h1>c", least=1)
    assert parts == [(["lead"], "intro", 0), (["One"], "a", 5), (["One", "Two"], "b", 18), (["Three"], "c", 31)]
    assert C.split_sections("only text", least=1) == [([], "only text", 0)] and C.split_sections("only text") == []
    # A heading in a comment is none, and offsets count without comments; dropped sections go with what lies below.
    commented = "<!-- <h2>gone</h2> --><p>body text</p><h2>Kept</h2>x<h2>Notes</h2>y<h3>Below</h3>z<h2>End"
    assert C.split_sections(commented, ("Notes",), 1) == [(["lead"], "body text", 0), (["Kept"], "x", 16)]
    assert C.split_sections("<h3>Deep</h3>a<h2>Up</h2>b", least=1) == [(["Deep"], "a", 0), (["Deep", "Up"], "b", 14)]
    assert C.split_text("aaa bbb. ccc ddd", 9) == ["aaa bbb.", "ccc ddd"] and C.split_text("x" * 7, 3) == ["xxx", "xxx", "x"]
    # A break counts only past a third of the limit; the kinds of breaks go in order.
    assert C.split_text("ab " + "c" * 40, 30) == ["ab " + "c" * 27, "c" * 13]
    assert C.split_text("one two\nthree four five", 12) == ["one two", "three four", "five"]
    assert C.split_text("", 5) == [] and C.split_text(" ab ", 5) == [" ab "]
    assert C.merged_order([["a", "c"], ["a", "b", "c"], ["d"]]) == ["d", "a", "b", "c"]


def test_dialogue_cuts(spark):
    rows = [(1, i, "ab"[i // 2 % 2], "x" * 10) for i in range(8)] + [(2, 0, None, None)]
    units = C.dialogue_units(spark.createDataFrame(rows, "scene long, seq long, speaker string, text string"), target=15, most=3)
    got = [(r["scene"], r["lo"], r["hi"]) for r in units.orderBy("scene", "unit").collect()]
    assert got == [(1, 0, 1), (1, 2, 3), (1, 4, 5), (1, 6, 7), (2, 0, 0)]


def test_redirects(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10)], "node long, next long")
    got = {r["node"]: r["target"] for r in C.followed(edges).collect()}
    assert got[1] == got[2] == got[3] == 4 and got[10] == got[11]


def test_guards(spark):
    assert G.meets(511, "< 512") and not G.meets(0.4, ">= .5")
    with pytest.raises(ValueError):
        G.meets(1, "about 3")
    now, was = (spark.createDataFrame(x, "k string, n long") for x in ([("a", 1), ("b", 5), ("c", 2)], [("a", 2), ("b", 5), ("d", 1)]))
    assert {tuple(r) for r in G.drift(now, was, "k").collect()} == {("a", "high"), ("c", "low"), ("d", "high")}


def test_sessions(spark):
    m = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 30, 3)], "a long, ms long, id long")
    assert [(r["session"], r["n"]) for r in W.sessions(m, "a", 20).orderBy("session").collect()] == [(0, 2), (1, 1)]


def test_persona(spark):
    items = spark.createDataFrame([(1, i, t) for i, t in enumerate([50, 60, 30, 5])], "p long, i long, t long")
    assert [r["i"] for r in P.budget_fill(items, "p", ["i"], "t", 90).orderBy("i").collect()] == [0, 2, 3]
    assert P.even_budget_sample(items, "p", "i", "t", 70).count() >= 1
    assert [P.van_der_corput(n) for n in range(4)] == [0.0, 0.5, 0.25, 0.75]
    assert P.spread_pick(items.withColumn("g", F.col("i") % 2), "p", ["g"], "i", 3).count() == 3


def test_containment(spark):
    texts = spark.createDataFrame([(1, "xx one two three four five yy"), (2, None), (3, "")], "tid long, t string")
    passages = spark.createDataFrame([(1, "x one two three four five y"), (2, "three four"), (3, ""), (4, "one two four three five six"), (5, None), (6, "wo three fo"), (7, "e two three f"), (8, "e three four"), (9, "two  three four"), (10, " two three ")], "pid long, p string")
    held = sorted(map(tuple, contained_in(passages, "pid", "p", texts, "tid", "t").collect()))
    assert held == [(1, 1), (2, 1), (3, 1), (3, 3), (6, 1), (7, 1), (10, 1)]


def test_small_tables(spark):
    two = spark.range(2)
    assert "broadcast" in R.small(two)._jdf.queryExecution().logical().toString().lower()
    assert R.small(two, rows=1) is two


def test_even_cuts(spark):
    values = [x * x / 7 for x in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:50], None]], "v double")
    assert [r[0] for r in E._cuts(df, "v", 20)] == [values[i * 499 // 19] for i in range(20)]
    assert [r[0] for r in E._cuts(df.filter("v < 1"), "v", 20)] == [v for v in values if v < 1]


def test_quota_without_groups(spark):
    calls = spark.createDataFrame([(ms, 1.0) for ms in (1000, 1000, 2000, 3_700_000)], "ms long, cost double")
    assert [tuple(r) for r in W.quota_status(calls, 3_600_999, 3.0).collect()] == [("exhausted", 3.0, 3_601_000)]
    assert [tuple(r) for r in W.quota_status(calls, 3_600_999, 3.5).collect()] == [("quiet", 3.0, 3_601_000)]


def test_store(spark, tmp_path):
    held = spark.createDataFrame([(1, "a")], "k int, v string")
    fresh = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    stored, ignored = store.insert_or_ignore(held, fresh, ["k"], ["v"])
    assert [tuple(r) for r in stored.collect()] == [(2, "c")] and ignored.count() == 2
    (tmp_path / "suite").mkdir()
    (tmp_path / "suite" / "a.json").write_text('{"qid": 1}\nbroken\n')
    with pytest.raises(ValueError, match="broken"):
        store.read_suite(spark, str(tmp_path / "suite"), "qid long")
    with pytest.raises(FileNotFoundError):
        store.read_corpus(spark, str(tmp_path / "none"))


def test_plugins():
    host = H.PluginHost()
    for _ in range(5):
        assert host.call("p", lambda x: 1 / 0, "same") == "same"
    assert host.failures["p"] == 3
    with pytest.raises(ValueError):
        H.Plugin.parse({"name": "x", "protocol": 9})
    assert H.Plugin.parse({"name": "x", "protocol": 1, "timeout_ms": 99999}).timeout_ms == 5000


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(f"u{i}",) for i in range(50)], "id string")
    b = a.orderBy(F.desc("id")).repartition(3)
    assert C.fingerprint(a, "id").first() == C.fingerprint(b, "id").first()
    assert C.fingerprint(a.filter("id <> 'u7'"), "id").first() != C.fingerprint(a, "id").first()


def test_pieces_and_sections_of_frames(spark):
    df = spark.createDataFrame([(1, "aaa bbb. ccc ddd", "x<h1>T</h1>y<table><tr><td>z</td></tr></table>"), (2, None, None)], "k long, t string, h string")
    assert [tuple(r) for r in C.pieces(df, "k", "t", 9).orderBy("k", "piece").collect()] == [(1, 0, "aaa bbb."), (1, 1, "ccc ddd")]
    assert [(r["k"], r["path"], r["body"]) for r in C.page_sections(df, "k", "h", least=1).orderBy("k", "seq").collect()] == [(1, ["lead"], "x"), (1, ["T"], "y")]


def test_tables_nested_unclosed_and_spanning():
    """Against a slow reading, character by character."""
    import random
    import re

    def slow(text):
        out, depth, i = "", 0, 0
        while i < len(text):
            mark = re.match(r"(?i)<table>|</table>", text[i:])
            if mark:
                depth = depth + 1 if mark[0][1] != "/" else max(0, depth - 1)
                i += len(mark[0])
                continue
            out += "" if depth else text[i]
            i += 1
        return out

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<table>", "</table>", "a", "<b>", "</TABLE>", "<TABLE>"]) for _ in range(rng.randint(0, 12)))
        assert C.strip_tables(text) == slow(text)
    assert C.table_grid("<table><tr><td rowspan=3>a<td>b<tr><td colspan=2>c<tr><td>d</table>") == [["a", "b"], ["a", "c", "c"], ["a", "d"]]
    assert C.table_grid("no table") == []


def test_page_records(spark):
    rules = spark.createDataFrame([("a", "^a"), ("ab", "^ab"), ("bare", "^z")], "route string, pattern string")
    pages = spark.createDataFrame([(1, "ab", "x y"), (2, "a", None), (3, "z", "t"), (4, "q", "t"), (5, "a", "!")], "k int, title string, body string")
    words = lambda x: ([("word", w) for w in x.split() if w != "!"], ["odd"] if "!" in x else [])
    got = C.page_records(pages, rules, "title", "body", {"a": words, "ab": words, "bare": lambda x: ([], [])}, ("bare",))
    assert sorted((r["k"], r["route"], r["kind"], r["seq"], r["value"]) for r in got.fillna("-").collect()) == [
        (1, "ab", "word", 0, "x"), (1, "ab", "word", 1, "y"), (2, "a", "empty", 0, "-"), (3, "bare", "expected empty", 0, "-"), (4, "-", "unrouted", 0, "-"), (5, "a", "empty", 0, "-"), (5, "a", "warning", 1, "odd"),
    ]


def test_values_at_places(spark):
    import random

    rng = random.Random(3)
    rows = [(g, rng.randint(0, 9) if rng.random() < 0.9 else None) for g in "abc" for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: (r["n"], r["a"], r["b"], r["c"]) for r in R.values_at(df, ["g"], "v", {"a": R.floor_place(0.95), "b": R.upper_place, "c": R.nearest_place(0.9)}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), v[int(0.95 * (len(v) - 1))], v[len(v) // 2], v[int((len(v) - 1) * 0.9 + 0.5)])
    assert R.values_at(df.filter("false"), [], "v", {"a": R.upper_place}).first()["a"] is None


def test_siblings_are_cut_by_source_before_the_join(spark):
    # Source a begins with 70 gold units, unit 3 also lies in b; the first 64 others are still found whole.
    units = spark.createDataFrame([(o, "a") for o in range(300)] + [(o, "b") for o in range(500, 900)] + [(3, "b")], "ord long, source string")
    gold = spark.createDataFrame([(1, o, "a") for o in range(70)] + [(2, 510, "b")], "qid long, ord long, source string")
    near = E.sibling_units(gold, units)
    assert near.count() == 70 + 64 + 64 + 1
    whole = gold.select("qid", "source").distinct().join(units, "source")
    got, want = (sorted(map(tuple, E.hard_negatives(df, gold).collect())) for df in (near, whole))
    assert got == want and len(got) == 128


def test_scores_need_no_exchange_of_postings(spark):
    units = spark.createDataFrame([(i, f"a b{i % 7} c c d{i % 3}") for i in range(60)], "ord long, text string")
    index = V.build_index(units)
    terms = V.query_terms(spark.createDataFrame([(1, "a c c"), (2, "b1 d2 zz")], "qid long, text string"), "qid", "text")
    hits = V.top_hits(V.bm25(index, terms), 5)
    plan = hits._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(qid" in plan and "hashpartitioning(term" not in plan.split("BroadcastExchange")[0]
    many, V.SUITE_TERMS = V.SUITE_TERMS, 1
    try:
        plain = sorted(map(tuple, V.top_hits(V.bm25(index, terms), 5).collect()))
    finally:
        V.SUITE_TERMS = many
    assert sorted(map(tuple, hits.collect())) == plain and len(plain) == 10


def test_stored_frames_are_computed_once(spark):
    from pyspark.sql import functions as F

    from quillspark.sources.scratch import stored

    frame = stored(spark.range(3).select("id", F.rand().alias("x")), "once")
    assert frame.collect() == frame.collect() and frame.columns == ["id", "x"]


def test_visibility_is_counted_by_class(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, *range(25)]), rng.choice(["world", "self", "channel"]), rng.choice([None, 0, 1, 2, 3]), rng.random() < 0.2) for _ in range(80)]
    facts = spark.createDataFrame(rows, "id long, audience string, ref long, retracted boolean")
    pairs = [(rng.randint(0, 3), rng.randint(0, 5)) for _ in range(12)]
    members = spark.createDataFrame(pairs, "channel long, person long")
    seen = {tuple(r) for r in W.visibility(facts, members).collect()}
    counts = {r["person"]: r["facts"] for r in W.seen_counts(facts, members).collect()}
    assert counts == {p: sum(q == p for _, q in seen) for p in {p for _, p in seen}}
    met = [(r, p) for i, p in seen if i is not None for r in rows if r[0] == i]
    leaks = {
        "alone": sum(r[1] == "self" and None not in (p, r[2]) and p != r[2] for r, p in met),
        "retracted": sum(r[3] for r, _ in met),
        "outsider": sum(r[1] == "channel" and (r[2], p) not in pairs for r, p in met),
    }
    assert {r["point"]: r["leaks"] for r in W.leak_counts(facts, members).collect()} == leaks and all(leaks.values())
    for channel in (0, 1, 9):
        group = {p for c, p in pairs if c == channel}
        shared = [i for i in {i for i, _ in seen} if group and group <= {p for j, p in seen if j == i}]
        want = sorted([str(i) for i in shared] + [str(r[0]) for r in rows if r[1] == "world" and not r[3]])
        assert sorted(str(r["id"]) for r in W.shared_visible(facts, members, channel).collect()) == want
    # Two facts of one audience share a class: nothing holds a row for each fact and person.
    same = spark.createDataFrame([(i, "channel", 1, False) for i in range(50)], "id long, audience string, ref long, retracted boolean")
    assert W.visibility_classes(same, members)[1].count() == len({p for c, p in pairs if c == 1})


def test_rolling_sums_of_dense_instants(spark):
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.choice([None, *range(-30, 90)]), rng.choice([None, 0, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ms long, cost long")
    for by in (None, ["k"]):
        made = R.rolling_sum(df, "ms", "cost", 20, by)
        assert "RangeFrame, -" not in made._jdf.queryExecution().toString()

        def held(a, b, by=by):
            return (not by or a[1] == b[1]) and (a[2] is b[2] is None or (None not in (a[2], b[2]) and a[2] - 20 < b[2] <= a[2]))

        want = {}
        for a in rows:
            values = [b[3] for b in rows if b[3] is not None and held(a, b)]
            want[a[0]] = sum(values) if values else None
        assert {r["id"]: r["rolling"] for r in made.collect()} == want


def test_equal_names_are_compared_once(spark):
    names = spark.createDataFrame([("a", "red ring"), ("a", "red ring"), ("a", "red rink"), ("a", None), ("b", "red ring")], "g string, n string")
    got = {(r["_group"], r["_x"], r["_y"]): r["similar"] for r in X.similar_names(names, "g", "n").collect()}
    assert len(got) == 10 and got["a", "red ring", "red ring"] == 100 and got["a", "red ring", "red rink"] == got["a", "red rink", "red ring"] == 71


def test_runs_without_an_alias_are_not_dealt_out(spark):
    aliases = spark.createDataFrame([("LX", "Lex"), ("Ann", "Anna"), ("A N", "Anna"), ("Nil", None)], "alias string, target string")
    queries = spark.createDataFrame([(1, "LX and LX"), (2, "Ann, A N"), (3, "LX Ann"), (4, "Nil"), (5, "Nil LX")], "qid long, text string")
    found = V.resolve_inside(queries, aliases)
    assert sorted(map(tuple, found.collect())) == [(1, "Lex"), (2, "Anna"), (5, "Lex")]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(qid#" in found._jdf.queryExecution().toString().split("BroadcastHashJoin")[0]


def _pairs_by_sql(folder):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    db.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    return sorted(db.execute(entry.oracle_sql()["v05_similarity"]).fetchall(), key=str)


def test_similarity_of_odd_names_is_that_of_the_sql(spark, tmp_path):
    import __spark_entry__ as entry

    names = ["red ring", "Red ring", "red-ring", "a", "a", "", None, None, "a b", "ab", "é è", "red ring"]
    parts = [(i, n, b) for b in ("x", "y", None) for i, n in enumerate(names, 100 * len(b or ""))]
    parts += [(None, "red ring", "x"), (101, "red rink", "x"), (101, "red ring", "x")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["v05_similarity"](spark, str(tmp_path)).select("a", "b", "similar").collect()
    assert sorted(map(tuple, got), key=str) == _pairs_by_sql(tmp_path)


@pytest.mark.parametrize("block,near", [(1, 1), (3, 10), (1000, 7), (4, 1000)])
def test_similar_pairs_in_blocks_of_any_size(spark, block, near):
    names = ["red ring", "red rink", "a", None]
    rows = [("g" if i % 7 else "h", names[(i * i) % 4 if i % 3 else 0], i) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, n string, k long")
    alike = {("red ring", "red rink"): 71, ("red ring", "a"): 0, ("red rink", "a"): 0, ("a", "a"): 0}
    want = [(i, j, None if n is None else 0 if m is None else alike.get((n, m), alike.get((m, n), 100))) for g, n, i in rows for h, m, j in rows if g == h and i < j]
    got = R.similar_pairs(df, "g", "n", "k", block=block, near=near).select("a", "b", "similar").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_similar_pairs_arise_only_as_rows_of_the_result(spark):
    rows = [("g", "red ring" if i % 2 else "red rink", i) for i in range(400)]
    made = R.similar_pairs(spark.createDataFrame(rows, "g string, n string, k long"), "g", "n", "k", block=32, near=100)
    assert made.count() == 400 * 399 // 2
    plan = made._jdf.queryExecution().toString()
    # Explosions stand above the last shuffle and join: below them are blocks.
    top = plan[plan.index("== Physical Plan ==") :]
    assert top.count("SortMergeJoin") and top.index("Generate explode") < top.index("SortMergeJoin") < top.index("Exchange")
