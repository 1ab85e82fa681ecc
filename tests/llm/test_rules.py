import math
import random

import numpy as np

from quillspark.llm import rules

from .brute import WORD


def _brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = {}
    for p in range(len(words) - 2):
        windows.setdefault(tuple(words[p : p + 3]), []).append(p)
    covered = {p + k for ps in windows.values() if len(ps) > 1 for p in ps for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, " \n ", "a", "a a a a", "a b\n\na b\n a b\ra b", "é ü # ¥ | <x> y z 😀 #"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice("ab cd e# f| g".split()) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts.append(" ".join(f"w{i % 9000}" for i in range(30_000)))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: rules.F.lit("x") for c in ("words", "lines", "plain", "n_words", "rule", "kept")})
    empty = df.filter("false")
    assert rules.apply_rules(empty, []).count() == 0
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.statistics(df).collect()}
    assert got == {i: _brute(t) for i, t in enumerate(texts)}


def test_learned_list(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 120))]
        docs.append((i, " ".join(w + "###" if bad and i % 2 else w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    found = rules.learn(rules.labelled_statistics(d, y))
    assert found
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_rules(d, found).collect()}
    assert sum(kept[i] == bool(q) for i, q in labels) >= 595
    assert rules.learn(rules.labelled_statistics(d, y.filter("false"))) == []
    plan = rules.apply_rules(d, found)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _slow_learn(rows, precision=0.97, least=3, most_rules=16, most_conditions=3, steps=24):
    """Sequential covering in plain loops. rows: (values, is bad)."""

    def holds(c, x):
        return x[c[0]] >= c[2] if c[1] else x[c[0]] < c[2]

    def count(part, rule):
        inside = [b for x, b in part if all(holds(c, x) for c in rule)]
        return sum(inside), len(inside) - sum(inside)

    growing, pruning = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    found = []
    while len(found) < most_rules and any(b for _, b in growing):
        rule, inside = [], growing
        while len(rule) < most_conditions:
            bad = sum(b for _, b in inside)
            if bad in (0, len(inside)):
                break
            base, best, gain = math.log2(bad / len(inside)), None, 1e-9
            for k in range(len(rules.NAMES)):
                values = sorted(x[k] for x, b in inside if b)
                cuts = sorted({values[i * (len(values) - 1) // steps] for i in range(steps + 1)})
                for c in [(k, True, v) for v in cuts] + [(k, False, v + 1) for v in cuts]:
                    p, n = count(inside, [c])
                    if p and p * (math.log2(p / (p + n)) - base) > gain:
                        best, gain = c, p * (math.log2(p / (p + n)) - base)
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if holds(best, r[0])]
        if not rule:
            break

        def worth(r):
            p, n = count(pruning, r)
            return (p - n) / (p + n) if p + n else -1

        best = rule
        for end in range(len(rule) - 1, 0, -1):
            if worth(rule[:end]) >= worth(best):
                best = rule[:end]
        bad, good = (a + b for a, b in zip(count(growing, best), count(pruning, best), strict=True))
        if bad < least or bad < precision * (bad + good):
            break
        found.append(best)
        growing, pruning = ([r for r in part if not all(holds(c, r[0]) for c in best)] for part in (growing, pruning))
    return found


def test_learner_against_plain_loops():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, (400, len(rules.NAMES)))
        bad = ((x[:, 0] > 8) & (x[:, 3] < 6)) | (x[:, 5] > 10) if seed < 5 else rng.random(400) < 0.3
        # Growing and pruning rows keep their places in both forms: what a rule covers leaves each in order.
        got = rules.learn((x, bad), precision=0.9)
        want = _slow_learn(list(zip(x.tolist(), bad.tolist(), strict=True)), precision=0.9)
        assert [[(rules.NAMES.index(c.name), c.above, c.threshold) for c in r] for r in got] == [[tuple(c) for c in r] for r in want]
        assert bool(got) or seed == 5


def test_repeated_ids_count_once(spark):
    d = spark.createDataFrame([(1, "w " * 60)] * 500 + [(1, "v " * 70)] * 50, "doc_id long, text string")
    y = spark.createDataFrame([(1, 0)] * 300 + [(1, 1)] * 300, "doc_id long, quality int")
    x, bad = rules.labelled_statistics(d, y)
    assert len(x) == 1 and bad.tolist() == [True]
