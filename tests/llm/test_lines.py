import random

from quillspark.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def _full(text):
    return [x.strip(WHITE) for x in text.split("\n") if x.strip(WHITE)]


def _windows(a):
    """Windows of two lines, and of one that is long: places and text."""
    for p, x in enumerate(a):
        if len(x.encode()) >= 32:
            yield (p,), (x,)
        if p + 1 < len(a):
            yield (p, p + 1), (x, a[p + 1])


def _removed(rows, pair, hashes=None):
    """Every document against every earlier one; pair: which places of the later one go. Lines that stand in no window
    of another document's are left out first. hashes: only against the first holders of its windows (ties by hash)."""
    last = 2**63 - 1
    docs = [(last if i is None else i, t or "") for i, t in rows]
    holders = {}
    for i, t in docs:
        for _, w in _windows(_full(t)):
            holders.setdefault(w, set()).add(i)
    some = []
    for _, t in docs:
        own = _full(t)
        places = sorted({p for at, w in _windows(own) if len(holders[w]) > 1 for p in at})
        some.append({p: own[p] for p in places})
    if hashes is not None:
        first = {}
        for i, t in docs:
            for _, w in _windows(_full(t)):
                first[w] = min(first.get(w, (i, hashes[t])), (i, hashes[t]))
        partners = [{first[w] for _, w in _windows(_full(t))} for _, t in docs]
    out = []
    for n, (i, t) in enumerate(docs):
        gone = set()
        for m, (j, other) in enumerate(docs):
            if j < i and (hashes is None or (j, hashes[other]) in partners[n]):
                gone |= pair(some[n], some[m])
        kept, at = [], 0
        for x in t.split("\n"):
            if x.strip(WHITE):
                at += 1
                if at - 1 in gone:
                    continue
            kept.append(x)
        out.append((None if i == last else i, at, len(gone), sum(p - 1 not in gone for p in gone), len(t.encode()), "\n".join(kept)))
    return sorted(out, key=repr)


def _by_alignment(a, b):
    """The pair, aligned."""
    found = lines.shared_blocks(a, b, {p: len(x.encode()) for p, x in a.items()}, 2, 32)
    assert all([a[p + k] for k in range(n)] == [b[q + k] for k in range(n)] for p, q, n in found)
    return {p + k for p, _, n in found for k in range(n)}


def _by_runs(a, b):
    """Without any alignment: all runs of lines that both have."""
    gone = set()
    for p in a:
        for q in b:
            n = 0
            while p + n in a and q + n in b and a[p + n] == b[q + n]:
                n += 1
            if n >= 2 or sum(len(a[p + k].encode()) for k in range(n)) >= 32:
                gone.update(range(p, p + n))
    return gone


def _patience(a, b):
    """One patience diff alone."""
    at, other = list(a), list(b)
    size = {p: len(x.encode()) for p, x in a.items()}
    return {p + k for p, _, n in lines.blocks([(at[i], other[j]) for i, j in lines.align(list(a.values()), list(b.values()))], a, b, size, 2, 32) for k in range(n)}


def _result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as did", "2 as h", "3 as at", "4 as th", "5 as partners")
    return sorted((tuple(r) for r in lines.remove_shared_blocks(df).drop("near_copy").collect()), key=repr)


def _random_rows(seed):
    rng = random.Random(seed)
    short = [f"s{i}" for i in range(10)]
    hot = ["license line that stands in very many documents", "a", "b", "---"]
    passages = [[f"line {rng.randint(0, 10**6)} {'é' * rng.randint(0, 20)}" for _ in range(rng.randint(1, 6))] for _ in range(8)]
    rows = [(i, f"own {i}\n{x}\nend {i}") for i, x in enumerate(short)] + [(20, "\n".join(short)), (21, "\n".join(short))]
    for i in range(30, 110):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice([[rng.choice(hot)], rng.choices(hot, k=3), [f"own {rng.random()}"], short[3:6], short[5:9], rng.choice(passages), rng.choice(passages)])
        rows.append((rng.choice([i, i, i - 1, None]), "\n".join("  " * rng.randint(0, 1) + x for x in text)))
    rng.shuffle(rows)
    return rows + [(None, None), (200, ""), (201, " \n"), rows[40], rows[40]]


def test_against_every_earlier_document(spark):
    for seed in (3, 4):
        rows = _random_rows(seed)
        got = _result(spark, rows)
        texts = spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("coalesce(text, '')", "xxhash64(text)")
        assert got == _removed(rows, _by_alignment, dict(map(tuple, texts.collect())))
        # Other earlier documents would take hardly more than the first holders.
        want = _removed(rows, _by_alignment)
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2
        # What one patience diff of whole documents finds is never missed; nothing goes beyond the runs that both have.
        for a, b, c in zip(want, _removed(rows, _patience), _removed(rows, _by_runs), strict=True):
            assert a[:2] == b[:2] == c[:2] and c[2] >= a[2] >= b[2]
    assert _result(spark, []) == []


def test_windows_of_more_lines():
    rng = random.Random(8)
    less = 0
    for _ in range(2000):
        a, b = ([rng.choice(["x", "yy", "zzz", "w" * 9]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        size = {p: len(x) for p, x in enumerate(a)}
        for least, weight in ((3, 8), (1, 99), (4, 10)):
            found = lines.shared_blocks(dict(enumerate(a)), dict(enumerate(b)), size, least, weight)
            gone = {p + k for p, _, n in found for k in range(n)}
            once = {p + k for p, _, n in lines.blocks(lines.align(a, b), dict(enumerate(a)), dict(enumerate(b)), size, least, weight) for k in range(n)}
            runs = set()
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if n >= least or sum(map(len, a[p : p + n])) >= weight:
                        runs.update(range(p, p + n))
            assert once <= gone <= runs
            less += gone < runs
    assert less < 600  # of 6,000 with four kinds of lines: aligned line by line elsewhere, pass after pass


def test_the_diff_decides(spark, monkeypatch):
    rows = _random_rows(3)
    assert any(gone for _, _, gone, *_ in _removed(rows, _by_alignment))
    monkeypatch.setattr(lines, "align", lambda a, b: [])
    assert not any(gone for _, _, gone, *_ in _removed(rows, _by_alignment))


def test_order_and_number_of_passages():
    def gone(a, b):
        return len(_by_alignment(dict(enumerate(a)), dict(enumerate(b))))

    # What the first pass leaves, a second copy or what crosses the order, is aligned next.
    assert gone("ABCABC", "ABC") == 6 and gone("ABC", "ABCABC") == 3
    assert gone("CDAB", "ABCD") == 4 and gone("AxBxC", "ABC") == 0


def test_lines_made_to_collide(spark):
    """Strings over a and b by the Thue-Morse rule, which every polynomial modulo a power of two takes for equal."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    assert len(one) == 1024
    assert [(i, gone) for i, _, gone, *_ in _result(spark, [(1, f"x\n{one}"), (2, f"y\n{two}"), (3, f"z\n{one}")])] == [(1, 0), (2, 0), (3, 1)]


def test_many_equal_rows(spark):
    text = "\n".join(f"line {i} of a text that stands in many rows" for i in range(20))
    rows = [(1, text)] * 500 + [(2, f"own\n{text}")] * 500
    got = _result(spark, rows)
    assert [(i, n, gone) for i, n, gone, *_ in got] == [(1, 20, 0)] * 500 + [(2, 21, 20)] * 500


def test_copies_of_a_later_holder(spark):
    """The first holder of one line lies elsewhere; the copy still goes whole."""
    rows = [(1, "mid"), (3, "aaa\nmid\nbbb"), (4, "aaa\nmid\nbbb"), (11, "x1 line here"), (12, "y1 line here"), (13, "x1 line here\ny1 line here"), (14, "x1 line here\ny1 line here")]
    assert [(i, gone) for i, _, gone, *_ in _result(spark, rows)] == [(1, 0), (11, 0), (12, 0), (13, 0), (14, 2), (3, 0), (4, 3)]


def test_very_long_texts(spark):
    long = "\n".join(f"line number {i} of a very long text" for i in range(30_000))
    rows = [(1, long), (2, long + "\nown end"), (3, "same\n" * 20_000), (4, "same\n" * 20_000)]
    assert [(i, n, gone) for i, n, gone, *_ in _result(spark, rows)] == [(1, 30_000, 0), (2, 30_001, 30_000), (3, 20_000, 0), (4, 20_000, 20_000)]


def test_hash_columns_and_carried_row(spark):
    df = spark.createDataFrame([(1, "a\nb", "x"), (2, "a\nb\nc", None)], "doc_id long, text string, row string")
    got = lines.remove_shared_blocks(df, carry=True).select("doc_id", "n_removed", "row.row").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, 0, "x"), (2, 2, None)]


def test_near_copies(spark):
    line = lambda n, k=10: " ".join(f"w{n}x{i}" for i in range(k))
    base = [line(n) for n in range(12)]
    rows = [(1, base), (2, [*base[:4], line(90), *base[5:]]), (3, [*base[:4], line(91), *base[5:8], line(92), *base[9:]]), (4, [*base, line(93, 200)]), (5, base)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["near_copy"], r["n_removed"]) for r in lines.remove_shared_blocks(df).collect()}
    assert got == {1: (False, 0), 2: (True, 11), 3: (False, 10), 4: (False, 12), 5: (True, 12)}


def _longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_longest():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        for bits in (lines.TABLE_BITS, 8):
            got = lines.common(a, b, bits)
            assert len(got) == _longest(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))


def test_align_without_unique_lines():
    passage = [f"line {i}" for i in range(5)]
    # An exact copy whose lines all repeat, and the passage twice on either side.
    assert lines.align(["a", "b", "a", "b"], ["a", "b", "a", "b"]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert lines.align(["x", *passage, "y", *passage], ["u", *passage, "v"]) == [(7 + i, 1 + i) for i in range(5)]
    assert lines.align(["u", *passage, "v"], ["x", *passage, "y", *passage]) in ([(1 + i, 1 + i) for i in range(5)], [(1 + i, 7 + i) for i in range(5)])
    # A block of repeated lines after a changed line between two anchors; a line that is unique only between anchors.
    assert (3, 3) in lines.align(["A", "c", "r", "r", "Z"], ["A", "d", "r", "r", "Z"]) and (2, 2) in lines.align(["A", "c", "r", "r", "k", "Z"], ["A", "d", "r", "r", "m", "Z"])
    assert (3, 3) in lines.align(["A", "c", "d", "r", "e", "B", "r"], ["A", "f", "g", "r", "h", "B", "r"])


def test_passage_twice_is_removed(spark):
    passage = [f"passage line {i}" for i in range(6)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["own", *passage, "between", *passage])), (3, "\n".join(["end"] * 4)), (4, "\n".join(["end"] * 4))]
    assert [(i, n, gone) for i, n, gone, *_ in _result(spark, rows)] == [(1, 6, 0), (2, 14, 12), (3, 4, 0), (4, 4, 4)]


