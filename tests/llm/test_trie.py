import hashlib
import random
import zlib

import pytest

from quillspark.llm import trie


def _brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))

    def digest(x):
        return hashlib.sha256(f"{len(x[0].encode())}:{x[0]}{x[1]}".encode()).digest()

    own = {c: [x for _, x in sorted(v, key=lambda y: (y[0], digest(y[1])))] for c, v in convs.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, ends = {}, {}
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[x] for x in below) if below else 1
        own_saved = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        saved[n] = own_saved + sum(saved[x] for x in below)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def _got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as c", "2 as d", "'x' as key", "3 as top")
    out = trie.prefix_trie(df, **sizes)
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2])


def _rows():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([1, 2, 4, 7, 11])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["é", "ab", ""])))
    for c in range(200, 230):  # copies
        rows += [(c, t, "user", "same") for t in range(9)]
    rows += [(301, t, "user", f"long {t}") for t in range(90)]
    rows += [(302, None, None, None), (302, None, "user", None), (302, 1, None, "x"), (302, 1, None, "x"), (None, 1, "user", "lost"), (306, 0, "a", "b\nc"), (311, 0, "a\nb", "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 4, "most": 120, "block": 16}])
def test_against_brute_force(spark, sizes):
    rows = _rows()
    assert _got(spark, rows, **sizes) == _brute(rows)


def test_long_texts_and_empty_tables(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(None, 0, "user", "x")]) == []
    rows = [(5, 0, "user", "word " * 100_000), (6, 0, "user", "word " * 100_000), (7, 0, "user", "")]
    assert _got(spark, rows) == _brute(rows)


def test_member_digests_come_in_pieces(spark):
    ends = spark.createDataFrame([(bytearray(b"a"), i) for i in range(200)] + [(bytearray(b"b"), -5)], "key binary, c long")
    got = {bytes(r["key"]): r["digest"] for r in trie.member_digests(ends, piece=7).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(200))).encode()).hexdigest(), b"b": hashlib.sha256(b"-5").hexdigest()}


@pytest.mark.parametrize("most", [40, 1000])
def test_list_ranking(spark, most):
    rng = random.Random(1)
    ids = [(i // 7, i % 7, i % 2) for i in range(300)]
    rng.shuffle(ids)
    weights = [rng.randint(1, 9) for _ in ids]
    rows = [(a, b, w) for a, b, w in zip(ids, [*ids[1:], None], weights, strict=True)]
    rng.shuffle(rows)
    arcs = spark.createDataFrame(rows, f"at {trie._ARC}, next {trie._ARC}, w long")
    got = {tuple(r["at"]): r["pos"] for r in trie.ranked(arcs, most).collect()}
    assert got == {x: sum(weights[:i]) for i, x in enumerate(ids)}
