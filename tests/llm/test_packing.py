import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing

STRANGE = ["", " ", "\n\n  \n", "a" * 3000, "<|endoftext|> x <|endoftext|>", "naïve café — ¥ 😀😀", "don't  stop\t\tnow\r\n", "12345 67,89", "  x", "ab\x00c", "日本語 テキスト", "á" * 50]


def _ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_rebuild_the_documents(spark):
    rng = random.Random(6)
    texts = STRANGE + [" ".join(rng.choice(["the", "Ouwhea", "éèau", "x!!", "\n"]) for _ in range(rng.randint(0, 3000))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, None), (5, "again"), (5, "again"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.asDict() for r in packing.packed(df, group_docs=40).collect()]
    ids = defaultdict(list)
    for (i, t), x in zip(rows, _ids([t or "" for _, t in rows]), strict=True):
        ids[i].append(x)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert any(r["doc_tokens"] == len(x) and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for i, own in ids.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == own[0]["sequence_length"] <= 2048
    assert packing.packed(df.filter("false")).count() == 0


def test_first_fit_matches_a_scan():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(300)]


def test_ids_are_those_of_the_named_call():
    encode = packing.encoder()
    rng = random.Random(2)
    texts = STRANGE + ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "  x", "é", "\n", "word"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert encode("<|endoftext|> x") == [50256, 2124]
    assert [[*encode(t), 1] for t in texts] == _ids(texts)


def test_repeated_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(7, "same")] * 3000 + [(None, None)] * 1000, "doc_id long, text string").withColumns({c: packing.F.lit(1) for c in ("th", "group", "n", "crcs")})
    got = packing.packed(df, group_docs=200).collect()
    assert len(got) == 4000 and sum(r["doc_id"] is None for r in got) == 1000
    size = defaultdict(int)
    for r in got:
        size[r["sequence_id"] // packing.SEQUENCES] += 1
    assert len(size) == 20 and max(size.values()) < 400
