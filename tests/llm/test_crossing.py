import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import crossing


def _bytes_of_a(entries):
    """Byte-level entries: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain}
    back |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    return [bytes(back[c] for c in e) for e in entries]


def _brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = []
    for i, text in rows:
        ids_a = ids_b = ()
        bytes_a = bytes_b = []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            bytes_a = _bytes_of_a([a.id_to_token(x) for x in ids_a])
            ids_b = b.encode(text)
            names = [(x, b.id_to_piece(x)) for x in ids_b]
            bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(x) else n.replace("▁", " ").encode() for x, n in names]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = (), (), [], []
        spans = []
        for pieces in (bytes_a, bytes_b):
            at, own = 0, []
            for x in pieces:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups = []
        for ids, own in zip((ids_a, ids_b), spans, strict=True):
            cut, part = [], []
            for x, (_, e) in zip(ids, own, strict=True):
                part.append(str(x))
                if e in both:
                    cut.append(",".join(part))
                    part = []
            groups.append(cut)
        pairs = [(x, y) for x, (s, e) in zip(ids_a, spans[0], strict=True) for y, (t, u) in zip(ids_b, spans[1], strict=True) if s < u and t < e]
        digest = hashlib.sha256(";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True)).encode()).hexdigest() if ids_a else ""
        docs.append((i, len(ids_a), len(ids_b), len(both), pairs, digest))
    count = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((i, n, m, g, len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), h) for i, n, m, g, p, h in docs), key=str)


TEXTS = [
    None, "", " ", "plain words here", "plain words here", "  two  spaces\n\nand\ttabs ", "<|endoftext|> is text, <s> too</s>", "a literal ▁ mark", "naïve Ünïcode 漢字かな 🙂🙂 é", "\x00 and \x07", "<0x0A> <unk>",
    "12345678 3.14159 foo_bar(baz);", "x" * 3000, "internationalisation of untokenised tokenisers",
]


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 20}])
def test_against_brute_force(spark, sizes):
    rows = [*enumerate(TEXTS), (None, "plain words here"), (3, "plain words here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as a", "2 as batch", "'x' as pairs").repartition(3)
    out = crossing.align_tokenizers(df, **sizes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, out.collect()), key=str) == _brute(rows)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = crossing.align_tokenizers(docs)
    assert sorted(map(tuple, out.collect()), key=str) == _brute(rows)


def test_empty_table(spark):
    assert crossing.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stretches_give_the_same_cuts():
    a, b = crossing.byte_level(), crossing.pieces_of()
    text = "several words, cut in several ways " * 40
    found = crossing.aligned(text, a, b)
    ends = [np.cumsum(x.sizes[ids]) for x, ids in zip((a, b), found[:2], strict=True)]
    for stretch in (1, 7, 100):
        again = crossing.common_ends(*ends, stretch)
        assert all((x == y).all() for x, y in zip(again, found[2:4], strict=True))


def test_a_reader_meets_one_batch_at_once(spark, monkeypatch):
    kept, made = crossing.stored, {}
    monkeypatch.setattr(crossing, "stored", lambda df, name, **how: made.setdefault(name, kept(df, name, **how)))
    rows = [*enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = crossing.align_tokenizers(df, batch_bytes=20)
    assert sorted(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == _brute(rows)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made["token-batches"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) > len(files) and set(groups) == {1}
