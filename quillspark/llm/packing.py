"""Packing documents into sequences of at most ``size`` tokens.

Each document's ids are cut into full sequences and a rest. The rests of a randomised group of documents
(hash of the id; groups of about ``group_docs`` documents, their number grows with the input) are packed by
first-fit decreasing: a tournament tree holds the free space of the bins, each inner node the larger of its
two children, so the first bin with room is found in logarithmic time. A group holds lengths and checksums
only; the ids stay with their documents.

Cases: null texts count as empty and still give one token (the end mark); null ids and repeated rows are
packed row by row (equal rows beyond a partition's first are dealt over all groups); ties in length go to the
smaller id; empty tables give empty results; only the two named columns are read."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SIZE = 2048
GROUP_DOCS = 2048
END_ID = 1
#: More than a group has sequences.
SEQUENCES = 1 << 24
VOCABULARY = "byte_bpe_50k"

_ENCODER: dict[str, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text to the ids that ``tokenizers`` gives with the vocabulary's .json file and ``add_special_tokens=False``.

    The file's added tokens are found first, as that library does; the text between goes through the same
    merges in the faster of two libraries (tested equal)."""
    if vocabulary not in _ENCODER:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        merges = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None

        def encode(text: str) -> list[int]:
            if marks is None or not marks.search(text):
                return merges.encode_ordinary(text)
            ids: list[int] = []
            for piece in marks.split(text):
                ids += [added[piece]] if piece in added else merges.encode_ordinary(piece)
            return ids

        _ENCODER[vocabulary] = encode
    return _ENCODER[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str, size: int, id_col: str, text_col: str, group: Column, groups: int | None = None) -> DataFrame:
    """One row a document: id, token count with the end mark, and the checksum of each cut of its ids.

    groups: their number, where repeated rows are to be dealt out: all but a partition's first of equal rows
    (same id and text) go to groups of their own hash, so that none holds them all."""
    schema = "doc_id long, th long, group long, n long, crcs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen: dict[tuple[int | None, int], int] = {}
        for batch in batches:
            counts, crcs = [], []
            dealt = batch.column(2).to_pylist()
            for i, row in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if groups else ():
                if turn := seen.get(row, 0):
                    dealt[i] = zlib.crc32(f"{row}|{part}|{turn}".encode()) % groups
                seen[row] = turn + 1
            for text in batch.column(3):
                ids = np.array([*encode(text.as_py() or ""), END_ID], np.dtype("<u4"))
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[a : a + size].tobytes()) for a in range(0, len(ids), size)])
            columns = [*batch.columns[:2], pa.array(dealt, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "group", "n", "crcs"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), group.cast("long").alias("group"), docs[text_col].alias("text"))
    return texts.mapInArrow(run, schema)


class Tournament:
    """Free space of the bins; finds the first bin with room for a length."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [size] * (2 * self.leaves)

    def first(self, length: int) -> int:
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < length:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, length: int) -> None:
        tree, at = self.tree, bin_ + self.leaves
        tree[at] -= length
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])


def first_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each length; longest first, ties in the given order."""
    tree = Tournament(max(1, len(lengths)), size)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first(lengths[i])
        out[i] = (b, size - tree.tree[b + tree.leaves])
        tree.take(b, lengths[i])
    return out


def packed(
    docs: DataFrame,
    size: int = SIZE,
    group_docs: int = GROUP_DOCS,
    seed: int = 17,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: Column | None = None,
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length``.

    group: a number below 2**39 for each row, where the documents come shuffled already; else a hash deals them."""
    groups = None
    if group is None:
        groups = max(1, -(-docs.count() // group_docs))
        group = F.pmod(F.xxhash64(F.lit(seed), docs[id_col].cast("long"), docs[text_col]), F.lit(groups))
    dealt = tokenised(docs, vocabulary, size, id_col, text_col, group, groups)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("th", "ascending")]))
        n, crcs = rows.column("n").to_pylist(), rows.column("crcs").to_pylist()
        out: dict[str, list[int]] = {k: [] for k in ("row", "start", "length", "ids_crc32", "bin", "offset")}

        def add(row: int, start: int, length: int, crc: int, bin_: int, offset: int) -> None:
            for k, v in zip(out, (row, start, length, crc, bin_, offset), strict=True):
                out[k].append(v)

        rests = [i for i, x in enumerate(n) if x % size]
        places = first_fit_decreasing([n[i] % size for i in rests], size)
        used = max((b for b, _ in places), default=-1) + 1
        for i, (b, offset) in zip(rests, places, strict=True):
            add(i, n[i] - n[i] % size, n[i] % size, crcs[i][-1], b, offset)
        for i, x in enumerate(n):
            for k in range(x // size):
                add(i, k * size, size, crcs[i][k], used, 0)
                used += 1
        if used >= SEQUENCES:
            raise ValueError("a group holds too many sequences; take smaller groups")
        row = pa.array(out["row"], pa.int64())
        bins = np.array(out["bin"], np.int64)
        filled = np.bincount(bins, out["length"], used).astype(np.int64) if used else np.zeros(0, np.int64)
        return pa.table(
            {
                "doc_id": rows.column("doc_id").take(row),
                "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()),
                "ids_crc32": pa.array(out["ids_crc32"], pa.int64()),
                "doc_tokens": rows.column("n").take(row),
                "sequence_id": pa.array(group * SEQUENCES + bins),
                "offset": pa.array(out["offset"], pa.int64()),
                "sequence_length": pa.array(filled[bins]),
            }
        )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return dealt.groupBy("group").applyInArrow(run, schema)
