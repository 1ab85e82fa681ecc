"""Cross-tokenizer alignment: groups of tokens between common cuts, and links between overlapping tokens.

Each text is encoded by both tokenizers, and both id lists are cut where tokens of both end at one byte: the
cumulative ends of either list go into a dictionary from end to index, the keys that both hold are sorted, and each
pair of neighbours slices both lists into a group. A slice's tokens are linked where their bytes overlap: every
stretch between two ends next to each other, of either list, lies in one token of each, and no two in the same pair.
The dictionaries hold a stretch of ``STRETCH`` bytes at once, whatever the length of a text.

Counts: how many documents hold an id pair linked. Documents are taken in batches of about ``BATCH_BYTES`` of text
(a longer one alone). A batch holds its distinct pairs once, with the number of its documents that have them, and each
document points into that list. So what is shuffled and joined is a row for each distinct pair of a batch, not of a
document, and no pair can be hot: it has one row a batch, and sums combine before the shuffle. Batches are written
first, so texts are encoded once; each is a row group of its own, so a task holds one, however many its file has.

Cases: texts that are null or empty, or whose joined token bytes differ from the text behind a space (a literal
U+2581, say), have no tokens: zeros and an empty digest; special tokens' strings are plain text; rows with a null id or
sharing an id are documents of their own; an empty table gives an empty result; only the two named columns are read."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored

VOCABULARY_A = "byte_bpe_50k"
VOCABULARY_B = "piece_bpe_32k"
BATCH_BYTES = 8 << 20
STRETCH = 1 << 13

_BATCHES = """batch string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
    pairs array<int>, index array<int>, times array<int>, a array<int>, b array<int>, docs array<int>"""
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Tokens:
    """A tokenizer: ``encode`` gives the ids of a text behind a space and the bytes of its tokens, joined (none: not the text's); each id's size."""

    encode: Callable[[str], tuple[np.ndarray, bytes | None]]
    sizes: np.ndarray
    digits: np.ndarray = field(init=False)
    width: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        names = [str(i).encode() for i in range(len(self.sizes))]
        self.width = np.array([len(x) for x in names], np.uint64)
        # Decimal ids as eight bytes each, with room for what follows.
        self.digits = np.frombuffer(b"".join(x.ljust(8, b"\0") for x in names), "<u8")


_LOADED: dict[str, Tokens] = {}


def byte_level(vocabulary: str = VOCABULARY_A) -> Tokens:
    """Ids are those of the .json file of that name with ``encode_special_tokens``; the same ranks serve in the faster library (tested equal)."""
    if vocabulary not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merges = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for x, i in ranks.items():
            sizes[i] = len(x)

        def encode(text: str) -> tuple[np.ndarray, bytes | None]:
            # These tokens are cuts of the text's own bytes, so their sizes say all.
            ids = merges.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            whole = b" " + text.encode()
            return ids, whole if sizes[ids].sum() == len(whole) else None

        _LOADED[vocabulary] = Tokens(encode, sizes)
    return _LOADED[vocabulary]


def pieces_of(vocabulary: str = VOCABULARY_B) -> Tokens:
    """Ids of the .model file of that name, which puts a space before a text itself."""
    if vocabulary not in _LOADED:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        pieces = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

        def encode(text: str) -> tuple[np.ndarray, bytes | None]:
            ids = model.encode(text)
            return np.fromiter(ids, np.int64, len(ids)), b"".join(map(pieces.__getitem__, ids))

        _LOADED[vocabulary] = Tokens(encode, np.array([len(x) for x in pieces]))
    return _LOADED[vocabulary]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either list end at or before each common end, in order."""
    to_a, to_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, int(ends_a[-1]) if len(ends_a) else 0, stretch):
        (a0, a1), (b0, b1) = (np.searchsorted(x, [low, low + stretch], "right").tolist() for x in (ends_a, ends_b))
        at_a = dict(zip((ends_a[a0:a1] - low).tolist(), range(a0 + 1, a1 + 1)))  # noqa: B905
        at_b = dict(zip((ends_b[b0:b1] - low).tolist(), range(b0 + 1, b1 + 1)))  # noqa: B905
        keys = list(filter(at_b.__contains__, at_a))  # in order, as the first dictionary is
        to_a.append(np.fromiter(map(at_a.__getitem__, keys), np.int64, len(keys)))
        to_b.append(np.fromiter(map(at_b.__getitem__, keys), np.int64, len(keys)))
    return np.concatenate(to_a), np.concatenate(to_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the overlapping tokens, a stretch between neighbouring ends for each pair."""
    at_a, at_b = (np.zeros(int(ends_a[-1]) + 1, bool) for _ in range(2))
    at_a[ends_a] = at_b[ends_b] = True
    ends = np.flatnonzero(at_a | at_b)
    # Ends before this one: that many tokens are over.
    return tuple(np.cumsum(x) - x for x in (at_a[ends].astype(np.int64), at_b[ends].astype(np.int64)))


def groups_text(a: Tokens, b: Tokens, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    # A group's A ids stand after the B ids of all groups before it, its B ids after its A ids.
    size_a, size_b = (np.concatenate([c[:1], c[1:] - c[:-1]]) for c in (cut_a, cut_b))
    place_a = np.arange(len(ids_a)) + np.repeat(np.concatenate([[0], cut_b[:-1]]), size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(cut_a, size_b)
    n = len(ids_a) + len(ids_b)
    rows, width, after = np.empty(n, "<u8"), np.empty(n, np.uint64), np.full(n, ord(","), np.uint64)
    rows[place_a], rows[place_b] = a.digits[ids_a], b.digits[ids_b]
    width[place_a], width[place_b] = a.width[ids_a], b.width[ids_b]
    after[place_a[cut_a - 1]], after[place_b[cut_b - 1]] = ord("|"), ord(";")
    rows |= after << (width * np.uint64(8))
    return rows.tobytes().translate(None, b"\0")[:-1]


def aligned(text: str | None, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Both id lists, the cuts of both, and the indices of all links; nothing where the tokens don't give the text back."""
    if not text:
        return None
    want = b" " + text.encode()
    (ids_a, whole_a), (ids_b, whole_b) = a.encode(text), b.encode(text)
    if whole_a != want or whole_b != want:
        return None
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    return ids_a, ids_b, *common_ends(ends_a, ends_b), *links(ends_a, ends_b)


def _batched(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, batch_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each batch of documents: what each has, and the batch's distinct pairs, to which ``index`` and ``times`` point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(vocabulary_a), pieces_of(vocabulary_b)
        base = len(b.sizes)
        rows: list[tuple] = []
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def batch() -> pa.RecordBatch:
            every = np.concatenate(keys)
            code, pairs = pd.factorize(every)
            order = np.argsort(pairs)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs, index = pairs[order], place[code]
            held = [*zip(*rows, strict=True)]
            columns = [uuid.uuid4().hex, *held, [len(k) for k in keys], index.astype(np.int32), np.concatenate(times), (pairs // base).astype(np.int32), (pairs % base).astype(np.int32), np.bincount(index, minlength=len(pairs)).astype(np.int32)]
            kinds = [pa.string(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, kinds, strict=True)], names=names)

        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                found = aligned(text, a, b)
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, ""))
                    keys.append(np.zeros(0, np.int64))
                    times.append(np.zeros(0, np.int32))
                else:
                    ids_a, ids_b, cut_a, cut_b, at_a, at_b = found
                    digest = hashlib.sha256(groups_text(a, b, ids_a, ids_b, cut_a, cut_b)).hexdigest()
                    rows.append((doc_id, len(ids_a), len(ids_b), len(cut_a), len(at_a), digest))
                    key, n = np.unique(ids_a[at_a] * base + ids_b[at_b], return_counts=True)
                    keys.append(key)
                    times.append(n.astype(np.int32))
                size += len(text or "")
                if size >= batch_bytes or len(rows) >= 1 << 16:
                    yield batch()
                    rows, keys, times, size = [], [], [], 0
        if rows:
            yield batch()

    names = [x.split()[0] for x in _BATCHES.split(",")]
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, _BATCHES)


def align_tokenizers(
    docs: DataFrame,
    vocabulary_a: str = VOCABULARY_A,
    vocabulary_b: str = VOCABULARY_B,
    batch_bytes: int = BATCH_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    bounded_batches(docs.sparkSession)
    batches = stored(_batched(docs, vocabulary_a, vocabulary_b, batch_bytes, id_col, text_col), "token-batches", group_rows=1)
    pairs = batches.select("batch", F.explode(F.arrays_zip("a", "b", "docs")).alias("x")).select("batch", "x.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # An A id has no more pairs than B has ids.
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    known = pairs.select("batch", "a", "b").join(stored(counts, "pair-counts"), ["a", "b"])
    # In the order of a batch's own list: by A id, then B id.
    known = known.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("a", "b", "count", "best"))).alias("x")).select("batch", F.col("x.count").alias("count"), F.col("x.best").alias("best"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "index", "times"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                doc_id, n_a, n_b, n_groups, n_links, digests, held = (part.column(k)[i].values for k in range(7))
                index, times = (part.column(k)[i].values.to_numpy() for k in (7, 8))
                sums = []
                for k in (10, 9):
                    value = part.column(k)[i]
                    weight = np.append(0, np.cumsum(times * (value.values.to_numpy(zero_copy_only=False).astype(np.int64)[index] if value.is_valid else 0)))
                    ends = np.cumsum(held.to_numpy())
                    sums.append(pa.array(weight[ends] - weight[ends - held.to_numpy()]))
                yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, n_links, *sums, digests], names=[x.split()[0] for x in _ALIGNED.split(", ")])

    return batches.select("batch", *own).join(known, "batch", "left").select(*own, "count", "best").mapInArrow(run, _ALIGNED)
