"""Line dedup by pairwise alignment: patience diff of documents that share rare lines.

Lines are compared without their outer white space; blank lines only keep their place. A block is a run of
adjacent lines that an earlier document (smaller id) holds as adjacent lines too; blocks of ``min_lines``
lines or ``min_bytes`` bytes go from the later document.

Pairs: a block holds a window of lines that is just long enough, and each window proposes one partner for
every later holder: its first holder. So there are no more pairs than windows, however often a window occurs. Lines
that no other document has propose nothing, and lines that are common by themselves only as part of a window.

Alignment: of a pair all lines are aligned that either shares with any other document in a window. Lines that
are rare, once in each of the two, are the anchors; the longest run of anchors rising in both is kept
(patience), and each anchor grows over equal neighbours. What is left between two anchors is aligned in the
same way, with rarity counted within; where no line is rare, a longest common subsequence is taken. Blocks found
leave the later document, and what is left of it is aligned again until there is no further block: so passages that
were moved, or stand there twice, are aligned too. A block grows over equal neighbours that are gone already. Nothing goes that this diff does not align.

Lines are told apart by digests (BLAKE2b, 128 bits); the 64-bit keys of windows only propose pairs.

Cases: null or empty texts have no lines; rows that share an id are one age, neither is later; null ids
are later than all others; repeated rows get equal results; empty tables give empty results; only the two
named columns are read."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import id_back, keyed, once, released, stored, utf8_parts

MIN_LINES = 2
MIN_BYTES = 32

#: Documents that share this much of their runs of five words are near copies.
COPY_OVER, COPY_UNDER = 3, 4

#: Bits of the table of one longest common subsequence, at most: 32 MB.
TABLE_BITS = 1 << 28

_KEPT = "did long, n_lines long, n_removed long, n_blocks long, n_bytes long, kept_text string"


def _full_lines(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: (first row, end row, text of each non-blank line, its digest in halves, bytes, words)."""
    for low, high, data, offsets in utf8_parts(column):
        starts, ends, bounds = K.word_bounds(data, offsets)
        if not len(starts):
            continue
        # A word begins a line if a newline or the start of its text lies between it and the word before.
        breaks = np.cumsum(data == 10)
        line = breaks[starts]
        text = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        a, b, of = starts[first], ends[last], text[first]
        raw = data.tobytes()
        digests = b"".join([blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        h, g = np.frombuffer(digests, np.uint64).reshape(-1, 2).T.copy()
        yield low, high, of, h, g, b - a, last - first + 1


def _rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors that rises in both documents, by piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, e) in enumerate(anchors):
        p = bisect_left(tops, e)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(e)
            piles.append(i)
        else:
            tops[p], piles[p] = e, i
    run = []
    i = piles[-1] if piles else -1
    while i >= 0:
        run.append(anchors[i])
        i = back[i]
    return run[::-1]


def _lengths(a: list, b: list) -> Iterator[int]:
    """After each item of a, a number whose zero bits are the steps of the common length along b."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    for v in _lengths(a, b):
        last = v
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def common(a: list, b: list, bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """A longest common subsequence, as late in a as can be; halves of a in turn where the table is above ``bits``."""
    if len(a) > 1 and len(a) * len(b) > bits:
        half = len(a) // 2
        j = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        return common(a[:half], b[:j], bits) + [(p + half, q + j) for p, q in common(a[half:], b[j:], bits)]
    rows = list(_lengths(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff of two documents, the later one first: aligned places, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), False, False)]
    while todo:
        # left, right: an anchor bounds the range there, and grows over equal neighbours.
        d0, d1, e0, e1, left, right = todo.pop()
        while left and d0 < d1 and e0 < e1 and a[d0] == b[e0]:
            out.append((d0, e0))
            d0, e0 = d0 + 1, e0 + 1
        while right and d0 < d1 and e0 < e1 and a[d1 - 1] == b[e1 - 1]:
            d1, e1 = d1 - 1, e1 - 1
            out.append((d1, e1))
        own: dict = {}
        for p in range(d0, d1):
            own.setdefault(a[p], []).append(p)
        other: dict = {}
        for p in range(e0, e1):
            if b[p] in own:
                other.setdefault(b[p], []).append(p)
        anchors = sorted((own[x][0], q[0]) for x, q in other.items() if len(q) == len(own[x]) == 1)
        if anchors:
            run = _rising(anchors)
            out += run
            ends = [(d0 - 1, e0 - 1), *run, (d1, e1)]
            for n in range(len(ends) - 1):
                (p, q), (r, s) = ends[n], ends[n + 1]
                todo.append((p + 1, r, q + 1, s, left or n > 0, right or n + 2 < len(ends)))
        elif other:
            d = sorted(p for x in other for p in own[x])
            e = sorted(p for q in other.values() for p in q)
            out += [(d[i], e[j]) for i, j in common([a[p] for p in d], [b[p] for p in e])]
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], later: dict[int, object], earlier: dict[int, object], size: dict[int, int], min_lines: int, min_bytes: int) -> list[tuple[int, int, int]]:
    """Runs (first place, first place in the earlier, number of lines) that are long enough. size: bytes of the later one's lines.

    A run grows over equal neighbours, which may have been aligned elsewhere."""
    out, i = [], 0
    while i < len(aligned):
        j = i + 1
        while j < len(aligned) and aligned[j][0] == aligned[j - 1][0] + 1 and aligned[j][1] == aligned[j - 1][1] + 1:
            j += 1
        (p, q), n = aligned[i], j - i
        while p - 1 in later and later[p - 1] == earlier.get(q - 1):
            p, q, n = p - 1, q - 1, n + 1
        while p + n in later and later[p + n] == earlier.get(q + n):
            n += 1
        if n >= min_lines or sum(size[p + k] for k in range(n)) >= min_bytes:
            out.append((p, q, n))
        i = j
    return out


def shared_blocks(later: dict[int, object], earlier: dict[int, object], size: dict[int, int], min_lines: int, min_bytes: int) -> list[tuple[int, int, int]]:
    """Blocks (first place in the later, in the earlier, number of lines). later, earlier: lines by place, in order."""
    left, found = dict(later), []
    other, values = list(earlier), list(earlier.values())
    while left:
        at = list(left)
        now = blocks([(at[i], other[j]) for i, j in align(list(left.values()), values)], later, earlier, size, min_lines, min_bytes)
        if not now:
            break
        found += now
        for p, _, n in now:
            for k in range(n):
                left.pop(p + k, None)
    return found


def sequences(texts: DataFrame) -> DataFrame:
    """``did, th, h, g, size, words``: the non-blank lines of each text in order, the halves of each one's digest, its bytes and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, of, h, g, size, words in _full_lines(batch.column(2)):
                head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                bounds = pa.array(np.append(head, len(of)).astype(np.int32))
                at = pa.array(low + of[head])
                held = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (h.view(np.int64), g.view(np.int64), size.astype(np.int32), words.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *held], names=["did", "th", "h", "g", "size", "words"])

    return texts.mapInArrow(run, "did long, th long, h array<long>, g array<long>, size array<int>, words array<int>")


def _windows(h: np.ndarray, size: np.ndarray, owner: np.ndarray, min_lines: int, min_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lines of a window, first places, keys: of windows of ``min_lines`` lines and of shorter ones of ``min_bytes``.

    A window whose lines all lie in shorter ones within it says nothing new and is left out."""
    total = np.append(0, np.cumsum(size, dtype=np.int64))
    key = np.zeros(len(h), np.uint64)
    shorter: dict[int, np.ndarray] = {}
    for n in range(1, min(min_lines, len(h)) + 1):
        m = len(h) - n + 1
        key = K.mix(key[:m] ^ h[n - 1 :])
        fits = owner[:m] == owner[n - 1 :]
        if n < min_lines:
            fits &= total[n:] - total[:m] >= min_bytes
        known = np.full(m, n > 1)
        for k in range(n):
            line = np.zeros(m, bool)
            for w, q in shorter.items():
                for s in range(max(0, k - w + 1), min(k, n - w) + 1):
                    line |= q[s : s + m]
            known &= line
        shorter[n] = fits
        at = np.flatnonzero(fits & ~known)
        yield n, at, key[at]


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without nulls."""
    bounds = column.offsets.to_numpy()
    return column.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False), bounds - bounds[0]


def window_rows(seqs: DataFrame, min_lines: int, min_bytes: int) -> DataFrame:
    """``did, th, key, n, at``: a row for each distinct window of each text, its lines and all its first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, bounds), (size, _) = _list_values(batch.column(2)), _list_values(batch.column(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            for n, at, key in _windows(h.view(np.uint64), size, owner, min_lines, min_bytes):
                if not len(at):
                    continue
                order = np.lexsort((at, key, owner[at]))
                at, key = at[order], key[order]
                row = owner[at]
                head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array((at - bounds[row]).astype(np.int32)))
                row = pa.array(row[head])
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(key[head].view(np.int64)), pa.array(np.full(len(head), n, np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["did", "th", "key", "n", "at"])

    return seqs.select("did", "th", "h", "size").mapInArrow(run, "did long, th long, key long, n int, at array<int>")


_PASSAGES = "did long, th long, total long, at array<int>, h array<long>, g array<long>, size array<int>, words array<int>, partners array<struct<edid:long,eth:long>>"
_ALIGNED = "did long, th long, edid long, eth long, start int, estart int, n int, near boolean"


def _passages(marked: DataFrame) -> DataFrame:
    """Of each text the words of all its lines, and the lines that lie in the marked windows, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, bounds), (g, _), (size, _), (words, _) = (_list_values(batch.column(i)) for i in (2, 3, 4, 5))
            took, counts = [], []
            for i, marks in enumerate(batch.column(6)):
                at, ends = _list_values(marks.values.field(1))
                n = np.repeat(marks.values.field(0).to_numpy(), np.diff(ends))
                step = np.zeros(bounds[i + 1] - bounds[i] + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + n, -1)
                took.append(np.flatnonzero(np.cumsum(step[:-1]) > 0))
                counts.append(len(took[-1]))
            if not took:
                continue
            at = np.concatenate(took)
            own = at + np.repeat(bounds[:-1], counts)
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), h[own], g[own], size[own], words[own])]
            every = np.append(0, np.cumsum(words, dtype=np.int64))
            total = pa.array(every[bounds[1:]] - every[bounds[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), total, *lists, batch.column(7)], names=["did", "th", "total", "at", "h", "g", "size", "words", "partners"])

    return marked.select("did", "th", "h", "g", "size", "words", "marks", "partners").mapInArrow(run, _PASSAGES)


def aligned_blocks(texts: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``did, th, edid, eth, start, estart, n, near``: blocks of each later text, and where an earlier one has them.

    near: the pair's blocks alone hold ``COPY_OVER / COPY_UNDER`` of both texts' runs of five words, shared ones counted once."""
    seqs = stored(sequences(texts), "sequences")
    windows = stored(window_rows(seqs, min_lines, min_bytes), "windows")
    first = windows.groupBy("key").agg(F.min(F.struct("did", "th")).alias("first"), F.max("did").alias("high")).filter("first.did < high")
    # Written first: the join then stands on two plain exchanges, whose hot partitions Spark splits.
    first = stored(first.select("key", "first"), "first-holders")
    partner = F.when(F.col("did") > F.col("first.did"), F.struct(F.col("first.did").alias("edid"), F.col("first.th").alias("eth")))
    shared = windows.join(first, "key").select("did", "th", F.struct("n", "at").alias("mark"), partner.alias("partner"))
    marked = stored(shared.groupBy("did", "th").agg(F.collect_list("mark").alias("marks"), F.collect_set("partner").alias("partners")), "marks")
    released(windows, first)
    joined = marked.join(seqs, ["did", "th"])
    passages = stored(_passages(joined), "passages")
    released(marked, seqs)
    pairs = passages.select("did", "th", "total", "at", "h", "g", "size", "words", F.explode("partners").alias("e")).select("e.edid", "e.eth", "did", "th", "total", "at", "h", "g", "size", "words")
    earlier = passages.select(F.col("did").alias("edid"), F.col("th").alias("eth"), F.col("total").alias("etotal"), F.col("at").alias("eat"), F.col("h").alias("eh"), F.col("g").alias("eg"))

    def lines_of(at: pa.ListScalar, h: pa.ListScalar, g: pa.ListScalar) -> dict[int, object]:
        return dict(zip(at.values.to_numpy().tolist(), zip(h.values.to_numpy().tolist(), g.values.to_numpy().tolist(), strict=True), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The join brings the pairs of one earlier text one after the other.
        known, other = None, {}
        for batch in batches:
            row, found, near = [], [], []
            for i, (edid, eth, at, h, g, size, eat, eh, eg, words, total, etotal) in enumerate(zip(*(batch.column(k) for k in (0, 1, *range(4, 14))), strict=True)):
                if (key := (edid.as_py(), eth.as_py())) != known:
                    known, other = key, lines_of(eat, eh, eg)
                later = lines_of(at, h, g)
                sizes = dict(zip(later, size.values.to_numpy().tolist(), strict=True))
                own = shared_blocks(later, other, sizes, min_lines, min_bytes)
                said = dict(zip(later, words.values.to_numpy().tolist(), strict=True))
                # Runs of five words within the blocks: none of the first four words of a block ends one.
                both = sum(said[p] for p in {p + k for p, _, n in own for k in range(n)}) - 4 * len(own)
                row += [i] * len(own)
                found += own
                near += [both > 0 and COPY_UNDER * both >= COPY_OVER * (total.as_py() + etotal.as_py() - 8 - both)] * len(own)
            take = pa.array(row, pa.int64())
            ends = [batch.column(k).take(take) for k in (2, 3, 0, 1)]
            yield pa.RecordBatch.from_arrays(ends + [pa.array([x[k] for x in found], pa.int32()) for k in range(3)] + [pa.array(near, pa.bool_())], names=["did", "th", "edid", "eth", "start", "estart", "n", "near"])

    ordered = ["edid", "eth", "did", "th", "at", "h", "g", "size", "eat", "eh", "eg", "words", "total", "etotal"]
    return pairs.join(earlier, ["edid", "eth"]).select(*ordered).mapInArrow(run, _ALIGNED)


def _cut(texts: DataFrame, found: DataFrame, carry: bool = False) -> DataFrame:
    columns = ["did", "text", "spans", "near_copy"] + ["row"] * carry
    schema = T.StructType.fromDDL(_KEPT).add("near_copy", "boolean")
    if carry:
        schema.add("row", texts.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows: list[tuple] = []
                for did, text, spans in zip(*(part.column(i) for i in range(3)), strict=True):
                    lines = text.as_py().encode().split(b"\n")
                    full = [i for i, x in enumerate(lines) if not x.isspace() and x]
                    gone: set[int] = set()
                    places: set[int] = set()
                    for s in spans.as_py() or ():
                        places.update(range(s["start"], s["start"] + s["n"]))
                    # Spans found with different partners can overlap: a block is a run of removed lines.
                    n = sum(p - 1 not in places for p in places)
                    gone.update(full[p] for p in places)
                    kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                    rows.append((did.as_py(), len(full), len(gone), n, sum(map(len, lines)) + len(lines) - 1, b"\n".join(kept).decode()))
                types = [pa.int64()] * 5 + [pa.string()]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(made + part.columns[3:], names=schema.names)

    return texts.join(found, ["did", "th"], "left").select(*columns).mapInArrow(run, schema)


def remove_shared_blocks(docs: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_blocks, n_bytes, kept_text, near_copy``, a row for each row of docs.

    ``n_bytes`` is the size before the cut; ``near_copy``: the lines that one earlier document alone shares with it hold
    three quarters of the runs of five words of both; ``carry`` adds the columns of docs other than the text, in a struct ``row``."""
    texts = keyed(docs, id_col, text_col, carry)
    # Repeated rows are one text.
    found = aligned_blocks(once(texts)[0].select("did", "th", "text"), min_lines, min_bytes)
    spans = found.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.max("near").alias("near_copy"))
    kept = _cut(texts, spans, carry)
    return kept.select(id_back(F.col("did")).alias("doc_id"), "n_lines", "n_removed", "n_blocks", "n_bytes", "kept_text", F.coalesce("near_copy", F.lit(False)).alias("near_copy"), *["row"] * carry)
