"""Suffix-array dedup of byte strings by external induced sorting.

Equal strings of ``window`` bytes must meet in one shard, and shards should hold little besides them:

1. Windows that share one minimiser occurrence form a run. A minimiser that occurs once in the corpus leaves
   with its run; one whose runs are all the same string is settled at once.
2. Of the other runs one copy each is read from its source, and cut by distance to the minimiser into steps of
   ``STEP`` windows. All windows of a step contain its core, so steps are compared by minimiser, distance and
   core: unique ones leave, equal ones are settled.
3. What remains, distinct steps that share a core, is dealt to shards by that key, written end to end, and
   suffix-sorted by external induced sorting (``induced``). Suffixes next to each other whose common
   prefix reaches the window are repeats. A key whose steps take more than ``KEY_BYTES`` is split further: its
   windows are rows of their own, and equal ones are counted, so no shard is bound to one hot core.

All counts are of occurrences, within a document too. Spans go back to source coordinates; a text's kept
bytes are cut from its UTF-8 form and need not be valid UTF-8.

Cases: null texts count as empty; null ids and rows sharing an id are cut row by row (identical rows are
repeats of each other); texts shorter than the window stay whole; empty tables give empty results; only
the two named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_back, keyed, once, released, stored, utf8_parts
from .induced import repeated_starts

WINDOW = 200
MINIMISER = 32
STEP = 24
SHARD_BYTES = 3 << 20
KEY_BYTES = 1 << 18

U = np.uint64
_PATHS = "did long, th long, start int, n int, node long, path long"
_CONTENT = "node long, path long, times long, content binary"
_STEPS = "key long, sub long, node long, path long, times long, off int, n int"
_FOUND = "key long, sub long, offs array<int>"
_KEPT = "did long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def byte_paths(texts: DataFrame, window: int, k: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in utf8_parts(batch.column(2)):
                text, start, n, node, path = K.super_kmers(K.FIRST.table[data], K.SECOND.table[data], offsets, window, k)
                if len(text):
                    row = low + text
                    arrays = [pa.array(did[row]), pa.array(th[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), _signed(node), _signed(path)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["did", "th", "start", "n", "node", "path"])

    return texts.mapInArrow(cut, _PATHS)


def _contents(texts: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """The bytes of each source run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in utf8_parts(batch.column(0)):
                part = batch.column(1).slice(low, high - low)
                rows = part.flatten()
                base = np.repeat(offsets[:-1], np.asarray(pc.list_value_length(part)))
                start, n = (np.asarray(rows.field(i), np.int64) for i in (0, 1))
                begin, end = base + start, base + start + n + window - 1
                raw = data.tobytes()
                content = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.field(2), rows.field(3), rows.field(4), content], names=["node", "path", "times", "content"])

    asked = sources.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n", "node", "path", "times")).alias("asked"))
    once = texts.join(asked, ["did", "th"]).select("text", "asked")
    return once.mapInArrow(read, _CONTENT)


def _steps(contents: DataFrame, window: int, k: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, path, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for low, high, data, offsets in utf8_parts(batch.column(3)):
                sizes = np.diff(offsets)
                n = sizes - window + 1
                kmers = K.FIRST.windows(K.FIRST.prefix(K.FIRST.table[data]), k)
                packed = np.append((kmers & K.HIGH32) | np.arange(len(kmers), dtype=np.uint64), np.full(k, U(2**64 - 1)))[: len(data)]
                # K-mers that reach into the next run don't count.
                packed[np.concatenate([np.arange(e - k + 1, e) for e in offsets[1:].tolist()])] = U(2**64 - 1)
                place = (np.minimum.reduceat(packed, offsets[:-1]) & K.LOW32).astype(np.int64) - offsets[:-1]
                first, last = (place - n + 1) // STEP, place // STEP
                count = last - first + 1
                row = np.repeat(np.arange(high - low), count)
                j = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(0, place[row] - STEP * j - STEP + 1)
                end = np.minimum(n[row] - 1, place[row] - STEP * j) + 1
                base = offsets[:-1][row]
                whole = K.SECOND.bytes_prefix(data)
                core = K.SECOND.ranges(whole, base + place[row] - STEP * j, base + place[row] - STEP * j - STEP + 1 + window)
                own = node.view(np.uint64)[low + row]
                key = K.mix(own ^ K.mix(core + j.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
                third = K.THIRD.bytes_prefix(data)
                # The first window's distance belongs to a step's identity, as steps at an end of a run are partial.
                sub = K.mix(K.THIRD.ranges(third, base + begin, base + end - 1 + window) ^ (place[row] - begin).astype(np.uint64))
                at = low + row
                arrays = [_signed(key), _signed(sub), pa.array(node[at]), pa.array(path[at]), pa.array(times[at]), pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "sub", "node", "path", "times", "off", "n"])

    return contents.mapInArrow(cut, _STEPS)


def _sorted_shards(pieces: DataFrame, window: int, shards: int) -> DataFrame:
    """Windows of distinct pieces that start elsewhere in their shard too."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, subs, parts = [], [], []
        for batch in batches:
            keys.append(batch.column(0))
            subs.append(batch.column(1))
            parts += [x.as_buffer() for x in batch.column(2)]
        if not parts:
            return
        sizes = np.array([x.size for x in parts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.ones(int(sizes.sum()) + len(parts), np.int32)  # 1 ends a piece
        for a, x in zip(starts.tolist(), parts, strict=True):
            text[a : a + x.size] = np.frombuffer(x, np.uint8)
            text[a : a + x.size] += 2
        del parts
        again = repeated_starts(text, window)
        again[np.concatenate([np.arange(e - window + 1, e + 1) for e in (starts + sizes).tolist()])] = False
        at = np.flatnonzero(again)
        piece = np.searchsorted(starts, at, "right") - 1
        rows, counts = np.unique(piece, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array((at - starts[piece]).astype(np.int32)))
        pick = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.chunked_array(keys).combine_chunks().take(pick), pa.chunked_array(subs).combine_chunks().take(pick), lists], names=["key", "sub", "offs"])

    return pieces.select("key", "sub", "piece").repartition(shards, "key").mapInArrow(sort, _FOUND)


def _counted_windows(pieces: DataFrame, window: int) -> DataFrame:
    """``key, sub, more``: windows of distinct pieces that another piece of their key holds too.

    For keys with too many pieces for one shard: each window is a row of its own, and equal ones are counted."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("piece") - window)).alias("more")
    cut = pieces.select("key", "sub", "piece", at).select("key", "sub", "more", F.md5(F.expr(f"substring(piece, more + 1, {window})")).alias("h"))
    cut = stored(cut, "hot-windows")
    again = cut.groupBy("key", "h").agg(F.count("*").alias("times")).filter("times > 1").select("key", "h")
    return cut.join(stored(again, "hot-repeats"), ["key", "h"]).select("key", "sub", "more")


def repeated_byte_spans(texts: DataFrame, window: int = WINDOW, k: int = MINIMISER, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Runs of windows (did, th, start, n), each of which also starts elsewhere. texts: one row for each (did, th)."""
    paths = stored(byte_paths(texts, window, k), "paths")
    nodes = (
        paths.groupBy("node")
        .agg(F.count("*").alias("times"), F.min("path").alias("low"), F.max("path").alias("high"))
        .filter("times > 1")
        .select("node", (F.col("low") != F.col("high")).alias("branches"))
    )
    # Written first: the join then stands on two plain exchanges, whose hot partitions Spark splits.
    nodes = stored(nodes, "nodes")
    shared = stored(paths.join(nodes, "node"), "shared-paths")
    released(paths, nodes)
    plain = shared.filter("not branches").select("did", "th", "start", "n")
    branching = shared.filter("branches")
    sources = branching.groupBy("node", "path").agg(F.count("*").alias("times"), F.min(F.struct("did", "th", "start", "n")).alias("at"))
    sources = stored(sources.select("node", "path", "times", "at.*"), "path-sources")
    contents = stored(_contents(texts, sources, window), "contents")
    steps = stored(_steps(contents, window, k), "steps")
    keys = (
        steps.groupBy("key")
        .agg(F.sum("times").alias("total"), F.min("sub").alias("low"), F.max("sub").alias("high"), F.sum(F.col("n") + window).alias("bytes"))
        .filter("total > 1")
        .select("key", (F.col("low") != F.col("high")).alias("differ"), (F.col("bytes") > key_bytes).alias("hot"))
    )
    keys = stored(keys, "repeated-keys")
    any_hot = not keys.filter("hot and differ").isEmpty()
    repeated = stored(steps.join(keys, "key"), "repeated-steps")
    released(steps, keys)
    distinct = repeated.filter("differ").groupBy("key", "sub").agg(F.sum("times").alias("total"), F.max("hot").alias("hot"), F.min(F.struct("node", "path", "off", "n")).alias("at"))
    distinct = stored(distinct.select("key", "sub", "total", "hot", "at.*"), "distinct-steps")
    pieces = contents.select("node", "path", "content").join(distinct, ["node", "path"]).select("key", "sub", "hot", F.expr(f"substring(content, off + 1, n + {window - 1})").alias("piece"))
    volume = distinct.filter("not hot").agg(F.sum(F.col("n") + window)).first()[0] or 0
    found = _sorted_shards(pieces.filter("not hot"), window, max(1, -(-volume // SHARD_BYTES))).select("key", "sub", F.explode("offs").alias("more"))
    if any_hot:
        found = found.unionByName(_counted_windows(pieces.filter("hot"), window))
    single = repeated.filter("times = 1")
    settled = single.filter("not differ").select("node", "path", "off", "n")
    many = single.filter("differ").join(distinct.filter("total > 1").select("key", "sub"), ["key", "sub"]).select("node", "path", "off", "n")
    some = single.filter("differ").join(found, ["key", "sub"]).select("node", "path", (F.col("off") + F.col("more")).alias("off"), F.lit(1).alias("n"))
    offsets = settled.unionByName(many).unionByName(some)
    copied = branching.join(sources.filter("times > 1").select("node", "path"), ["node", "path"]).select("did", "th", "start", "n")
    once = sources.filter("times = 1").select("node", "path", "did", "th", "start")
    parts = once.join(offsets, ["node", "path"]).select("did", "th", (F.col("start") + F.col("off")).alias("start"), "n")
    return plain.unionByName(copied).unionByName(parts)


def _cut(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    kept_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in utf8_parts(batch.column(1)):
                sizes, kept, removed = np.diff(offsets), [], []
                for i in range(low, high):
                    own = data[offsets[i - low] : offsets[i - low + 1]]
                    asked, found = batch.column(2)[i], []
                    if asked.is_valid and len(asked.values):
                        start, n = (np.asarray(asked.values.field(j), np.int64) for j in (0, 1))
                        step = np.zeros(len(own) + 1, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + n + window - 1, -1)
                        gone = np.cumsum(step[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        found = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                        own = own[~gone]
                    kept.append(own.tobytes())
                    removed.append(found)
                arrays = [batch.column(0).slice(low, high - low), pa.array(sizes.astype(np.int64)), pa.array(kept, pa.binary()), pa.array(removed, kept_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=["did", "n_bytes", "kept", "spans"])

    return texts.join(spans, ["did", "th"], "left").select("did", "text", "spans").mapInArrow(cut, _KEPT)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts anywhere else.

    Returns ``doc_id, n_bytes, kept`` (binary) and ``spans`` (maximal removed runs, in bytes of the source text)."""
    if not STEP + k < window:
        raise ValueError("the window must be longer than a step and a minimiser together")
    texts = keyed(docs, id_col, text_col)
    single, many = once(texts)
    found = repeated_byte_spans(single.select("did", "th", "text"), window, k)
    if many is not None:
        # Rows that are equal in id and text repeat each other whole.
        size = F.octet_length("text") - window + 1
        found = found.unionByName(single.join(many, ["did", "th"], "left_semi").filter(size > 0).select("did", "th", F.lit(0).alias("start"), size.alias("n")))
    spans = found.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return _cut(texts, spans, window).select(id_back(F.col("did")).alias("doc_id"), "n_bytes", "kept", "spans")
