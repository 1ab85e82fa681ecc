"""Substring dedup by de Bruijn compaction.

The graph's edges are token k-mers: every window of ``window`` words. Building it edge by edge would
shuffle one row a word, so edges travel as paths from the start: consecutive windows that share one
minimiser occurrence (a super-k-mer). Equal windows always meet under the same minimiser, because a
window's minimiser depends on the window alone. Then Spark joins compact:

* a minimiser seen in one document only holds no repeat across documents and leaves;
* a minimiser whose paths are all the same string is one repeated path. Where two such paths meet in a
  vertex with in-degree one (the second always follows the first) and out-degree one (both occur just as
  often), they are one; a join finds these vertices, and source order closes each chain into a unitig,
  of which all occurrences are known from those of its first path;
* where paths of a minimiser differ, the graph branches: one copy of each distinct path is expanded
  from its source coordinates into its edges, and the edges decide.

Unitigs, branching paths and edges are then read from their source coordinates, and digests of their
words verify them: hashes only propose what may be equal. The spans found go back to source coordinates,
and words are cut from there. Rows shuffled are about a twentieth of the words, plus the edges round
branches; a hot passage collapses before the shuffle.

Cases: null or empty texts have no words; rows that share an id are compared as one document and
removed spans are kept by row; null ids count as later than all others and never as earlier;
repeated rows get equal results; empty tables give empty results; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_back, keyed, released, stored, utf8_parts

WINDOW = 50
MINIMISER = 10

_PATHS = "did long, th long, start int, n int, node long, path long, before long"
_PROVEN = "did long, th long, start int, n int, node long, path long, open boolean, digest binary, edges array<binary>"
_KEPT = "did long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,length:int>>"


def _word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = K.word_bounds(data, offsets)
    return K.word_hashes(K.FIRST, data, starts, ends), K.word_hashes(K.SECOND, data, starts, ends), bounds


def word_paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """The paths (super-k-mers) of every text in source coordinates (words), and the path before each (null: none)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in utf8_parts(batch.column(2)):
                first, second, bounds = _word_values(data, offsets)
                text, start, n, node, path = K.super_kmers(first, second, bounds, window, k)
                if len(text):
                    row, path = low + text, path.view(np.int64)
                    opens = np.append(True, text[1:] != text[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(did[row]),
                            pa.array(th[row]),
                            pa.array(start.astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                            pa.array(node.view(np.int64)),
                            pa.array(path),
                            pa.array(np.roll(path, 1), mask=opens),
                        ],
                        names=["did", "th", "start", "n", "node", "path", "before"],
                    )

    return docs.mapInArrow(cut, _PATHS)


def unitigs(plain: DataFrame) -> DataFrame:
    """Repeated paths compacted along nonbranching vertices: ``node`` of the first path, ``n`` windows.

    Reads the occurrences of paths that are alone under their minimiser: ``low`` is the first document,
    ``times`` the number of occurrences, ``before`` the path that all of them follow (null: none or several)."""
    first = plain.filter("did = low").groupBy("node", "did").agg(F.min(F.struct("th", "start", "n", "path", "before", "times")).alias("at"))
    first = stored(first.select("node", "did", "at.*"), "first-paths")
    ends = first.select(F.col("path").alias("before"), "times").distinct().withColumn("follows", F.lit(True))
    # Paths without a path before are heads already; as nulls of the join they would meet in one task.
    linked = first.filter("before is not null").join(ends, ["before", "times"], "left")
    linked = linked.unionByName(first.filter("before is null").withColumn("follows", F.lit(None).cast("boolean")))
    order = Window.partitionBy("did", "th").orderBy("start")
    adjacent = F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")
    heads = linked.withColumn("head", ~F.coalesce(F.col("follows") & adjacent, F.lit(False)))
    chains = heads.withColumn("chain", F.sum(F.col("head").cast("long")).over(order)).groupBy("did", "th", "chain")
    return chains.agg(F.min(F.struct("start", "node")).alias("at"), F.sum("n").cast("int").alias("n")).select("at.node", "n")


def _laid(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words with one space after each, and where each begins there."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    laid = np.full(at[-1], 32, np.uint8)
    flat = data[~K.SPACE[data]]
    laid[np.arange(len(flat)) + np.repeat(np.arange(len(starts)), sizes)] = flat
    return memoryview(laid), at


def _proven(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """Digests of the asked runs, read from their source coordinates; of each window too where it is ``open``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th, wanted = batch.column(0), batch.column(1), batch.column(3)
            for low, high, data, offsets in utf8_parts(batch.column(2)):
                part = wanted.slice(low, high - low)
                rows = part.flatten()
                if not len(rows):
                    continue
                starts, ends, bounds = K.word_bounds(data, offsets)
                laid, at = _laid(data, starts, ends)
                text = np.repeat(np.arange(low, high), np.asarray(pc.list_value_length(part)))
                start, n, _, _, opened = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                base = bounds[text - low] + start

                def digest(a: int, b: int) -> bytes:
                    return hashlib.blake2b(laid[at[a] : at[b]], digest_size=16).digest()

                for i in range(0, len(rows), 1 << 12):
                    j = slice(i, i + (1 << 12))
                    runs = list(zip(base[j].tolist(), n[j].tolist(), opened[j].tolist(), strict=True))
                    whole = [digest(a, a + c + window - 1) for a, c, _ in runs]
                    each = [[digest(b, b + window) for b in range(a, a + c)] if o else None for a, c, o in runs]
                    took = rows.slice(i, len(runs))
                    yield pa.RecordBatch.from_arrays(
                        [did.take(pa.array(text[j])), th.take(pa.array(text[j])), *(took.field(f) for f in range(5)), pa.array(whole, pa.binary()), pa.array(each, pa.list_(pa.binary()))],
                        names=["did", "th", "start", "n", "node", "path", "open", "digest", "edges"],
                    )

    # A set: rows that share id and text ask for the same runs.
    asked = asked.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n", "node", "path", "open")).alias("asked"))
    return docs.join(asked, ["did", "th"]).select("did", "th", "text", "asked").mapInArrow(read, _PROVEN)


def _cut(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"did": [], "n_words": [], "n_removed": [], "kept_text": [], "spans": []}
            held = 0
            for did, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                removed: list[dict[str, int]] = []
                if asked.is_valid and len(asked.values):
                    start, n = (np.asarray(asked.values.field(i), np.int64) for i in (0, 1))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, np.minimum(start + n + window - 1, len(words)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    removed = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    kept = words
                rows["did"].append(did)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(len(words) - len(kept))
                rows["kept_text"].append(b" ".join(kept).decode())
                rows["spans"].append(removed)
                held += len(rows["kept_text"][-1])
                if held > 8 << 20:
                    yield _kept_batch(rows)
                    rows, held = {k: [] for k in rows}, 0
            yield _kept_batch(rows)

    return docs.join(spans, ["did", "th"], "left").select("did", "text", "spans").mapInArrow(cut, _KEPT)


def _kept_batch(rows: dict[str, list]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
    types = {"did": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "spans": pa.list_(span)}
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in rows.items()], names=list(rows))


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER) -> DataFrame:
    """Runs of windows (did, th, start, n) whose words also start in a document with a smaller id."""
    paths = stored(word_paths(docs, window, k), "paths")
    seen = [f(c).alias(f"{c}_{name}") for c in ("did", "path", "before") for name, f in (("low", F.min), ("high", F.max))]
    # Degrees: one path before all occurrences, if none opens a text.
    one = (F.col("before_low") == F.col("before_high")) & (F.col("followers") == F.col("times"))
    nodes = (
        paths.groupBy("node")
        .agg(*seen, F.count("before").alias("followers"), F.count("*").alias("times"))
        .filter("did_low < did_high")
        .select("node", F.col("did_low").alias("low"), (F.col("path_low") != F.col("path_high")).alias("branches"), F.when(one, F.col("before_low")).alias("before"), "times")
    )
    # Written first: the join then stands on two plain exchanges, whose hot partitions Spark splits.
    nodes = stored(nodes, "nodes")
    shared = stored(paths.drop("before").join(nodes, "node"), "shared-paths")
    released(paths, nodes)
    runs = ["did", "th", "start", "n", "node", "path"]
    plain, branching = shared.filter("not branches"), shared.filter("branches").select(runs)
    # A unitig's occurrences are those of its first path.
    units = stored(unitigs(plain), "unitigs")
    whole = plain.drop("n").join(units, "node").select(runs)
    sources = branching.groupBy("node", "path").agg(F.min(F.struct("did", "th", "start", "n")).alias("at")).select("node", "path", "at.*")
    closed = whole.unionByName(branching).withColumn("open", F.lit(False))
    proven = stored(_proven(docs, closed.unionByName(sources.withColumn("open", F.lit(True))), window), "proven")
    released(shared, units)
    key = ["node", "path", "digest"]
    edges = proven.filter("open").select(*key, F.col("did").alias("first_did"), F.posexplode("edges").alias("off", "edge"))
    first = edges.groupBy("node", "edge").agg(F.min("first_did").alias("low"), F.max("first_did").alias("high")).filter("low < high").select("node", "edge", "low")
    found = edges.join(first, ["node", "edge"]).filter("low < first_did").groupBy(key).agg(F.collect_set("off").alias("offs"))
    # One join brings each occurrence its verdict: a later document loses the whole run, the first one
    # what an even earlier document has through another path.
    runs = proven.filter("not open")
    classes = runs.groupBy(key).agg(F.min("did").alias("low"), F.max("did").alias("high"))
    judged = stored(classes.join(found, key, "left").filter("low < high or offs is not null").select(*key, "low", "offs"), "judged-paths")
    every = F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("n")))
    some = F.transform("offs", lambda off: F.struct(off.alias("off"), F.lit(1).alias("n")))
    lost = runs.join(judged, key).select("did", "th", "start", F.explode(F.when(F.col("did") > F.col("low"), every).otherwise(some)).alias("x"))
    return lost.select("did", "th", (F.col("start") + F.col("x.off")).alias("start"), F.col("x.n").alias("n"))


def remove_repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in an earlier document.

    Returns ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space) and ``spans``
    (removed runs in words of the source text)."""
    if not 0 < k < window:
        raise ValueError("k must lie between 1 and window - 1")
    texts = keyed(docs, id_col, text_col)
    spans = repeated_word_spans(texts, window, k).groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return _cut(texts, spans, window).select(id_back(F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_text", "spans")
