"""MinHash near-dedup with fast similarity sketches, banding and exact confirmation.

A sketch has ``t`` coordinates. In round i < t every shingle goes to a hashed coordinate with the value
i + u, u in [0, 1); in round t + j every shingle goes to coordinate j. A coordinate keeps its least
value, and rounds end when all coordinates hold one, so each is filled after 2t rounds at most, and the
share of equal coordinates is concentrated about the Jaccard similarity as for t independent hashes.

1. Texts with equal shingle sets form a class, represented by its smallest id.
2. Representatives whose sketches agree in a band share a bucket. Buckets with the same members count once.
3. Each member is confirmed against its bucket's smallest member on the full sets.
4. Buckets whose members still lie in several components are searched again, in blocks: every pair across
   components that the sketches don't rule out is confirmed there on the full sets, in the first bucket
   that it shares, and only links leave the block.
5. Components come from star contraction.

So no bucket is expanded into all its pairs, and none is capped. With the defaults a pair at the threshold
shares no band with probability 2.6e-7, and is ruled out by its sketch with one below 1e-5.

Cases: null and empty texts have no shingles, and link with nothing; rows sharing an id are one document, whose
texts hang together however many they are; rows with a null id take no part (component null, kept); repeated rows give repeated results; empty
tables give empty results; only the two named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import LAST_ID, id_back, keyed, released, stored, utf8_parts
from .graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, BAND_ROWS = 40, 4
BLOCK = 256
BLOCK_BYTES = 4 << 20

U = np.uint64
EMPTY = U(2**64 - 1)
_SKETCHES = "did long, th long, n long, n_bytes long, set_a long, set_b long, bands array<long>, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = K.LOWER[data]
    starts, ends, bounds = K.word_bounds(data, offsets)
    prefix = K.SECOND.prefix(K.word_hashes(K.FIRST, data, starts, ends))
    whole = K.SECOND.windows(prefix, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(whole[a : b - size + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif b > a:
            out.append(K.SECOND.ranges(prefix, np.array([a]), np.array([b])) ^ U(b - a))
        else:
            out.append(whole[:0])
    return out


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of several sets at once; rows of empty sets stay empty."""
    out = np.full(len(sets) * t, EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        v = K.mix(items ^ U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        value = (U(i) << U(52)) | (v & U(2**52 - 1))
        cell = ((v >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else np.full(len(items), i - t)
        np.minimum.at(out, owner * t + cell, value)
        open_ = (out.reshape(-1, t) == EMPTY).any(axis=1)[owner]
        if not open_.all():
            items, owner = items[open_], owner[open_]
    return out.reshape(-1, t)


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketches), bands), np.uint64)
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    out[:] = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = K.mix(out * U(0x9E3779B97F4A7C15) ^ parts[:, :, j])
    return out


def sketched(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, high, data, offsets in utf8_parts(batch.column(2)):
                sets = shingle_sets(data, offsets, size)
                sketches = fast_sketches(sets, t)
                some = np.array([len(s) > 0 for s in sets])
                band = band_hashes(sketches, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(band[some].reshape(-1).view(np.int64)))
                short = np.ascontiguousarray(K.mix(sketches).astype(np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(did[low:high]),
                        pa.array(th[low:high]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.diff(offsets)),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([K.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        lists,
                        pa.array([s.tobytes() for s in short], pa.binary()),
                    ],
                    names=["did", "th", "n", "n_bytes", "set_a", "set_b", "bands", "sketch"],
                )

    return texts.mapInArrow(run, _SKETCHES)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. pairs: ``a, a_th, b, b_th``; texts: one row an id and th."""
    over, under = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, b_th = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keep = np.zeros(len(a), bool)
            held: dict[tuple[int, int], np.ndarray] = {}
            for low, high, data, offsets in utf8_parts(batch.column(3)):
                sets = shingle_sets(data, offsets, size)
                for i in range(low, high):
                    if (other := held.get((b[i], b_th[i]))) is None:
                        text = batch.column(4)[i].as_py().encode()
                        if len(held) > 4:
                            held.clear()
                        other = held[b[i], b_th[i]] = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0]
                    own = sets[i - low]
                    few, many = (own, other) if len(own) < len(other) else (other, own)
                    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    both = int((many[at] == few).sum())
                    keep[i] = both > 0 and under * both >= over * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    one, two = (texts.select(F.col("did").alias(x), F.col("th").alias(f"{x}_th"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(one, ["a", "a_th"]).join(two, ["b", "b_th"])
    return both.select("a", "b", "b_th", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, size: int, coordinates: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between members of one bucket that lie in different components, confirmed on the full sets.

    A pair is looked at in the first bucket that it shares, if its sketches don't rule it out; links found
    join the components at hand, so that a block gives fewer links than it has members."""
    over, under = threshold
    share = over / under
    least = coordinates * share - 4.5 * (coordinates * share * (1 - share)) ** 0.5

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high, band = key[1].as_py(), key[2].as_py(), table.column("band")[0].as_py()
        table = table.sort_by([("did", "ascending"), ("th", "ascending"), ("block", "ascending")]).combine_chunks()
        did, comp, block = (table.column(n).to_numpy() for n in ("did", "comp", "block"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(did), coordinates)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(did), -1)
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                text = table.column("text")[i].as_py().encode()
                sets[i] = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0]
            return sets[i]

        comp = np.unique(comp, return_inverse=True)[1]
        one, two = [], []
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low).tolist():
            other = right[comp[right] != comp[i]]
            if low == high:
                other = other[other > i]
            if len(other):
                same = (sketch[other] == sketch[i]).sum(axis=1)
                other, same = other[same >= least], same[same >= least]
            if len(other):
                first = (bands[other] == bands[i]).argmax(axis=1) == band
                other = other[first][np.argsort(-same[first], kind="stable")]
            for j in other.tolist():
                if comp[i] == comp[j]:
                    continue
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if both and under * both >= over * (len(of(i)) + len(of(j)) - both):
                    one.append(did[i])
                    two.append(did[j])
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(np.maximum(one, two), pa.int64()), "b": pa.array(np.minimum(one, two), pa.int64())})

    blocks = members.withColumn("of", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("did", "th"), "of").cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "did", "th", "comp", "block", "bands", "sketch", "text")
    return dealt.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    threshold: tuple[int, int] = (NUMERATOR, DENOMINATOR),
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id``, a row for each row of ``docs``.

    class_id: smallest id with the same shingle set."""
    texts = keyed(docs, id_col, text_col)
    made = stored(sketched(texts, size, bands, rows), "sketches")
    real = made.filter((F.col("n") > 0) & (F.col("did") != LAST_ID)).select("did", "th", "n", "set_a", "set_b")
    classes = real.groupBy("n", "set_a", "set_b").agg(F.min(F.struct("did", "th")).alias("first"))
    classes = stored(classes.select("n", "set_a", "set_b", F.col("first.did").alias("rep"), F.col("first.th").alias("rep_th")), "classes")
    first = classes.select(F.col("rep").alias("did"), F.col("rep_th").alias("th"))
    # An id may stand for several classes: representatives are told apart by id and text.
    reps = stored(made.join(first, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select("did", "th", "n_bytes", "bands", "sketch"), "representatives")
    banded = reps.select("did", "th", "n_bytes", F.posexplode("bands").alias("band", "key"))
    # Of buckets with the same members, that of the first band stays.
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("size"), F.min(F.struct("did", "th")).alias("lo"), F.bit_xor(F.xxhash64("did", "th")).alias("who"), F.sum("n_bytes").alias("bytes"), F.min("band").alias("band"))
        .filter("size > 1")
        .groupBy("size", "lo", "who")
        .agg(F.min(F.struct("band", "key")).alias("one"), F.max("bytes").alias("bytes"))
        .select("one.key", "one.band", "size", "lo", "bytes")
    )
    members = stored(banded.select("did", "th", "key").join(buckets, "key"), "buckets")
    wanted = members.select("did", "th").distinct()
    candidates = stored(texts.join(wanted, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select("did", "th", "text"), "candidates")

    # Rows that share an id are one document: all its classes hang together.
    own = real.join(classes, ["n", "set_a", "set_b"]).select("did", "rep").distinct()
    several = own.groupBy("did").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).filter("b < high").select("did", "b")
    joined = stored(own.join(several, "did").select(F.col("rep").alias("a"), "b").filter("a != b").distinct(), "one-id")
    tried = members.filter("did != lo.did or th != lo.th").select(F.col("did").alias("a"), F.col("th").alias("a_th"), F.col("lo.did").alias("b"), F.col("lo.th").alias("b_th")).distinct()
    edges = stored(confirmed(tried, candidates, size, threshold).filter("a != b").unionByName(joined), "links")
    found = components(edges)
    split = members.filter("size > 2").join(found.withColumnRenamed("node", "did"), "did", "left").withColumn("comp", F.coalesce("component", "did")).drop("component")
    mixed = split.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key")
    unsettled = split.join(mixed, "key", "left_semi").join(reps.select("did", "th", "bands", "sketch"), ["did", "th"]).join(candidates, ["did", "th"])
    new = stored(_across(unsettled, size, bands * rows, threshold), "more-links")
    found = components(edges.unionByName(new))
    released(reps, members, candidates, joined, edges, new)
    labelled = (
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("n", "set_a", "set_b", "rep", F.coalesce("component", "rep").alias("component"))
    )
    rows_ = made.select("did", "n", "set_a", "set_b").join(labelled, ["n", "set_a", "set_b"], "left")
    takes_part = (F.col("n") > 0) & (F.col("did") != LAST_ID)
    component = F.when(takes_part, F.col("component")).otherwise(id_back(F.col("did")))
    return rows_.select(
        id_back(F.col("did")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("did") == component, F.lit(True)).alias("kept"),
        F.when(takes_part, F.col("rep")).otherwise(id_back(F.col("did"))).alias("class_id"),
    )
