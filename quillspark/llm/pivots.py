"""Exact top-k by inner product over a pivot-distance index.

Every component becomes floor(scale * x); the score is the integer inner product. Vectors are lifted by one
component to the length M of the longest one, queries by a zero: the squared distance of the two is then
|q|^2 + M^2 - 2 * score, so the highest scores are the nearest vectors.

Index: at most ``fit_rows`` vectors (smallest hashes; a documented bound) give the pivots, each the farthest from
those before it in a subset, moved to the mean of its vectors. Every vector is keyed by its nearest pivot and its
distance from it, in rings of about equal rows; a ring's least and greatest distance and its size are exact. There
are at most ``MOST_RINGS`` rings whatever the table, so this table of rings may go to every task; their rows grow.

Search: by the triangle inequality no vector of a ring is nearer to a query than the query's distance from the
pivot lies outside the ring. A query's rings stand in the order of that bound. It visits the first few, then
eight times as many and so on, and stops as soon as the next ring's bound is beyond its k-th best: all rings left
are farther. So the result is exact, whatever the sample; rounds are few, as they widen.

A round meets rings and queries in blocks of at most about ``block_rows`` each; a ring with a third of all rows
(copies of one vector) is many tasks, and only what can still be among a query's k best leaves a block.

Cases: vectors null, or with null or non-finite components (after scaling, too) take no part, nor do rows with a
null id or with another length than the most common one (ties: the longer) of the sample; zero vectors do take
part. Scores beyond a long are cut to its bounds. Ties go to the smaller id; repeated rows are candidates of their
own, but one query (of several vectors under one id, the least); candidates are all rows with another id; an empty
table gives an empty result; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored, thinned

SCALE = 256
EVERY = 50
FIT_ROWS = 8192
PIVOTS = 24
RING_ROWS = 512
MOST_RINGS = 4096
BLOCK_ROWS = 4096
FIRST_RINGS = 8
WIDEN = 8

_BEST = "query_id long, vec_id long, score long"


@dataclass
class Rings:
    """Pivots (lifted), the lengths' greatest square, and each ring's pivot, bounds of distance and rows."""

    pivots: np.ndarray
    square: float
    width: int
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (longs): rows that take part."""
    x = F.transform(vectors[vector_col], lambda y: F.lit(float(scale)) * y.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    finite = F.coalesce(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float(2**62))), F.lit(False))
    return rows.filter(finite).select("vec_id", F.transform("x", lambda y: F.floor(y).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0.0, square - (x**2).sum(1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T))


def choose_pivots(x: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Each next pivot is the farthest from those before; then each moves to the mean of its own vectors."""
    rng = np.random.default_rng(seed)
    few = x[rng.permutation(len(x))[: 64 * count]]
    pivots = [few[0]]
    apart = ((few - pivots[0]) ** 2).sum(1)
    while len(pivots) < count and apart.max() > 0:
        pivots.append(few[int(apart.argmax())])
        apart = np.minimum(apart, ((few - pivots[-1]) ** 2).sum(1))
    out = np.stack(pivots)
    for _ in range(4):
        own = _distances(x, out).argmin(1)
        out = np.stack([x[own == j].mean(0) if (own == j).any() else out[j] for j in range(len(out))])
    return out


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products (vectors by queries): doubles where they are exact, longs, or Python's integers."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1]
    if most < 2**53:
        return (v.astype(float) @ q.astype(float).T).astype(np.int64)
    if most < 2**62:
        return v @ q.T
    return np.clip(v.astype(object) @ q.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, pivots: int = PIVOTS, ring_rows: int = RING_ROWS, most_rings: int = MOST_RINGS) -> tuple[DataFrame, Rings] | None:
    """The rows keyed by ring (``ring, vec_id, v``), and the rings; nothing if no row takes part."""
    sample = thinned(rows, fit_rows, "vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return None
    sizes = np.diff(sample.offsets.to_numpy())
    counts = np.bincount(sizes)
    width = int(np.flatnonzero(counts == counts.max())[-1])
    rows = rows.filter(F.size("v") == width)
    square = F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    n, most = rows.agg(F.count("*"), F.max(square)).first()
    x = _lift(_matrix(sample.filter(pa.array(sizes == width)), width), most)
    chosen = choose_pivots(x, min(pivots, len(x)))
    distance = _distances(x, chosen)
    own, near = distance.argmin(1), distance.min(1)
    # Each pivot has rings in proportion to its sampled rows, cut at their quantiles.
    wanted = min(most_rings, max(1, -(-n // ring_rows)))
    edges = [np.quantile(near[own == j], np.linspace(0, 1, 1 + max(1, round(wanted * (own == j).mean())))[1:-1]) if (own == j).any() else np.zeros(0) for j in range(len(chosen))]
    first = np.append(0, np.cumsum([len(e) + 1 for e in edges]))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = _distances(_lift(_matrix(batch.column(1), width), most), chosen)
            own, near = distance.argmin(1), distance.min(1)
            ring = np.zeros(len(own), np.int64)
            for j in np.unique(own):
                at = own == j
                ring[at] = first[j] + np.searchsorted(edges[j], near[at], "right")
            yield pa.RecordBatch.from_arrays([pa.array(ring), pa.array(near), *batch.columns], names=["ring", "distance", "vec_id", "v"])

    keyed = stored(rows.mapInArrow(key, "ring long, distance double, vec_id long, v array<long>"), "rings")
    table = keyed.groupBy("ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("rows")).toArrow()
    ring, low, high, held = (table.column(c).to_numpy() for c in ("ring", "low", "high", "rows"))
    bounds = [np.full(first[-1], fill) for fill in (np.inf, -np.inf, 0)]
    for to, values in zip(bounds, (low, high, held), strict=True):
        to[ring] = values
    pivot = np.repeat(np.arange(len(chosen)), np.diff(first))
    return keyed.select("ring", "vec_id", "v"), Rings(chosen, most, width, pivot, *bounds)


def ring_order(rings: Rings, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rings that hold rows, by their bound: the least distance that the triangle inequality leaves to a vector in them."""
    lifted = np.append(q.astype(float), 0.0)
    to = np.sqrt(((rings.pivots - lifted) ** 2).sum(1))[rings.pivot]
    bound = np.maximum(0.0, np.maximum(to - rings.high, rings.low - to))
    held = np.flatnonzero(rings.rows > 0)
    order = held[np.lexsort((to[held], bound[held]))]
    # Distances carry rounding errors of the lengths' size.
    return order, bound[order] - 1e-6 * (1.0 + np.sqrt(rings.square) + np.sqrt((lifted**2).sum()))


def _visits(open_: DataFrame, rings: Rings, low: int, high: int) -> DataFrame:
    """``query_id, q, least, ring`` for a query's rings from low to high in its order, up to where it stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, counts = [], []
                for q, least in zip(_matrix(part.column(1), rings.width), part.column(2).to_pylist(), strict=True):
                    order, bound = ring_order(rings, q)
                    end = min(high, len(order))
                    if least is not None:
                        reach = np.sqrt(max(0.0, float((q.astype(float) ** 2).sum()) + rings.square - 2.0 * least))
                        end = min(end, int(np.searchsorted(bound, reach, "right")))
                    found.append(order[low : max(low, end)])
                    counts.append(len(found[-1]))
                row = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns), pa.array(np.concatenate(found).astype(np.int64))], names=["query_id", "q", "least", "ring"])

    return open_.select("query_id", "q", "least").mapInArrow(run, "query_id long, q array<long>, least long, ring long")


def _first(k: int, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, ties to the smaller id."""
    order = np.lexsort((vec, ~score, query))  # ~ reverses the order of all longs
    query, vec, score = query[order], vec[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vec[keep], score[keep]


def _met(keyed: DataFrame, visits: DataFrame, rings: Rings, k: int, block_rows: int) -> DataFrame:
    """Each query's best among the rings it visits, block by block."""
    width = rings.width
    per_ring = visits.groupBy("ring").agg(F.ceil(F.count("*") / block_rows).alias("query_blocks"))
    sizes = keyed.sparkSession.createDataFrame([(int(i), -(-int(n) // block_rows)) for i, n in enumerate(rings.rows) if n], "ring long, vector_blocks long")
    # One row for each ring, so both are bounded by MOST_RINGS.
    blocks = F.broadcast(per_ring.join(F.broadcast(sizes), "ring"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = keyed.join(blocks, "ring").select("ring", F.pmod(F.xxhash64("vec_id"), "vector_blocks").alias("vb"), every("query_blocks").alias("qb"), "vec_id", "v")
    right = visits.join(blocks, "ring").select("ring", every("vector_blocks").alias("vb"), F.pmod(F.xxhash64("query_id"), "query_blocks").alias("qb"), "query_id", "q", "least")

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        found = [(empty, empty, empty)]
        if one.num_rows and two.num_rows:
            ids, v = one.column("vec_id").to_numpy(), _matrix(one.column("v"), width)
            asked, q = two.column("query_id").to_numpy(), _matrix(two.column("q"), width)
            least = two.column("least").combine_chunks().fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for s in range(0, len(asked), 64):
                score = exact_scores(v, q[s : s + 64])
                fits = (score >= least[s : s + 64]) & (ids[:, None] != asked[s : s + 64])
                if len(ids) > k:
                    # What is below the k-th best of this block can't be among the k best.
                    fits &= score >= np.partition(np.where(fits, score, -(2**63)), len(ids) - k, axis=0)[len(ids) - k]
                i, j = np.nonzero(fits)
                found.append(_first(k, asked[s + j], ids[i], score[i, j]))
        query, vec, score = (np.concatenate(p) for p in zip(*found, strict=True))
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    key = ["ring", "vb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, _BEST)


def top_scores(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 5,
    scale: int = SCALE,
    every: int = EVERY,
    first_rings: int = FIRST_RINGS,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    **sizes: int,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products of scaled vectors.

    queries: rows with the same two columns; by default the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale, id_col, vector_col)
    fitted = fit(rows, **sizes)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keyed, rings = fitted
    asked = keyed.filter(F.col("vec_id") % every == 0) if queries is None else scaled(queries, scale, id_col, vector_col).filter(F.size("v") == rings.width)
    asked = stored(asked.groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id"), "queries")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, low, high, held = None, 0, first_rings, int((rings.rows > 0).sum())
    while low < held:
        if best is None:
            open_ = asked.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            open_ = asked.join(kth, "query_id", "left")
        visits = stored(_visits(open_, rings, low, high), "visits")
        if visits.isEmpty():  # every query has stopped
            break
        found = _met(keyed, visits, rings, k, block_rows)
        every_one = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        now = stored(every_one.withColumn("rank", place).filter(F.col("rank") <= k), "best")
        released(visits, *[best] * (best is not None))
        best, low, high = now, high, high * WIDEN
    return best.select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, for the default parameters: every query against every other row.
ORACLE = f"""
WITH ok AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
