"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Fitting: at most ``fit_rows`` vectors (smallest hash of id and vector first; a documented bound) are split by
k-means into ``branching`` children, these again, until a node has at most ``leaf_rows`` sampled rows. The
tree (bounded by the sample, not by the data) goes to every task; every vector is indexed under its leaf.

Search: from the root, the nearest child is entered and its siblings wait in a priority queue by distance
to their centres; the nearest waiting node is opened next. How many leaves a query visits is calibrated: on
sampled queries against the sample by brute force, visits widen until recall reaches ``target``. A query
also goes on past that number until its leaves hold ``k`` sampled rows.

Leaves meet queries in blocks: vectors and queries of a leaf are dealt into blocks of at most about
``block_rows`` each, every pair of blocks is one small matrix, and only each query's k best leave it; small
leaves share a task. So a leaf with a third of all rows (copies of one vector) is many tasks, and nothing is capped.

Cases: vectors null, zero, or with null or non-finite components take no part, nor do rows with a null id or
a length that differs from the most common one among the sampled; ties go to the smaller id; repeated rows
are separate candidates but one query (of several vectors under one id, the least); a query's candidates are all rows with another id; fewer candidates than k give
fewer rows; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, thinned

FIT_ROWS = 16_384
BRANCHING = 8
LEAF_ROWS = 48
BLOCK_ROWS = 2048
TARGET = 0.985
EVERY = 100


@dataclass
class Node:
    centre: np.ndarray
    rows: int
    children: list[Node] = field(default_factory=list)
    leaf: int = -1
    centres: np.ndarray | None = None  # of the children


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    label = np.full(len(x), -1)
    for _ in range(rounds):
        now = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        if (now == label).all():
            break
        label = now
        for j in range(k):
            if (own := label == j).any():
                centres[j] = x[own].mean(0)
    return label


def grow(x: np.ndarray, branching: int, leaf_rows: int, seed: int = 5) -> tuple[Node, int]:
    """The tree over sampled vectors, and its number of leaves."""
    rng = np.random.default_rng(seed)
    root = Node(x.mean(0) if len(x) else np.zeros(0), len(x))
    leaves, todo = 0, [(root, x)]
    while todo:
        node, own = todo.pop()
        parts = []
        if len(own) > leaf_rows:
            label = _k_means(own, branching, rng)
            parts = [own[label == j] for j in range(branching) if (label == j).any()]
        if len(parts) < 2:  # few rows, or copies of one vector
            node.leaf = leaves
            leaves += 1
            continue
        for part in parts:
            child = Node(part.mean(0), len(part))
            node.children.append(child)
            todo.append((child, part))
        node.centres = np.stack([c.centre for c in node.children])
    return root, leaves


def leaf_of(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest child at every level."""
    out = np.zeros(len(x), np.int64)
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.leaf >= 0:
            out[rows] = node.leaf
            continue
        centres = node.centres
        label = np.argmin((centres**2).sum(1) - 2 * x[rows] @ centres.T, axis=1)
        todo += [(c, rows[label == j]) for j, c in enumerate(node.children)]
    return out


def best_bins(root: Node, q: np.ndarray, visits: int, rows: int) -> list[int]:
    """Leaves in best-bin-first order: ``visits`` of them, and on until they hold ``rows`` sampled rows."""
    found, held, order = [], 0, 0
    queue: list[tuple[float, int, Node]] = [(0.0, 0, root)]
    while queue and (len(found) < visits or held < rows):
        node = heapq.heappop(queue)[2]
        while node.leaf < 0:
            distance = ((node.centres - q) ** 2).sum(1)
            nearest = int(distance.argmin())
            for j, (d, child) in enumerate(zip(distance.tolist(), node.children, strict=True)):
                if j != nearest:
                    order += 1
                    heapq.heappush(queue, (d, order, child))
            node = node.children[nearest]
        found.append(node.leaf)
        held += node.rows
    return found


def calibrate(root: Node, leaves: int, x: np.ndarray, k: int, target: float, queries: int = 200) -> tuple[int, float]:
    """The least number of leaf visits whose recall on sampled queries reaches the target, and that recall."""
    pick = np.arange(0, len(x), max(1, len(x) // queries))
    leaf = leaf_of(root, x)
    where: list[list[int]] = []
    for i in pick:
        distance = ((x - x[i]) ** 2).sum(1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(x) - 1)]
        order = {b: n for n, b in enumerate(best_bins(root, x[i], leaves, 0))}
        where.append([order[b] for b in leaf[near]])
    flat = np.sort(np.array([n for w in where for n in w]))
    if not len(flat):
        return leaves, 1.0
    at = min(len(flat) - 1, int(np.ceil(target * len(flat))) - 1)
    visits = int(flat[at]) + 1
    return visits, float((flat < visits).mean())


@dataclass
class Index:
    root: Node
    leaves: int
    visits: int
    recall: float
    width: int


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (doubles): rows that take part."""
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, k: int = 10, fit_rows: int = FIT_ROWS, branching: int = BRANCHING, leaf_rows: int = LEAF_ROWS, target: float = TARGET) -> Index | None:
    # Equal rows count once in the sample; copies of one vector under other ids keep their share.
    chosen = thinned(rows, fit_rows, "vec_id", "v").distinct()
    sample = chosen.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return None
    sizes = np.diff(sample.offsets.to_numpy())
    width = int(np.bincount(sizes).argmax())
    x = _matrix(sample.filter(pa.array(sizes == width)), width)
    root, leaves = grow(x, branching, leaf_rows)
    visits, recall = calibrate(root, leaves, x, k, target)
    return Index(root, leaves, visits, recall, width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _indexed(rows: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(index.root, _matrix(batch.column(1), index.width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, leaf long")


def _visits(queries: DataFrame, index: Index, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                bins = [best_bins(index.root, q, index.visits, k + 1) for q in _matrix(part.column(1), index.width)]
                row = pa.array(np.repeat(np.arange(len(bins)), [len(b) for b in bins]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array([b for own in bins for b in own], pa.int64())], names=["query_id", "q", "leaf"])

    return queries.mapInArrow(run, "query_id long, q array<double>, leaf long")


def _first(k: int, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, ties to the smaller id."""
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vec[keep], score[keep]


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    index: Index | None = None,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found, by Euclidean distance.

    queries: rows with the same two columns; by default the rows whose id is divisible by 100."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vector_col)
    index = index or fit(rows, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = index.width
    rows = rows.filter(F.size("v") == width)
    asked = rows.filter(F.col("vec_id") % EVERY == 0) if queries is None else valid_vectors(queries, id_col, vector_col).filter(F.size("v") == width)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    indexed = stored(_indexed(rows, index), "vectors")
    visited = stored(_visits(asked.withColumnsRenamed({"vec_id": "query_id", "v": "q"}), index, k), "visits")
    blocks = indexed.groupBy("leaf").agg(F.count("*").alias("vectors"), F.ceil(F.count("*") / block_rows).alias("vector_blocks"))
    blocks = stored(blocks.join(visited.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("query_blocks")), "leaf"), "blocks")
    # Several small leaves share a task.
    bins = max(1, -(-(blocks.agg(F.sum("vectors")).first()[0] or 0) // block_rows))
    bin_ = F.pmod(F.xxhash64("leaf"), F.lit(bins)).alias("bin")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = indexed.join(blocks, "leaf").select(bin_, "leaf", F.pmod(F.xxhash64("vec_id"), "vector_blocks").alias("vb"), every("query_blocks").alias("qb"), "vec_id", "v")
    right = visited.join(blocks, "leaf").select(bin_, "leaf", every("vector_blocks").alias("vb"), F.pmod(F.xxhash64("query_id"), "query_blocks").alias("qb"), "query_id", "q")

    def best(ids: np.ndarray, v: np.ndarray, asked: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and distance of each query's k nearest among v, and of what ties with them by rounding."""
        # The expanded form ranks roughly; what could be among the k best is measured exactly.
        square = (q**2).sum(1)[:, None]
        rough = (v**2).sum(1) - 2 * (q @ v.T) + square
        rough[asked[:, None] == ids] = np.inf
        near = np.isfinite(rough)
        if len(ids) > k:
            least = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
            near &= rough <= np.where(np.isfinite(least), least + 1e-9 * (1 + np.abs(least) + square), np.inf)
        i, j = np.nonzero(near)
        exact = np.concatenate([np.sqrt(((v[j[s : s + 65536]] - q[i[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        return asked[i], ids[j], exact

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(empty, empty, np.zeros(0))]
        if one.num_rows and two.num_rows:
            one, two = one.sort_by("leaf"), two.sort_by("leaf")
            ids, v = one.column("vec_id").to_numpy(), _matrix(one.column("v").combine_chunks(), width)
            asked, q = two.column("query_id").to_numpy(), _matrix(two.column("q").combine_chunks(), width)
            leaf, own = one.column("leaf").to_numpy(), two.column("leaf").to_numpy()
            for x in np.intersect1d(leaf, own):
                (a, b), (c, d) = (np.searchsorted(p, [x, x + 1]) for p in (leaf, own))
                for s in range(c, d, 64):
                    found.append(_first(k, *best(ids[a:b], v[a:b], asked[s : min(d, s + 64)], q[s : min(d, s + 64)])))
        query, vec, score = _first(k, *(np.concatenate(p) for p in zip(*found, strict=True)))
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    key = ["bin", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
