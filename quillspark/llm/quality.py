"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network under the non-negative unbiased risk
    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])
with the logistic loss; when the second term falls below zero its gradient is turned about, so that the
unlabelled part is not over-fitted. The class prior is estimated from the same two samples: among all
score thresholds the least upper bound of (unlabelled share above) / (positive share above).

Features are shape statistics of the whole text (bytes, words, lines, repeats); ids, labels, language and
source are no inputs. Fitting reads about ``fit_rows`` ids of each sample at most (smallest hash of the id).

Cases: null texts count as empty and get the score of an empty text; each row is scored by itself, so
repeated rows and null ids are fine; labels without id or class are ignored; with no positives at all every
score is 0.5; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded_batches, thinned, utf8_parts

FIT_ROWS = 16_000
THRESHOLD = 0.3

_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _HIGH, _STOP = (np.zeros(256, np.float64) for _ in range(7))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = 1
_SYMBOL[list(b"#*$%&<>@^~=+\\/{}[]_")] = _MARK[list(b"!?")] = _BAR[list(b"|")] = _STOP[list(b".,;:")] = 1
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _HIGH, _STOP])
N_FEATURES = 18


def _repeated(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: how many of its values equal another one of it, and how many are distinct."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o, same[:-1] | same[1:], n), np.bincount(o, ~same[:-1], n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends, bounds = K.word_bounds(data, offsets)
    words = np.diff(bounds).astype(float)
    of = np.repeat(np.arange(n), np.diff(bounds))
    hashes = K.word_hashes(K.FIRST, data, starts, ends)
    lengths = (ends - starts).astype(float)
    chars = np.bincount(of, lengths, n)
    classes = [np.bincount(owner, c[data], n) for c in _CLASSES]
    per_char, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    wide = np.zeros(len(hashes) - 2 if len(hashes) > 2 else 0, np.uint64)
    if len(wide):
        wide = K.SECOND.windows(K.SECOND.prefix(hashes), 3)
    inside = of[: len(wide)] == of[2:] if len(wide) else np.zeros(0, bool)
    repeats, _ = _repeated(wide[inside], of[: len(wide)][inside], n)
    _, distinct = _repeated(hashes, of, n)
    twice = np.bincount(of[1:], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]), n) if len(of) else np.zeros(n)
    text_end = np.zeros(len(data) + 1, bool)
    text_end[offsets[1:][offsets[1:] > 0]] = True
    breaks = np.flatnonzero((data == 10) | text_end[1:]) if len(data) else np.zeros(0, np.int64)
    line_ends = breaks + (data[breaks] != 10) if len(breaks) else breaks
    line_starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    full = line_ends > line_starts
    prefix = K.SECOND.bytes_prefix(data)
    lines = K.SECOND.ranges(prefix, line_starts[full], line_ends[full]) if full.any() else np.zeros(0, np.uint64)
    line_of = owner[line_starts[full]] if full.any() else np.zeros(0, np.int64)
    n_lines = np.bincount(line_of, minlength=n).astype(float)
    _, distinct_lines = _repeated(lines, line_of, n)
    short = np.bincount(of, lengths <= 3, n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths)
    rates = [c / per_char for c in classes]
    return np.stack(
        [
            *rates,
            np.log1p(words),
            np.log1p(sizes),
            chars / per_word,
            np.log1p(longest),
            repeats / per_word,
            distinct / per_word,
            twice / per_word,
            short / per_word,
            (n_lines - distinct_lines) / np.maximum(n_lines, 1),
            np.log1p(words / np.maximum(n_lines, 1)),
            (words == 0).astype(float),
        ],
        axis=1,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def risk_parts(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk: of positives, and of negatives as unlabelled less positives."""
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def risk_gradients(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What to descend along by outputs: the risk's gradient, or where the second term is below zero, the turned one of that term."""
    if risk_parts(fp, fu, prior)[1] < 0:
        return prior * _sigmoid(fp) / len(fp), -_sigmoid(fu) / len(fu)
    return prior * ((_sigmoid(fp) - 1) - _sigmoid(fp)) / len(fp), _sigmoid(fu) / len(fu)


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int, epochs: int, seed: int, plain: bool = False) -> Model:
    """Minimise the risk with Adam. plain: tell positives from unlabelled instead (for the prior)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    theta = [rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step, batch = 0, 512
    n = max(1, len(u) // batch)

    def gradients(x: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(x @ theta[0] + theta[1])
        back = outer[:, None] * theta[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ outer, np.array([outer.sum()])]

    for _ in range(epochs):
        for _ in range(n):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            fp, fu = ((np.tanh(x @ theta[0] + theta[1]) @ theta[2] + theta[3][0]) for x in (xp, xu))
            if plain:
                gp, gu = (_sigmoid(fp) - 1) / batch, _sigmoid(fu) / batch
            else:
                gp, gu = risk_gradients(fp, fu, prior)
            grads = [a + b + 1e-4 * t for a, b, t in zip(gradients(xp, gp), gradients(xu, gu), theta, strict=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of held-out halves."""
    p0, p1, u0, u1 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    model = _train(p0, u0, 0.5, 16, 12, 7, plain=True)
    sp, su = np.sort(model.raw(p1)), np.sort(model.raw(u1))
    cuts = np.quantile(sp, np.linspace(0, 0.95, 96))
    qp, qu = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(20) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 11) -> Model | None:
    if len(positive) < 4 or len(unlabelled) < 4:
        return None
    return _train(positive, unlabelled, estimate_prior(positive, unlabelled), hidden, epochs, seed)


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in utf8_parts(batch.column(1)):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["doc_id", "x"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on bounded samples: trusted positives outside the held-out fifth, and unlabelled texts."""
    bounded_batches(docs.sparkSession)
    own = labels.select(labels["doc_id"].cast("long").alias("pid"), labels["quality"].alias("quality")).filter("pid is not null")
    trusted = thinned(own.filter((F.col("quality") == 1) & ~held_out(F.col("pid"))).select("pid").distinct(), fit_rows, "pid")
    ids = docs.select(docs[id_col].cast("long").alias("pid")).filter("pid is not null")
    web = thinned(ids.filter(~held_out(F.col("pid"))).distinct(), fit_rows, "pid", seed=3)
    wanted = trusted.withColumn("kind", F.lit(1)).unionByName(web.withColumn("kind", F.lit(0))).groupBy("pid").agg(F.max("kind").alias("positive"), F.min("kind").alias("least"))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    chosen = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("pid"), "left_semi")
    # Of several texts of one id the least features count, so that a hot id is one row.
    made = feature_rows(chosen, "doc_id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = made.join(F.broadcast(wanted), F.col("doc_id") == F.col("pid")).select("doc_id", "x", "positive", "least").collect()
    rows.sort(key=lambda r: r["doc_id"])
    pick = lambda test: np.array([r["x"] for r in rows if test(r)], float).reshape(-1, N_FEATURES)
    return fit(pick(lambda r: r["positive"] == 1), pick(lambda r: r["least"] == 0))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for low, high, data, offsets in utf8_parts(batch.column(1)):
                    out[low:high] = model.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of docs, as a struct) and ``score``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for low, high, data, offsets in utf8_parts(batch.column(0).field(at)):
                    out[low:high] = model.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "score"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of docs."""
    out = scored(docs, fit_on(docs, labels, fit_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
