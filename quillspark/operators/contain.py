"""Containment joins: which texts hold which passages, without comparing every pair.

The inner words of a contained passage (all but its first and last, which may be cut) stand whole in the
text. Each passage is keyed by the three-word run among them that hashes least, or by all of them if there are
only one or two; the texts' runs of the same lengths are joined on that key, and what meets is checked in full.
Passages of fewer than three words have no inner word and are checked against all texts, behind a broadcast
whose size is checked, or by a plain join beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

RUN = 3
SHORT_LIMIT = 1000
KEY_LIMIT = 100_000


def _runs(words: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0))), lambda i: F.xxhash64(F.lit(length), *[F.get(words, i + j) for j in range(length)]))


def contained_in(passages: DataFrame, pid: str, ptext: str, texts: DataFrame, tid: str, ttext: str) -> DataFrame:
    """``pid, tid`` for each passage that a text contains; empty passages are contained in every text.

    Null passages and texts hold nothing."""
    p = passages.select(F.col(pid), F.col(ptext).alias("_p")).filter("_p is not null").withColumn("_w", F.split("_p", r"\s+"))
    t = texts.select(F.col(tid), F.col(ttext).alias("_t")).filter("_t is not null")
    inner = p.withColumn("_w", F.expr("slice(_w, 2, greatest(size(_w) - 2, 0))")).withColumn("_r", F.least(F.size("_w"), F.lit(RUN)))
    counts = dict(map(tuple, inner.groupBy("_r").count().collect()))  # one row a length, RUN + 1 at most
    lengths = [r for r in range(1, RUN + 1) if r in counts] or [RUN]
    least = F.coalesce(*[F.when(F.col("_r") == r, F.array_min(_runs(F.col("_w"), r))) for r in lengths])
    keys = inner.filter("_r > 0").select(pid, least.alias("_g"))
    words = t.withColumn("_w", F.split("_t", r"\s+")).filter(F.size("_w") >= lengths[0])
    runs = words.select(tid, F.explode(F.concat(*[_runs(F.col("_w"), r) for r in lengths])).alias("_g"))
    if sum(counts.values()) <= KEY_LIMIT:
        keys = F.broadcast(keys)
    # Stored, so that the pairs to check are joined by their size: few of them go to the texts, and these aren't dealt out.
    met = stored(keys.join(runs, "_g").select(pid, tid).distinct(), "met")
    full = met.join(p.select(pid, "_p"), pid).join(t, tid).filter(F.contains("_t", "_p")).select(pid, tid)
    short = inner.filter("_r = 0").select(pid, "_p")
    few = counts.get(0, 0)
    if not few:
        return full
    if few <= SHORT_LIMIT:
        short = F.broadcast(short)
    return full.unionByName(t.join(short, F.contains("_t", "_p")).select(pid, tid))
