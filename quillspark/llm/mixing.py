"""Mixing sources to target weights by Pfair scheduling, in native DataFrame expressions.

Each source's rows are shuffled by a hash and cut into blocks of about ``block_bytes``. Every slot of the
output takes one block. A source with share n/N has for its block i (from 0) the release time floor(i*N/n)
and the deadline ceil((i+1)*N/n); among released blocks the earliest deadline goes first (ties: source
name). On one processor that meets every deadline, so after t slots each source has had t*n/N blocks, give
or take less than one. With integer shares the schedule repeats after N slots, so one period is folded once
and serves any number of blocks.

Target weights: ``weights`` by source, as given (others get the least weight given); the period is their sum
without a common divisor. Sums beyond ``MOST_SLOTS`` are scaled to it and rounded. Without ``weights`` a
source's target is the square root of its bytes, in ``period``-ths of the whole, rounded, one at least; with many
sources the period grows to ``SOURCE_SLOTS`` a source, up to ``MOST_SLOTS``. A source that ends leaves its slots empty; the others keep their proportions, and no row is dropped or repeated.

Order within a source: rows are dealt by hash into ranges small enough for one task, numbered there, and
joined to the prefix sums of the ranges, so a source of any size is never sorted in one task.

Cases: a null source is a source of its own; null texts are empty; null ids and repeated rows are placed
row by row (ties by the text's hash); an empty table gives an empty result; only the named columns are
read, others can be carried with ``carry``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 65536
PERIOD = 1000
#: Given weights are exact as long as their sum, without a common divisor, is no more than this.
MOST_SLOTS = 1 << 17
#: The period has this many slots for each source at least, so that rounding stays small beside many small sources.
SOURCE_SLOTS = 16
RANGE_ROWS = 500
RUN_RANGES = 1000
BROADCAST_SOURCES = 4096
_SPAN = 1 << 60

# Blocks of slots are folded one after the other with the sources' states carried on, so that the picks are
# not copied with every slot.
_FOLD = """
aggregate(sequence(0L, (period - 1) div 256),
    named_struct('done', transform(sources, x -> 0L), 'picks', cast(array() as array<int>)),
    (all, b) -> transform(array(aggregate(sequence(256 * b, least(256 * b + 255, period - 1)),
            named_struct('done', all.done, 'picks', cast(array() as array<int>)),
            (acc, t) -> transform(array(
                array_min(filter(
                    transform(sources, (s, i) -> if((acc.done[i] * period) div s.n <= t and acc.done[i] < s.n,
                        named_struct('deadline', ((acc.done[i] + 1) * period + s.n - 1) div s.n, 'i', i), null)),
                    x -> x is not null)).i),
                p -> named_struct('done', transform(acc.done, (c, i) -> if(i = p, c + 1, c)), 'picks', concat(acc.picks, array(p))))[0])),
        r -> named_struct('done', r.done, 'picks', concat(all.picks, r.picks)))[0],
    all -> all.picks)
"""


def _place(seed: int, doc_id: Column, text: Column) -> Column:
    """A number below 2**60 that depends on the id and the text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def shares(sources: DataFrame, weights: dict[str, int] | None, period: int) -> DataFrame:
    """``skey, n, period`` for each source: its slots of a period, and the period. sources: ``skey, bytes``."""
    if weights:
        given = {k: max(1, int(v)) for k, v in weights.items()}
        unit = math.gcd(*given.values())
        table = F.create_map(*[F.lit(x) for k, v in given.items() for x in (f"s:{k}", v // unit)])
        weight = F.coalesce(F.element_at(table, F.col("skey")), F.lit(min(given.values()) // unit))
        least = MOST_SLOTS
    else:
        weight = F.greatest(F.floor(F.sqrt(F.col("bytes").cast("double"))), F.lit(1))
        least = int(period)
    # One row a source: this window sees as many rows as there are sources.
    every = Window.partitionBy(F.lit(1))
    w = sources.withColumn("w", weight.cast("long")).withColumn("all_w", F.sum("w").over(every))
    w = w.withColumn("most", F.least(F.lit(MOST_SLOTS), F.greatest(F.lit(least), SOURCE_SLOTS * F.count("*").over(every))))
    rounded = F.expr("greatest((2 * most * w + all_w) div (2 * all_w), 1)")
    w = w.withColumn("n", F.when(F.col("all_w") <= F.col("most"), F.col("w")).otherwise(rounded))
    return w.select("skey", "n", F.sum("n").over(every).alias("period"))


def schedule(share: DataFrame) -> DataFrame:
    """One period: ``skey, turn, n, period, slot`` for each of a source's n turns."""
    one = share.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("skey", "n"))).alias("sources"))
    picked = one.select("period", "sources", F.posexplode(F.expr(_FOLD)).alias("slot", "i"))
    named = picked.select("period", F.expr("sources[i]").alias("s"), F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("s.skey").orderBy("slot")) - 1
    return named.select(F.col("s.skey").alias("skey"), turn.cast("long").alias("turn"), F.col("s.n").alias("n"), "period", "slot")


def mixed(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block_bytes: int = BLOCK_BYTES,
    period: int = PERIOD,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """A row for each row of docs: ``doc_id, source, n_bytes, share, block, slot, block_offset``.

    The mix is the order of (slot, block_offset). With ``carry`` all columns of docs come instead, in a
    struct ``row``, with ``slot`` and ``block_offset``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].alias("source"),
        F.coalesce(F.concat(F.lit("s:"), docs[source_col].cast("string")), F.lit("n")).alias("skey"),
        (F.octet_length(text) + 1).cast("long").alias("n_bytes"),
        _place(seed, docs[id_col], text).alias("place"),
        *own,
    )
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    rows = rows.withColumn("range", F.expr(f"place div {-(-_SPAN // ranges)}"))
    sums = rows.groupBy("skey", "range").agg(F.sum("n_bytes").alias("bytes"))
    # Prefix sums in two steps: within runs of ranges, and over the runs.
    sums = sums.withColumn("run", F.expr(f"range div {RUN_RANGES}"))
    inner = sums.withColumn("inner", F.sum("bytes").over(Window.partitionBy("skey", "run").orderBy("range")) - F.col("bytes"))
    runs = sums.groupBy("skey", "run").agg(F.sum("bytes").alias("run_bytes"))
    runs = runs.select("skey", "run", (F.sum("run_bytes").over(Window.partitionBy("skey").orderBy("run")) - F.col("run_bytes")).alias("outer"))
    before = inner.join(runs, ["skey", "run"]).select("skey", "range", (F.col("inner") + F.col("outer")).alias("before"))
    within = F.sum("n_bytes").over(Window.partitionBy("skey", "range").orderBy("place", "doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    placed = rows.withColumn("within", within).join(before, ["skey", "range"]).withColumn("start", F.col("before") + F.col("within"))
    placed = placed.withColumn("block", F.expr(f"start div {int(block_bytes)}"))
    share = shares(sums.groupBy("skey").agg(F.sum("bytes").alias("bytes")), weights, period)
    plan = schedule(share)
    if share.count() <= BROADCAST_SOURCES:
        plan, share = F.broadcast(plan), F.broadcast(share)
    out = placed.join(share, "skey").withColumn("turn", F.expr("block % n")).join(plan.select("skey", "turn", F.col("slot").alias("base")), ["skey", "turn"])
    slot = F.expr("(block div n) * period + base").alias("slot")
    offset = F.expr(f"start % {int(block_bytes)}").alias("block_offset")
    if carry:
        return out.select("row", slot, offset)
    return out.select("doc_id", "source", "n_bytes", F.col("n").alias("share"), "block", slot, offset)


#: The same in DuckDB, for the default parameters.
ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('s:' || source, 'n') AS skey, strlen(coalesce(text, '')) + 1 AS n_bytes,
         ('0x' || substr(md5('29|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
numbered AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY skey ORDER BY place, doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS start FROM rows_),
weighed AS (
  SELECT skey, greatest(floor(sqrt(sum(n_bytes)::DOUBLE))::BIGINT, 1) AS w FROM rows_ GROUP BY skey),
rounded AS (
  SELECT skey, CASE WHEN all_w <= most THEN w ELSE greatest((2 * most * w + all_w) // (2 * all_w), 1) END AS n
  FROM (SELECT skey, w, sum(w) OVER () AS all_w, least({MOST_SLOTS}, greatest({PERIOD}, {SOURCE_SLOTS} * count(*) OVER ())) AS most FROM weighed)),
share AS (
  SELECT skey, n, sum(n) OVER () AS period FROM rounded),
sources AS (
  SELECT list(skey ORDER BY skey) AS names, list(n::BIGINT ORDER BY skey) AS ns, max(period)::BIGINT AS period FROM share),
fold(t, done, pick) AS (
  SELECT 0::BIGINT, list_transform(ns, lambda x: 0::BIGINT), 0::BIGINT FROM sources
  UNION ALL
  SELECT t + 1, list_transform(range(len(ns)), lambda i: done[i + 1] + (i + 1 = pick)::BIGINT), pick FROM (
    SELECT t, done, ns, list_min(list_filter(list_transform(range(len(ns)),
        lambda i: {{'d': ((done[i + 1] + 1) * period + ns[i + 1] - 1) // ns[i + 1], 'i': i + 1, 'ok': (done[i + 1] * period) // ns[i + 1] <= t AND done[i + 1] < ns[i + 1]}}),
        lambda x: x.ok)).i AS pick
    FROM fold, sources WHERE t < period)),
plan AS (
  SELECT names[pick] AS skey, t - 1 AS base, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM fold, sources WHERE t > 0)
SELECT n_.doc_id, n_.source, n_.n_bytes::BIGINT AS n_bytes, s.n::BIGINT AS share, (n_.start // {BLOCK_BYTES})::BIGINT AS block,
       (((n_.start // {BLOCK_BYTES}) // s.n) * s.period + p.base)::BIGINT AS slot, (n_.start % {BLOCK_BYTES})::BIGINT AS block_offset
FROM numbered n_ JOIN share s USING (skey) JOIN plan p ON p.skey = n_.skey AND p.turn = (n_.start // {BLOCK_BYTES}) % s.n
"""
