"""Filters, joins, aggregates, windows, orderings and set operations as DataFrame functions.

Each takes frames and column names and returns a frame; nothing is collected. Orders are total where a
cut depends on them: every top-k takes its tie-break columns. Nulls follow SQL unless a docstring says
otherwise; empty frames give empty results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# ---- filters -------------------------------------------------------------------------------------


#: Rows of a rule table that a join may broadcast.
SMALL_ROWS = 10_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame, with a broadcast hint only if it is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_filters(df: DataFrame, **lists: list) -> DataFrame:
    """Keep rows whose columns are in their lists; an empty or missing list restricts nothing."""
    for name, values in lists.items():
        if values:
            df = df.filter(F.col(name).isin(values))
    return df


def multi_get(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows for a list of keys in the order asked, ``pos`` first; unknown keys are dropped."""
    asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    return F.broadcast(asked).join(df, key)


def half_open(df: DataFrame, at: str, since: int, until: int) -> DataFrame:
    """since < at <= until."""
    return df.filter((F.col(at) > since) & (F.col(at) <= until))


def page_before(df: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """The newest ``limit`` rows before a cursor (None: from the end), oldest first."""
    held = df if before is None else df.filter(F.col(key) < before)
    return held.orderBy(F.desc(key)).limit(limit).orderBy(key)


def has_all_terms(text: Column, terms: list[str]) -> Column:
    """The case-folded text contains every term."""
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(F.lower(text), F.lit(term.lower()))
    return out


def has_whole_word(text: Column, needle: str) -> Column:
    """The needle with no ASCII letter or digit on either side; case counts."""
    return text.rlike(rf"(?<![A-Za-z0-9])\Q{needle}\E(?![A-Za-z0-9])")


def has_any_part(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | (F.instr(text, part) > 0)
    return out


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations`` for each rule; a rule that is null for a row holds, as in a CHECK."""
    sums = df.agg(*[F.sum(F.when(~rule, 1).otherwise(0)).cast("long").alias(name) for name, rule in rules.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in rules)
    return sums.selectExpr(f"stack({len(rules)}, {stack}) as (rule, violations)").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))


# ---- joins ---------------------------------------------------------------------------------------


def keep_matching(df: DataFrame, other: DataFrame, on: list[str] | str) -> DataFrame:
    return df.join(other, on, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, on: list[str] | str) -> DataFrame:
    """NOT EXISTS: null-safe against nulls in ``other``, unlike NOT IN."""
    return df.join(other, on, "left_anti")


def with_default(df: DataFrame, other: DataFrame, on: str, value: str, default) -> DataFrame:
    """Left lookup with a default for keys that aren't there."""
    return df.join(other.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def overlapping(hits: DataFrame, ranges: DataFrame, span: str, lo: str, hi: str, before: int, after: int) -> DataFrame:
    """Ranges of the same span that overlap [lo - before, hi + after] of a hit, without the hit itself.

    The equal span key keeps this a hash or merge join; the overlap is its residual condition."""
    h = hits.select(F.col(span).alias("_s"), F.col(lo).alias("hit_lo"), F.col(hi).alias("hit_hi"))
    near = (F.col("_s") == F.col(span)) & (F.col(lo) <= F.col("hit_hi") + after) & (F.col(hi) >= F.col("hit_lo") - before)
    own = (F.col(lo) == F.col("hit_lo")) & (F.col(hi) == F.col("hit_hi"))
    return h.join(ranges, near).filter(~own).drop("_s")


def best_overlap(asked: DataFrame, ranges: DataFrame, span: str, lo: str, hi: str, order: list[str]) -> DataFrame:
    """For each asked [a, b] of a span the range with the largest overlap; ties by ``order``."""
    pairs = asked.join(ranges, span).filter((F.col(lo) <= F.col("b")) & (F.col(hi) >= F.col("a")))
    pairs = pairs.withColumn("overlap", F.least(F.col(hi), F.col("b")) - F.greatest(F.col(lo), F.col("a")) + 1)
    return first_per_group(pairs, [span, "a", "b"], [F.desc("overlap"), *order])


def unordered_pairs(df: DataFrame, group: str, member: str) -> DataFrame:
    """``a, b, n``: pairs a < b of members that share a group, and how many groups they share."""
    own = df.select(group, member).distinct()
    left, right = own.withColumnRenamed(member, "a"), own.withColumnRenamed(member, "b")
    return left.join(right, group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def similar_pairs(df: DataFrame, group: str, name: str, key: str, plain: Callable[[Column], Column] | None = None, block: int = 32, near: int = 1024) -> DataFrame:
    """``a, b, similar`` of each two rows of a group with ``a < b``, their keys: how alike their names' bigrams are, null where ``a`` has no name.

    Keys of a name stand in blocks of about ``block``. A group's blocks are dealt into parts of about ``near`` keys, and each
    part meets all blocks of the group; of two blocks one is chosen to hold the pair. So names are compared once for each
    pair of blocks, only blocks are shuffled, and pairs of keys arise as rows of the result and nowhere before."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(key).alias("key")).filter("g is not null and key is not null")
    named = rows.groupBy("g", "name").agg(F.count("*").alias("own"))
    sizes = named.join(named.groupBy("g").agg(F.sum("own").alias("all")), "g").withColumnsRenamed({"g": "_g", "name": "_name"})
    dealt = rows.join(sizes, (F.col("g") == F.col("_g")) & F.col("name").eqNullSafe(F.col("_name")))
    dealt = dealt.withColumn("nth", F.pmod(F.xxhash64("key"), F.ceil(F.col("own") / block)))
    blocks = dealt.groupBy("g", "name", "nth").agg(F.collect_list("key").alias("keys"), F.ceil(F.first("all") / near).cast("int").alias("parts"))
    blocks = blocks.select("g", "parts", F.struct("name", "nth").alias("block"), F.xxhash64("name", "nth").alias("hash"), X.character_bigrams(F.col("name"), plain).alias("grams"), "keys")
    here = blocks.withColumn("part", F.pmod("hash", "parts").cast("int")).drop("parts").repartition(tasks, "g", "part")
    there = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(tasks, "g", "part")
    there = there.withColumnsRenamed({x: f"_{x}" for x in ("block", "hash", "grams", "keys")})
    same = F.col("block") == F.col("_block")
    even = F.col("hash").bitwiseXOR(F.col("_hash")).bitwiseAND(F.lit(1)) == 0
    # The lesser block holds a pair of even hashes, the greater one of odd hashes: about half of all for each. The streamed side is the larger.
    both = there.join(here.hint("merge"), ["g", "part"]).filter(same | ((F.col("block") < F.col("_block")) == even))
    both = both.select("keys", "_keys", same.alias("same"), "grams", "_grams", X.set_similarity(F.col("grams"), F.col("_grams")).alias("similar"))
    both = both.select("keys", "_keys", "same", *[F.when(F.col(g).isNotNull(), F.col("similar")).alias(of) for g, of in (("grams", "of_x"), ("_grams", "of_y"))])
    x, y = F.col("x"), F.col("y")
    pairs = both.select("_keys", "same", "of_x", "of_y", F.explode("keys").alias("x")).select("same", "of_x", "of_y", "x", F.explode("_keys").alias("y"))
    pairs = pairs.filter((x < y) | ((x > y) & ~F.col("same")))
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x < y, F.col("of_x")).otherwise(F.col("of_y")).alias("similar"))


def within_band(df: DataFrame, centre: DataFrame, group: str, pos: str, width: int) -> DataFrame:
    """Rows of df within ``width`` positions of a centre row of the same group, once each."""
    c = centre.select(F.col(group).alias("_g"), F.col(pos).alias("_p")).distinct()
    # Positions are spread over width + 1 wide cells, so that the band becomes an equi join.
    cell = F.floor(F.col(pos) / (width + 1))
    spread = c.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_p") / (width + 1)) + d)))
    near = (F.col("_g") == F.col(group)) & (F.col("_cell") == cell) & (F.abs(F.col(pos) - F.col("_p")) <= width)
    return df.join(spread, near, "left_semi")


def with_next(df: DataFrame, group: list[str], order: str, column: str, name: str) -> DataFrame:
    """The column of the row at the very next position (null if that position is not there)."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn(name, F.when(F.lead(order).over(w) == F.col(order) + 1, F.lead(column).over(w)))


def same_members(df: DataFrame, group: str, member: str, wanted: list) -> DataFrame:
    """Groups whose member set equals the wanted set."""
    kind = df.schema[member].dataType.simpleString()
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.filter(F.col("members") == F.array_sort(F.array_distinct(F.array(*[F.lit(x).cast(kind) for x in wanted])))).select(group)


def seen_by_all(seen: DataFrame, item: str, viewer: str, viewers: DataFrame) -> DataFrame:
    """Relational division: items that every viewer sees; without viewers, none."""
    total = viewers.select(viewer).distinct().agg(F.count("*").alias("total"))
    own = seen.join(viewers.select(viewer).distinct(), viewer, "left_semi").select(item, viewer).distinct()
    return own.groupBy(item).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter("n = total").select(item)


# ---- aggregates ----------------------------------------------------------------------------------


def grouped_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def counts_for_all(df: DataFrame, by: str, every: DataFrame) -> DataFrame:
    """Counts with zeros for the values of ``every`` that never occur."""
    return every.select(by).distinct().join(grouped_counts(df, by), by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def values_at(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the sorted values at given places (from 0; functions of the group's size), and ``n``.

    Equal values are counted first, so a group is as many rows as it has distinct values, and no list is built."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    at = {k: F.max(F.when((f(F.col("_n")) < F.col("_upto")) & (f(F.col("_n")) >= F.col("_upto") - F.col("_c")), F.col(value))).alias(k) for k, f in places.items()}
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *at.values())


def floor_place(q: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(q) * (n - 1))


def upper_place(n: Column) -> Column:
    return F.floor(n / 2)


def nearest_place(p: float) -> Callable[[Column], Column]:
    return lambda n: F.floor((n - 1) * F.lit(p) + 0.5)


def evenly_spaced(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """``by, i, cut``: n of the sorted distinct values, evenly spaced by integer division; groups with fewer have none."""
    own = df.filter(F.col(value).isNotNull()).select(*by, value).distinct()
    w = Window.partitionBy(*by)
    placed = own.withColumn("_p", F.row_number().over(w.orderBy(value)) - 1).withColumn("_k", F.count("*").over(w)).filter(F.col("_k") > n)
    # The only i whose place can be p.
    i = F.expr(f"(_p * {n - 1} + _k - 2) div (_k - 1)")
    return placed.withColumn("i", i).filter(F.expr(f"(i * (_k - 1)) div {n - 1} = _p and i < {n}")).select(*by, F.col("i").cast("long").alias("i"), F.col(value).alias("cut"))


def floor_percentile(values: Column, q: float) -> Column:
    """Of an array: the sorted element at floor(q * (n - 1))."""
    return F.get(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def upper_median(values: Column) -> Column:
    """Of an array: the sorted element at n div 2."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, p: float) -> Column:
    """Of an array: the sorted element at round((n - 1) * p), halves away from zero."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * F.lit(p) + 0.5).cast("int"))


def even_quantiles(values: Column, n: int) -> Column:
    """n values of the sorted distinct array, evenly spaced by integer division; all of them if fewer."""
    own = F.array_sort(F.array_distinct(values))
    if n < 2:
        return F.slice(own, 1, n)
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(own, F.floor(i * (F.size(own) - 1) / (n - 1)).cast("int")))
    return F.when(F.size(own) <= n, own).otherwise(picked)


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_and_copies(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """First key of each group in order, and the others as a sorted array."""
    keys = df.groupBy(*group).agg(F.array_sort(F.collect_set(order)).alias("_all"))
    return keys.select(*group, F.col("_all")[0].alias("first"), F.slice("_all", 2, 2**31 - 1).alias("copies"))


def redundancy(ranges: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """covered positions / distinct positions - 1, for each value of ``by``."""
    every = ranges.select(by, F.explode(F.sequence(lo, hi)).alias("pos"))
    counts = every.groupBy(by, "pos").agg(F.count("*").alias("times"))
    return counts.groupBy(by).agg(F.round(F.sum("times") / F.count("*") - 1, 6).alias("redundancy"))


def gaps(ranges: DataFrame, group: str, lo: str, hi: str) -> DataFrame:
    """Neighbouring ranges whose start isn't the end before plus one: ``lo, prev_hi``."""
    w = Window.partitionBy(group).orderBy(lo, hi)
    return ranges.withColumn("prev_hi", F.lag(hi).over(w)).filter((F.col("prev_hi").isNotNull()) & (F.col(lo) != F.col("prev_hi") + 1))


def uncovered(points: DataFrame, ranges: DataFrame, group: str, pos: str, lo: str, hi: str) -> DataFrame:
    """Points that no range of their group covers."""
    covered = ranges.select(group, F.explode(F.sequence(lo, hi)).alias(pos)).distinct()
    return points.join(covered, [group, pos], "left_anti")


def macro_average(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean over groups of the groups' means."""
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


# ---- windows, orders, samples ----------------------------------------------------------------------


def rolling_sum(df: DataFrame, at: str, value: str, span_ms: int, by: list[str] | None = None) -> DataFrame:
    """Sum of whole numbers over (at - span, at]; instants are cut into spans first, so no task sees all rows.

    Values add up within each instant. In its own span an instant's sum counts from there on, in the next one from the
    start until a span after it: running sums of these changes are the rolling ones, however dense the rows."""
    by = by or []
    cell = F.expr(f"floor({at} / {span_ms})")
    sums = df.groupBy(*by, at).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    change = lambda c, when, sign, real: F.struct(c.alias("_cell"), when.cast("long").alias("_at"), (sign * F.col("_sum")).alias("_sum"), (sign * F.col("_n")).alias("_n"), F.lit(real).alias("_real"))
    changes = F.array(change(cell, F.col(at), 1, True), change(cell + 1, (cell + 1) * span_ms, 1, False), change(cell + 1, F.col(at) + span_ms, -1, False))
    dealt = sums.select(*by, F.explode(changes).alias("_c")).select(*by, "_c.*")
    w = Window.partitionBy(*by, "_cell").orderBy("_at")  # rows of one instant count together
    run = dealt.withColumn("rolling", F.sum("_sum").over(w)).withColumn("_some", F.sum("_n").over(w)).filter("_real")
    # Without a value in the frame the sum is null, as in a window.
    told = run.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_at", F.when(F.col("_some") > 0, F.col("rolling")).alias("rolling"))
    same = F.col(at).eqNullSafe(F.col("_at"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(told, same, "left").drop("_at", *[f"_b{i}" for i in range(len(by))])


def dense_ordinal(df: DataFrame, order: list[str], name: str, parts: str) -> DataFrame:
    """0..N-1 in a total order: numbered within the leading column ``parts``, shifted by its prefix counts.

    Only one row a value of ``parts`` meets in one task; choose a column with moderately many values."""
    within = F.row_number().over(Window.partitionBy(parts).orderBy(*order)) - 1
    sizes = df.groupBy(parts).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.withColumn("_within", within).join(before.select(parts, "_before"), parts).withColumn(name, F.col("_before") + F.col("_within")).drop("_within", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def largest_drop(df: DataFrame, group: list[str], order: list, value: str, window: int) -> DataFrame:
    """Within the first ``window`` rows of a group, where the value falls most relative to itself; earliest on a tie.

    ``cluster``: rows before the fall, ``drop``: its share (0 with fewer than two rows)."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(value).over(w)).filter(F.col("_rn") <= window)
    drop = F.when(F.col("_next").isNotNull() & (F.col("_rn") < window), F.round((F.col(value) - F.col("_next")) / F.col(value), 6)).otherwise(F.lit(0.0))
    return ranked.withColumn("_drop", drop).groupBy(*group).agg(F.max_by(F.col("_rn").cast("long"), F.struct("_drop", -F.col("_rn"))).alias("cluster"), F.max("_drop").alias("drop"))


def relative_floor(df: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """Rows whose value reaches ``share`` of their group's best."""
    best = F.max(value).over(Window.partitionBy(*group))
    return df.withColumn("_best", best).filter(F.col(value) >= F.col("_best") * share).drop("_best")


def every_nth(df: DataFrame, group: list[str], order: list, want: Column) -> DataFrame:
    """From each group of n rows those at floor(i * n / want), i = 0..want - 1."""
    w = Window.partitionBy(*group)
    numbered = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    numbered = numbered.withColumn("_want", F.least(F.greatest(want, F.lit(1)), F.col("_n")).cast("long"))
    # Row r is picked if some i has floor(i * n / want) = r; the first such i is ceil(r * want / n).
    i = F.floor((F.col("_rn") * F.col("_want") + F.col("_n") - 1) / F.col("_n"))
    return numbered.filter((i < F.col("_want")) & (F.floor(i * F.col("_n") / F.col("_want")) == F.col("_rn"))).drop("_rn", "_n", "_want")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash of the key; the same rows at every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def interleaved(df: DataFrame, group: list[str], order: list, ranks: list) -> DataFrame:
    """First rows of all groups, then second rows, and so on; ``place`` is the turn."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def one_per_group_then_fill(df: DataFrame, group: str, order: list, k: int, final: list) -> DataFrame:
    """Up to k rows in order, a group's later rows only when all first ones are in; null groups never repeat."""
    w = Window.partitionBy(group).orderBy(*order)
    turn = F.when(F.col(group).isNull(), 1).otherwise(F.least(F.row_number().over(w), F.lit(2)))
    return df.withColumn("turn", turn).orderBy("turn", *final).limit(k)


# ---- sets ------------------------------------------------------------------------------------------


def symmetric_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed between two maps."""
    b, a = before.select(key, F.col(value).alias("_b"), F.lit(1).alias("_hb")), after.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ha"))
    both = b.join(a, key, "full_outer")
    change = F.when(F.col("_hb").isNull(), "added").when(F.col("_ha").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_a")), "changed")
    return both.withColumn("change", change).filter("change is not null").select(key, "change")


def both_directions(edges: DataFrame, a: str, b: str) -> DataFrame:
    """An undirected edge, stored once, seen from both ends."""
    other = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("one"), F.col(b).alias("other"), *other).unionAll(edges.select(F.col(b).alias("one"), F.col(a).alias("other"), *other))
