"""Wrap-ups: memories that a session proposes at its end, written unless they say again what is held.

Similar texts are found first, for all worlds in one plan: a set-similarity join on character pairs with a prefix
filter. Pairs stand in the order of their frequency, rarest first; two sets that reach the threshold share one of
their first pairs, so only those are joined, and what meets is compared in full. Whether a memory is written
depends on what was written before it, so each world's memories are then folded in order; the fold streams over
sorted rows and holds ids only, as texts were compared before.

Rules in order: a text without letters or digits is empty; a wrap-up writes ``max_facts`` at most; a commitment
needs a due instant; a fact by the same author about the same subject that is ``similar`` percent alike and not
retracted stands in the way (facts only); so does an equal text of the same kind and audience, retracted or not.

Cases: nulls in author, audience or subject are values of their own; null texts are empty; repeated rows are
duplicates of the first; rows with a null world are one world."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..sources.scratch import scratch

# Fixed values.
MAX_FACTS = 2
SIMILAR = 45

_FIELDS = ["world", "ms", "id", "wrap", "author", "kind", "audience", "about", "due", "text", "retracted"]


def pairs_of(plain: Column) -> Column:
    """The distinct pairs of adjacent characters."""
    n = F.length(plain)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))
    return F.when(n > 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def similar_sets(sets: DataFrame, by: list[str], key: str, items: str, percent: int) -> DataFrame:
    """``low, high``: pairs of keys in one group whose sets have ``percent`` of their union in common (low < high).

    Nulls in ``by`` are equal to each other; empty sets are like nothing."""
    group = F.xxhash64(*[x for c in by for x in (F.col(c).isNull(), F.col(c))])
    rows = sets.select(group.alias("group"), F.col(key).alias("key"), F.col(items).alias("items")).filter(F.size("items") > 0)
    spread = rows.select("group", "key", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = spread.groupBy("item").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("often", "item"))
    # Two such sets have at least percent of the larger one in common, so they meet in the first of either.
    first = spread.join(often, "item").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("group", "item", "key", "n", "place")
    left, right = (first.withColumnsRenamed({"key": k, "n": f"n_{k}", "place": f"p_{k}"}) for k in ("low", "high"))
    fits = lambda a, b: F.col(a) * 100 >= F.col(b) * percent
    # No more than the shared pair and what is left behind it in both can be common.
    most = 1 + F.least(F.col("n_low") - F.col("p_low"), F.col("n_high") - F.col("p_high"))
    met = left.join(right, ["group", "item"]).filter((F.col("low") < F.col("high")) & fits("n_low", "n_high") & fits("n_high", "n_low"))
    # The first shared pair in the order is the one that both prefixes have first, so the bound holds for it.
    met = met.groupBy("low", "high").agg(F.max(most).alias("most"), F.min("n_low").alias("n_low"), F.min("n_high").alias("n_high"))
    met = met.filter(F.col("most") * (100 + percent) >= (F.col("n_low") + F.col("n_high")) * percent)
    for k in ("low", "high"):
        met = met.join(rows.select(F.col("key").alias(k), F.col("items").alias(f"items_{k}")), k)
    shared = F.size(F.array_intersect("items_low", "items_high"))
    return met.filter(shared * 100 >= (F.size("items_low") + F.size("items_high") - shared) * percent).select("low", "high")


def wrap_up(held: DataFrame, proposed: DataFrame, max_facts: int = MAX_FACTS, similar: int = SIMILAR) -> DataFrame:
    """``world, id, outcome, existing`` of each proposed memory: written, empty, over_limit, no_due, similar, duplicate.

    Both: ``world, ms, id, author, kind, audience, about, due, text``; held also ``retracted``, proposed ``wrap``. Ids are
    unique, rise with time within a world, and those held are below those proposed. ``existing`` is the least id in the way."""
    spark = proposed.sparkSession
    fresh = proposed.withColumn("retracted", F.lit(False)).select(*_FIELDS, F.lit(True).alias("fresh"))
    rows = held.withColumn("wrap", F.lit(None).cast(fresh.schema["wrap"].dataType)).select(*_FIELDS, F.lit(False).alias("fresh")).unionByName(fresh)
    rows = rows.withColumn("plain", normalised(F.coalesce("text", F.lit(""))))
    path = scratch(spark, "memories")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    facts = rows.filter("kind = 'fact' and not retracted").select("world", "author", "about", "id", pairs_of(F.col("plain")).alias("pairs"))
    like = similar_sets(facts, ["world", "author", "about"], "id", "pairs", similar).groupBy(F.col("high").alias("id")).agg(F.array_sort(F.collect_set("low")).alias("like"))
    same = rows.filter("plain <> ''").select("world", "id", "fresh", F.xxhash64("world", "kind", F.col("audience").isNull(), "audience").alias("group"), F.sha2("plain", 256).alias("digest"))
    # Equal texts are one class; a class is in the way once one of it is there.
    classes = same.select("id", F.sha2(F.concat_ws("|", F.col("group").cast("string"), "digest"), 256).alias("class"))
    ready = rows.join(like, "id", "left").join(classes, "id", "left")
    columns = ["world", "ms", "id", "wrap", "fresh", "kind", F.col("due").isNotNull().alias("has_due"), "like", "class"]
    world, wrap = (rows.schema[c].dataType.simpleString() for c in ("world", "wrap"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, counts, there, first = False, None, {}, set(), {}
        for batch in batches:
            ids, outcomes, existing, worlds = [], [], [], []
            for own, _, i, session, new, kind, has_due, like, text_class in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or own != at:
                    begun, at, counts, there, first = True, own, {}, set(), {}
                if not new:
                    there.add(i)
                    if text_class:
                        first.setdefault(text_class, i)
                    continue
                close = next((x for x in like or () if x in there), None) if kind == "fact" else None
                if text_class is None:
                    outcome, by = "empty", None
                elif counts.get(session, 0) >= max_facts:
                    outcome, by = "over_limit", None
                elif kind == "commitment" and not has_due:
                    outcome, by = "no_due", None
                elif close is not None:
                    outcome, by = "similar", close
                elif text_class in first:
                    outcome, by = "duplicate", first[text_class]
                else:
                    outcome, by = "written", None
                    counts[session] = counts.get(session, 0) + 1
                    there.add(i)
                    first[text_class] = i
                worlds.append(own)
                ids.append(i)
                outcomes.append(outcome)
                existing.append(by)
            kinds = [batch.schema.field("world").type, pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((worlds, ids, outcomes, existing), kinds, strict=True)], names=["world", "id", "outcome", "existing"])

    # Held memories first, then by time: one stream a world.
    ordered = ready.select(*columns).repartition("world").sortWithinPartitions("world", F.col("fresh"), "ms", "id")
    return ordered.mapInArrow(fold, f"world {world}, id long, outcome string, existing long")
