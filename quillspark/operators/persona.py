"""Material for a persona: text selection under budgets. Greedy steps look at what was taken, so they fold per person."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R

# Budgets and limits of the material.
MATERIAL_TOKENS, STORY_TOKENS, EXAMPLES, EXAMPLE_TOKENS, PROMPT_TOKENS = 5000, 1500, 8, 400, 400


def budget_fill(items: DataFrame, person: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Items in order while they fit; one that doesn't fit is skipped, later smaller ones may still fit.

    The fold carries what is left through one aggregate over a person's items."""
    keys = F.struct(*order, F.col(tokens).alias("_t"), F.struct(*[c for c in items.columns if c != person]).alias("_row"))
    ordered = items.groupBy(person).agg(F.array_sort(F.collect_list(keys)).alias("_s"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.filter(F.transform("_s", lambda s: s["_row"]), lambda s: F.lit(False)).alias("taken"))
    fold = F.aggregate(
        "_s",
        start,
        lambda a, s: F.struct(
            F.when(s["_t"] <= a["left"], a["left"] - s["_t"]).otherwise(a["left"]).alias("left"),
            F.when(s["_t"] <= a["left"], F.concat(a["taken"], F.array(s["_row"]))).otherwise(a["taken"]).alias("taken"),
        ),
    )
    return ordered.select(person, F.explode(fold["taken"]).alias("_x")).select(person, "_x.*")


def even_budget_sample(items: DataFrame, person: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Evenly spaced items: k = budget / mean of them, fewer until they fit."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        n, mean = len(frame), max(frame[tokens].mean(), 1e-9)
        k = min(n, int(budget / mean))
        while k > 0:
            chosen = frame.iloc[[i * n // k for i in range(k)]]
            if chosen[tokens].sum() <= budget:
                return chosen
            k -= 1
        return frame.iloc[:0]

    return items.groupBy(person).applyInPandas(pick, items.schema)


def van_der_corput(n: int) -> float:
    """The n-th number of the base-2 sequence."""
    out, part = 0.0, 0.5
    while n:
        out += part * (n & 1)
        n >>= 1
        part /= 2
    return out


def spread_pick(items: DataFrame, person: str, group: list[str], order: str, k: int) -> DataFrame:
    """k items a person, taken from its groups in turn, within a group in low-discrepancy order."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        queues = []
        for _, own in sorted(frame.groupby(group, sort=True), key=lambda x: str(x[0])):
            own = own.sort_values(order, kind="stable")
            n = len(own)
            places = list(dict.fromkeys(int(van_der_corput(i) * n) for i in range(4 * n)))
            queues.append([own.index[p] for p in places] + [i for p, i in enumerate(own.index) if p not in set(places)])
        out, turn = [], 0
        while len(out) < k and any(len(q) > turn for q in queues):
            out += [q[turn] for q in queues if len(q) > turn]
            turn += 1
        return frame.loc[out[:k]]

    return items.groupBy(person).applyInPandas(pick, items.schema)


def eligible(persons: DataFrame, units: DataFrame, person: str, least: int = 1) -> DataFrame:
    """Persons with at least ``least`` speech units."""
    counts = units.groupBy(person).agg(F.count("*").alias("units"))
    return R.with_default(persons, counts, person, "units", 0).filter(F.col("units") >= least)


def gates(text: Column, name: Column, limit_tokens: int = PROMPT_TOKENS) -> Column:
    """Which gates an output fails, as an array: empty, budget, name, meta, prescriptive."""
    checks = {
        "empty": ~text.rlike(r"[\p{L}\p{N}]"),
        "budget": F.length(text) > limit_tokens * 4,
        "name": ~F.contains(F.lower(text), F.lower(name)),
        "meta": text.rlike(r"(?i)\b(?:as an ai|language model|system prompt)\b"),
        "prescriptive": text.rlike(r"(?i)\byou (?:must|should|always|never)\b"),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def stale(sent: DataFrame, now: DataFrame, person: str, item: str) -> DataFrame:
    """``person, gone, grown``: items that a persona was made from and are no more, and new ones since."""
    gone = sent.join(now, [person, item], "left_anti").groupBy(person).agg(F.count("*").alias("gone"))
    grown = now.join(sent, [person, item], "left_anti").groupBy(person).agg(F.count("*").alias("grown"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return gone.join(grown, person, "full_outer").select(person, zero("gone"), zero("grown"))


def words_once(items: DataFrame, person: str, text: str, order: str) -> DataFrame:
    """A person's items without those whose words it has already."""
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return R.first_per_group(items.withColumn("_plain", plain), [person, "_plain"], [order]).drop("_plain")


def kind_order(items: DataFrame, person: str, kind: str, order: str) -> DataFrame:
    """k-th items of all kinds before the next ones: ``place``."""
    turn = F.row_number().over(Window.partitionBy(person, kind).orderBy(order))
    return items.withColumn("_turn", turn).withColumn("place", F.row_number().over(Window.partitionBy(person).orderBy("_turn", kind, order))).drop("_turn")
