"""Guards: checks whose findings are rows, one function each. A finding has a severity, high or low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import relational as R


def drift(counts: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """``key, severity``: fell is high, grew is low, equal is silent; a key without baseline is low, without any all are one low."""
    both = counts.select(key, F.col("n").alias("_now")).join(baseline.select(key, F.col("n").alias("_was")), key, "full_outer")
    severity = F.when(F.col("_was").isNull(), "low").when(F.coalesce("_now", F.lit(0)) < F.col("_was"), "high").when(F.col("_now") > F.col("_was"), "low")
    return both.withColumn("severity", severity).filter("severity is not null").select(key, "severity")


def measured(watermark: Column, **counts: DataFrame) -> DataFrame:
    """``part, name, n``: a part's count of each name; ``watermark`` of the first part's rows stands as a row of its own.

    counts: frames with a column ``name``, one row for what is counted, by part."""
    rows = [df.groupBy(F.col("name").cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n") for part, df in counts.items()]
    out = next(iter(counts.values())).agg(F.coalesce(watermark, F.lit(0)).cast("long").alias("n")).select(F.lit("meta").alias("part"), F.lit("watermark").alias("name"), "n")
    for df in rows:
        out = out.unionByName(df)
    return out


def accept(measures: DataFrame, path: str) -> str:
    """Record what was measured as the baseline that later runs are held against; a new version each time."""
    return store.write_corpus({"baseline": measures}, path, {"format_version": 1})


def accepted(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest baseline, if one was accepted."""
    try:
        _, version = store.read_corpus(spark, path)
    except FileNotFoundError:
        return None
    return spark.read.parquet(f"{version}/baseline")


def against_baseline(measures: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """``part, name, n, was, severity``: what shrank is high, what grew or is new is low, equal counts are silent.

    Without a baseline each part has one low finding that says so (name null). The watermark is no count."""
    now = measures.filter("part <> 'meta'")
    if baseline is None:
        none = F.lit(None)
        return now.select("part").distinct().select("part", none.cast("string").alias("name"), none.cast("long").alias("n"), none.cast("long").alias("was"), F.lit("low").alias("severity"))
    was = baseline.filter("part <> 'meta'").withColumnRenamed("n", "was")
    both = now.join(was, ["part", "name"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    severity = F.when(F.col("was").isNull() | (F.col("n") > F.col("was")), "low").when(F.col("n") < F.col("was"), "high")
    return both.withColumn("severity", severity).filter("severity is not null").select("part", "name", "n", "was", "severity")


def reconciled(made: DataFrame, kept: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """Keys whose produced count isn't kept plus ignored."""
    held = made.select(key, F.col("n").alias("made")).join(kept.select(key, F.col("n").alias("kept")), key, "left").join(ignored.select(key, F.col("n").alias("ignored")), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return held.select(key, "made", zero("kept"), zero("ignored")).filter("made <> kept + ignored")


def alias_conflicts(aliases: DataFrame, max_chars: int = 25) -> DataFrame:
    """hop: a target that is an alias elsewhere; sentence: too long; conflict: several targets."""
    hop = aliases.join(aliases.select(F.col("alias").alias("target")).distinct(), "target", "left_semi").filter("alias <> target").select("alias", F.lit("hop").alias("problem")).distinct()
    long = aliases.filter(F.length("alias") > max_chars).select("alias", F.lit("sentence").alias("problem")).distinct()
    several = aliases.groupBy("alias").agg(F.countDistinct("target").alias("n")).filter("n > 1").select("alias", F.lit("conflict").alias("problem"))
    return hop.unionByName(long).unionByName(several)


def size_budget(units: DataFrame, template: str, chars: str, budget: int, least: int = 24) -> DataFrame:
    """Units over 125 % of the budget or under ``least`` characters; high from 1 % over or 20 % under."""
    made = units.groupBy(template).agg(F.count("*").alias("n"), F.sum((F.col(chars) * 100 > budget * 125).cast("long")).alias("over"), F.sum((F.col(chars) < least).cast("long")).alias("under"))
    severity = F.when((F.col("over") * 100 >= F.col("n")) & (F.col("over") > 0) | (F.col("under") * 5 >= F.col("n")) & (F.col("under") > 0), "high").when((F.col("over") > 0) | (F.col("under") > 0), "low")
    return made.withColumn("severity", severity).filter("severity is not null")


def empty_pages(pages: DataFrame, records: DataFrame, key: str, reason: Column) -> DataFrame:
    """Pages without records: low with a reason, high without."""
    none = pages.join(records.select(key).distinct(), key, "left_anti")
    return none.select(key, F.when(reason.isNotNull(), "low").otherwise("high").alias("severity"))


def unexplained(findings: DataFrame, notes: DataFrame, detail: str) -> DataFrame:
    """Low findings that no note's pattern explains. notes: ``pattern``, a list kept by hand, broadcast behind a count."""
    return findings.filter("severity = 'low'").join(R.small(notes), F.expr(f"{detail} rlike pattern"), "left_anti")


def unread_kinds(kinds: DataFrame, readers: DataFrame) -> DataFrame:
    return kinds.select("kind").distinct().join(readers, "kind", "left_anti")


def meets(value: float, target: str) -> bool:
    """Whether a figure meets a target such as ``< 512`` or ``>= .5``."""
    import operator
    import re

    m = re.fullmatch(r"\s*(<=|>=|<|>|=)\s*(-?[0-9]*\.?[0-9]+)\s*", target)
    if not m:
        raise ValueError(f"not a target: {target!r}")
    return {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq}[m[1]](value, float(m[2]))
