"""Migration of stored worlds: numbered steps from one layout to the next, then a policy on what the newest one keeps.

A world is a versioned set of tables whose manifest names its layout (``layout``). ``climb`` applies the steps above that
number, each to whole tables, and commits each as a version of its own: after a failure the world stands at the last step
that succeeded, and the next run goes on from there. ``keep`` then drops tables that the layout doesn't have and rows whose
keys it doesn't know, and counts what went."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """To layout ``to``: what changes, and how."""

    to: int
    note: str
    change: Callable[[Tables], Tables]


@dataclass(frozen=True)
class Layout:
    """The newest layout: columns of each table (name: type and default), keys that keyed tables may hold, tables that start empty."""

    tables: dict[str, dict[str, tuple[str, object]]]
    keys: dict[str, tuple[str, ...]]
    emptied: tuple[str, ...] = ()


def pending(layout: int, steps: list[Step]) -> list[str]:
    """The steps that a world at a layout still needs, as lines of a report."""
    return [f"layout {s.to - 1} -> {s.to}: {s.note}" for s in sorted(steps, key=lambda s: s.to) if s.to > layout]


def read_world(spark: SparkSession, path: str) -> tuple[Tables, dict]:
    manifest, version = store.read_corpus(spark, path)
    return {name: spark.read.parquet(f"{version}/{name}") for name in manifest["tables"]}, manifest


def write_world(tables: Tables, path: str, layout: int) -> str:
    return store.write_corpus(tables, path, {"format_version": 1, "layout": layout, "tables": sorted(tables)})


def climb(spark: SparkSession, path: str, steps: list[Step]) -> list[str]:
    """Apply the steps that are pending, a version each; gives their lines. A gap in their numbers is an error."""
    at = read_world(spark, path)[1]["layout"]
    todo = sorted((s for s in steps if s.to > at), key=lambda s: s.to)
    if [s.to for s in todo] != list(range(at + 1, at + 1 + len(todo))):
        raise ValueError(f"steps from layout {at} are missing or double: {[s.to for s in todo]}")
    for step in todo:
        tables, _ = read_world(spark, path)
        write_world(step.change(tables), path, step.to)
    return pending(at, todo)


def shaped(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows in the newest shape: known columns kept and cast, missing ones with their default, unknown ones dropped."""
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(n).cast(kind), F.lit(default).cast(kind)) if n in have else F.lit(default).cast(kind)).alias(n) for n, (kind, default) in columns.items()])


def keep(tables: Tables, layout: Layout, key: str = "key") -> tuple[Tables, DataFrame]:
    """(tables of the newest layout; ``part, name, n`` of what goes: tables with their rows, unknown keys, emptied rows).

    A table that isn't there comes empty, in its columns."""
    spark = next(iter(tables.values())).sparkSession
    gone = [spark.createDataFrame([], "part string, name string, n long")]
    count = lambda df, part, name: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.lit(name).alias("name"), "n")
    gone += [count(df, "table", name) for name, df in tables.items() if name not in layout.tables]
    out = {}
    for name, columns in layout.tables.items():
        df = tables.get(name)
        if df is None:
            out[name] = spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, (kind, _) in columns.items()))
            continue
        if name in layout.keys:
            known = F.coalesce(F.col(key).isin(list(layout.keys[name])), F.lit(False))
            gone.append(df.filter(~known).groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n")).select(F.lit(f"{name} key").alias("part"), "name", "n"))
            df = df.filter(known)
        if name in layout.emptied:
            gone.append(count(df, "emptied", name))
            df = df.limit(0)
        out[name] = shaped(df, columns)
    dropped = gone[0]
    for df in gone[1:]:
        dropped = dropped.unionByName(df)
    return out, dropped.filter("n > 0")
