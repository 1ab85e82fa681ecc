"""The extension surface: parsers, hooks, followups, plugins, tokeniser dispatch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame

from ..functions import text as X


def parsed(pages: DataFrame, parser: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Records of each page by a user's parser, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for page in frame.to_dict("records") for r in parser(page)]
            yield pd.DataFrame(rows, columns=names)

    names = [c.strip().split()[0] for c in schema.split(",")]
    return pages.mapInPandas(run, schema)


def followed_up(start: DataFrame, discover: Callable[[DataFrame], DataFrame], known: DataFrame, rounds: int = 64) -> DataFrame:
    """Titles reached from the start: each round discovers from the new ones only, until none are new.

    Rounds are checkpointed where the session has a folder for it, else their lineage stays."""
    spark = start.sparkSession
    seen = new = start.distinct()
    for _ in range(rounds):
        new = discover(new).distinct().join(known, "title", "left_semi").join(seen, "title", "left_anti")
        if spark.sparkContext.getCheckpointDir():
            new = new.checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"followups did not end in {rounds} rounds")


@dataclass(frozen=True)
class Pack:
    """Callables that a corpus brings along; each takes a row and gives a value. Missing ones give null."""

    resolve: Callable | None = None
    portrait: Callable | None = None
    birthday: Callable | None = None
    topic_terms: Callable | None = None
    faction: Callable | None = None

    def apply(self, df: DataFrame, name: str, column: str, kind: str = "string") -> DataFrame:
        from pyspark.sql import functions as F

        hook = getattr(self, name)
        if hook is None:
            return df.withColumn(name, F.lit(None).cast(kind))

        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return values.map(hook)

        return df.withColumn(name, run(column))


# Limits of a plugin's manifest.
MOST_TOOLS, LEAST_TIMEOUT, MOST_TIMEOUT, PROTOCOL = 8, 50, 5000, 1


@dataclass(frozen=True)
class Plugin:
    name: str
    tools: tuple[str, ...]
    timeout_ms: int

    @staticmethod
    def parse(manifest: dict) -> Plugin:
        name, tools = manifest.get("name", ""), tuple(manifest.get("tools", ()))
        if not re.fullmatch(r"[a-z][a-z0-9_-]{0,39}", name):
            raise ValueError(f"not a plugin name: {name!r}")
        if manifest.get("protocol") != PROTOCOL:
            raise ValueError(f"unknown protocol {manifest.get('protocol')!r}")
        if len(tools) > MOST_TOOLS or len(set(tools)) != len(tools):
            raise ValueError("too many tools, or one twice")
        return Plugin(name, tools, min(MOST_TIMEOUT, max(LEAST_TIMEOUT, int(manifest.get("timeout_ms", 1000)))))


class PluginHost:
    """Calls plugin hooks; one that fails three times is stopped, and its hooks then change nothing."""

    def __init__(self, most_failures: int = 3):
        self.most_failures, self.failures = most_failures, {}

    def call(self, plugin: str, hook: Callable, value, limit: int = 4000):
        if self.failures.get(plugin, 0) >= self.most_failures:
            return value
        try:
            out = hook(value)
        except Exception:  # a plugin's own error, of any kind, counts against it
            self.failures[plugin] = self.failures.get(plugin, 0) + 1
            return value
        return out[:limit] if isinstance(out, str) else out


def tokeniser(name: str) -> Callable[[Column], Column]:
    """The tokeniser that a manifest names; ``+n1`` adds the folding that all of them do here."""
    base = name.removesuffix("+n1")
    known = {"latin": X.tokens, "bigram": X.bigram_tokens}
    if base not in known:
        raise ValueError(f"unknown tokeniser {name!r}")
    return known[base]
