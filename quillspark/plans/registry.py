"""Registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import core

MODULES = ["relational", "scalars", "retrieval", "evaluate", "world", "corpus", "sources", "persona", "streams"]
for _name in MODULES:
    __import__(f"{__package__}.{_name}")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch retrieval of every benchmark item."""
    return core.QUERIES["r25_search"](spark, sf_dir)


def queries() -> dict[str, core.Query]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)
