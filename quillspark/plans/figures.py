"""A registry of derived figures: a name, how it is measured, and the target that it should meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.guards import meets
from .core import Tables

FIGURES: dict[str, Callable[[Tables], DataFrame]] = {
    "units": lambda t: t.units.agg(F.count("*").cast("double").alias("value")),
    "mean_chars": lambda t: t.units.agg(F.round(F.avg("chars"), 6).alias("value")),
    "persons": lambda t: t.persons.agg(F.count("*").cast("double").alias("value")),
    "attributed_units": lambda t: t.attribution.agg(F.countDistinct("unit").cast("double").alias("value")),
    "spoken_lines": lambda t: t.lines.agg(F.count("*").cast("double").alias("value")),
}


def figure_table(t: Tables, targets: dict[str, str]) -> DataFrame:
    """``figure, value, ok`` for each figure with a target; one row each reaches the driver."""
    rows = []
    for name, target in targets.items():
        value = FIGURES[name](t).first()["value"]
        rows.append((name, value, meets(value, target)))
    return t.spark.createDataFrame(rows, "figure string, value double, ok boolean")
