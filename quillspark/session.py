"""Session settings shared by the tests, the benchmark and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects of a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
