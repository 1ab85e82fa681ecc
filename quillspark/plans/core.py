"""Registration of queries, and the relations that the driver tables stand in for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def dealt_documents(self) -> DataFrame:
        """The documents, over all cores: for queries that work on every text."""
        return spread(self.documents)

    @property
    def units(self) -> DataFrame:
        """Retrieval units: one a document."""
        return self.documents.select(
            F.col("doc_id").alias("ord"), F.concat(F.lit("u"), "doc_id").alias("id"), F.col("source").alias("page"), F.col("lang").alias("template"), "text", F.length("text").cast("long").alias("chars")
        )

    @property
    def lines(self) -> DataFrame:
        """Spoken lines: one a turn."""
        return self.conversations.select(F.col("conv_id").alias("scene"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")

    @property
    def attribution(self) -> DataFrame:
        """Which unit belongs to which person."""
        return self.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("person")).distinct()

    @property
    def ranges(self) -> DataFrame:
        """Position ranges within a span."""
        low = F.col("l_linenumber").cast("long")
        return self.lineitem.select(F.col("l_orderkey").alias("span_of"), low.alias("lo"), (low + F.col("l_partkey") % 3).alias("hi")).distinct()

    @property
    def message(self) -> DataFrame:
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.events.select(F.col("event_id").alias("id"), ms.alias("ms"), F.col("user_id").alias("author"), (F.col("user_id") % 10).alias("channel"), F.col("event_type").alias("kind"), "props")

    @property
    def meter(self) -> DataFrame:
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.events.select(
            F.col("event_id").alias("id"),
            ms.alias("ms"),
            F.col("event_type").alias("shape"),
            F.floor(F.col("value") * 100).cast("long").alias("uncached"),
            F.floor(F.col("value") * 10).cast("long").alias("cached"),
            F.floor("value").cast("long").alias("output"),
            F.floor(F.col("value") * 125).cast("long").alias("points"),
            F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("requests"),
        )

    @property
    def persons(self) -> DataFrame:
        return self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("person"), F.col("s_name").alias("display"), F.col("n_name").alias("home"), F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("balance")
        )


#: The same relations in DuckDB.
VIEWS = {
    "units": "SELECT doc_id AS ord, 'u' || doc_id AS id, source AS page, lang AS template, text, length(text)::BIGINT AS chars FROM documents",
    "lines": "SELECT conv_id AS scene, turn AS seq, role AS speaker, text FROM conversations",
    "attribution": "SELECT DISTINCT l_orderkey AS unit, l_suppkey AS person FROM lineitem",
    "ranges": "SELECT DISTINCT l_orderkey AS span_of, l_linenumber::BIGINT AS lo, l_linenumber::BIGINT + l_partkey % 3 AS hi FROM lineitem",
    "message": "SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, user_id AS author, user_id % 10 AS channel, event_type AS kind, props FROM events",
    "meter": "SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, event_type AS shape, floor(value * 100)::BIGINT AS uncached, floor(value * 10)::BIGINT AS cached, floor(value)::BIGINT AS output, floor(value * 125)::BIGINT AS points, (event_type = 'purchase')::BIGINT AS requests FROM events",
    "persons": "SELECT s_suppkey AS person, s_name AS display, n_name AS home, n_regionkey AS region, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}


def oracle(body: str) -> str:
    """DuckDB SQL with the relations that it names in front."""
    import re

    named = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = body.strip()
    if not named:
        return body
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = body[5:].lstrip()[10 if recursive else 0 :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{views}, {rest}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over Tables, with its DuckDB SQL where there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return register
