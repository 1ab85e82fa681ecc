"""Sources behind a cursor: title lists of seeds, and a change feed, as Spark data sources for batch and streams.

An endpoint answers a request with rows and the cursor of the next request, none after the last. ``walk`` follows the
cursors and refuses one that it has met before, which would never end. A title list is read with one task for each seed.
A feed comes newest first and is read back to a watermark; it is incomplete if it ends, or has named more than
``limit`` titles, before that. The stream's offset is the watermark, so a restart goes on where the last batch ended.

An endpoint here is a folder of answers that Spark wrote (``answers``): Parquet files under ``seed=/page=``, each page's
rows in order, and the cursor of a page is the number of the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Titles that a feed may name before it counts as incomplete.
FEED_LIMIT = 5000
PAGE_ROWS = 500
MOST_SEEDS = 10_000

Fetch = Callable[[str | None], tuple[list, str | None]]


class CursorError(RuntimeError):
    """A cursor that doesn't advance."""


def walk(fetch: Fetch) -> Iterator:
    """The rows of all answers in order."""
    cursor, seen = None, set()
    while True:
        rows, cursor = fetch(cursor)
        yield from rows
        if cursor is None:
            return
        if cursor in seen:
            raise CursorError(f"the cursor {cursor!r} did not advance")
        seen.add(cursor)


def changed_since(entries: Iterable[tuple[int, str]], watermark: int, limit: int = FEED_LIMIT) -> tuple[dict[str, int], int, bool]:
    """(newest change of each title, the new watermark, whether the old one was reached). entries: ``rcid, title``, newest first."""
    touched: dict[str, int] = {}
    newest = watermark
    for rcid, title in entries:
        newest = max(newest, rcid)
        if rcid <= watermark:
            return touched, newest, True
        touched.setdefault(title, rcid)
        if len(touched) > limit:
            break
    return touched, newest, False


def answers(rows: DataFrame, path: str, order: list, seed: str | None = None, page_rows: int = PAGE_ROWS) -> str:
    """Write an endpoint's answers: pages of ``page_rows`` rows of each seed, in order.

    Pages are numbered by range of the order: a row's number is that in its slice, after the counts of earlier slices."""
    spark = rows.sparkSession
    named = rows.withColumn("seed", F.col(seed).cast("string") if seed else F.lit("all"))
    sliced = f"{path}/sliced"
    named.repartitionByRange("seed", *order).withColumn("_slice", F.spark_partition_id()).write.parquet(sliced)
    cut = spark.read.parquet(sliced)
    counts = cut.groupBy("seed", "_slice").agg(F.count("*").alias("_n"))
    before = counts.select("seed", "_slice", (F.sum("_n").over(Window.partitionBy("seed").orderBy("_slice")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("seed", "_slice").orderBy(*order)) - 1
    paged = cut.withColumn("_place", place).join(before, ["seed", "_slice"]).withColumn("_place", F.col("_place") + F.col("_before"))
    paged = paged.withColumn("page", F.floor(F.col("_place") / page_rows)).drop("_slice", "_before")
    paged.repartition("seed", "page").sortWithinPartitions("seed", "page", "_place").drop("_place").write.partitionBy("seed", "page").parquet(f"{path}/answers")
    return f"{path}/answers"


class Answers:
    """Fetches pages of one seed from a folder."""

    def __init__(self, path: str, seed: str = "all"):
        self.path, self.seed = path, seed

    def __call__(self, cursor: str | None) -> tuple[list[dict], str | None]:
        system, root = pafs.FileSystem.from_uri(self.path)
        page = int(cursor or 0)
        here = f"{root}/seed={self.seed}/page={page}"
        if system.get_file_info(here).type == pafs.FileType.NotFound:
            return [], None
        files = sorted(x.path for x in system.get_file_info(pafs.FileSelector(here)) if x.path.endswith(".parquet"))
        table = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in files])
        return table.to_pylist(), str(page + 1)


class _Seed(InputPartition):
    def __init__(self, seed: str):
        self.seed = seed


class _TitleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.seeds, self.column = options["path"], options["seeds"].split(","), options["column"]

    def partitions(self) -> list[InputPartition]:
        return [_Seed(s) for s in self.seeds]

    def read(self, partition: _Seed) -> Iterator[tuple]:
        for row in walk(Answers(self.path, partition.seed)):
            yield partition.seed, str(row[self.column])


class Titles(DataSource):
    """``seed, title`` of the seeds asked for (options path, seeds, column)."""

    @classmethod
    def name(cls) -> str:
        return "quillspark_titles"

    def schema(self) -> str:
        return "seed string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _TitleReader(self.options)


class _Feed:
    def __init__(self, options: dict):
        self.path, self.limit, self.watermark = options["path"], int(options.get("limit", FEED_LIMIT)), int(options.get("watermark", 0))

    def since(self, watermark: int) -> tuple[list[tuple], int]:
        entries = ((int(r["rcid"]), str(r["title"])) for r in walk(Answers(self.path)))
        touched, newest, reached = changed_since(entries, watermark, self.limit)
        return [(title, rcid, newest, reached) for title, rcid in touched.items()], newest


class _FeedReader(_Feed, DataSourceReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.since(self.watermark)[0]


class _FeedStream(_Feed, SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"watermark": self.watermark}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, newest = self.since(start["watermark"])
        return iter(rows), {"watermark": newest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is repeated after a failure: the same rows, though the feed may have grown."""
        entries = ((int(r["rcid"]), str(r["title"])) for r in walk(Answers(self.path)))
        touched, newest, reached = changed_since((x for x in entries if x[0] <= end["watermark"]), start["watermark"], self.limit)
        return iter([(title, rcid, newest, reached) for title, rcid in touched.items()])

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """``title, rcid, watermark, complete``: titles changed since a watermark (options path, watermark, limit)."""

    @classmethod
    def name(cls) -> str:
        return "quillspark_changes"

    def schema(self) -> str:
        return "title string, rcid long, watermark long, complete boolean"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FeedStream(self.options)


def seed_names(rows: DataFrame, seed: str) -> list[str]:
    """The seeds, which are few and plain names; more than ``MOST_SEEDS`` are an error."""
    names = sorted(str(r[0]) for r in rows.select(seed).distinct().limit(MOST_SEEDS + 1).collect())
    if len(names) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    return names


def titles(spark: SparkSession, path: str, seeds: list[str], column: str = "title") -> DataFrame:
    spark.dataSource.register(Titles)
    return spark.read.format(Titles.name()).option("path", path).option("seeds", ",".join(seeds)).option("column", column).load()


def changes(spark: SparkSession, path: str, watermark: int, limit: int = FEED_LIMIT, stream: bool = False) -> DataFrame:
    spark.dataSource.register(ChangeFeed)
    reader = spark.readStream if stream else spark.read
    return reader.format(ChangeFeed.name()).option("path", path).option("watermark", str(watermark)).option("limit", str(limit)).load()
