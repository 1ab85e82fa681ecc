"""Shared helpers: tables in the cluster's shared folder, keys, Arrow text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: such rows come after all others.
LAST_ID = 2**63 - 1

#: Bytes of text that a kernel works on at once.
CHUNK_BYTES = 1 << 19

#: Bytes of an Arrow batch on its way to Python, at most.
BATCH_BYTES = 16 << 20

_own: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where that is unset and all tasks run here."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return _own[0]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, group_rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The files go when the application ends, or with ``released``. ``group_rows``: rows of a row group at most, for rows of
    megabytes: a writer keeps a group, and a reader decodes up to 4096 rows of one, at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    for df in frames:
        if path := _paths.pop(df, None):
            system, place = _file_system(df.sparkSession, path)
            system.delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ``BATCH_BYTES``: long texts would else fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def thinned(df: DataFrame, wanted: int, *key: str, seed: int = 0) -> DataFrame:
    """The rows with the smallest hashes of the key columns, ``wanted`` of them or a little more (all, if fewer).

    A share of the hash range is kept, so no task and no merge holds more than its share of the sample."""
    n = df.count()
    if n <= wanted:
        return df
    share = min(1.0, (wanted + 6 * wanted**0.5) / n)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 48)) < int(share * (1 << 48)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``did`` (null ids last), ``th`` (hash of the text, so that rows sharing an id stay apart), ``text``.

    Only the two named columns are read, so extra columns can't clash; ``carry`` adds the columns other
    than the text in a struct ``row``."""
    bounded_batches(docs.sparkSession)
    text = docs[text_col]
    rest = [F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")] if carry else []
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("did"),
        F.xxhash64(text).alias("th"),
        F.coalesce(text, F.lit("")).alias("text"),
        *rest,
    )


def once(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each (``did, th``) with one of its rows, and the ``did, th`` of those that had several (none: no such).

    Only keys are shuffled where no row is repeated; else the texts of repeated rows are, as many rows as they have."""
    many = texts.groupBy("did", "th").agg(F.count("*").alias("rows")).filter("rows > 1").select("did", "th")
    many = stored(many, "repeated-rows")
    if many.isEmpty():
        return texts, None
    return texts.join(many, ["did", "th"], "left_anti").unionByName(texts.join(many, ["did", "th"], "left_semi").dropDuplicates(["did", "th"])), many


def id_back(did: Column) -> Column:
    """The id as it was: the stand-in becomes null again."""
    return F.when(did != LAST_ID, did)


def utf8_parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, end row, bytes, offsets into them)."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
