"""A folder for intermediate files: the cluster's shared one, or a temporary one where none is set and all tasks run here.

What lies there goes when the application ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a path: what is stored under these numbers is still right."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = system.getContentSummary(place)
    return size.getLength(), size.getFileCount(), system.getFileStatus(place).getModificationTime()


def spread(df: DataFrame, small: int = 1 << 30) -> DataFrame:
    """A small input in few files is dealt over all cores; larger ones are read as they lie."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and bytes_of(df) < small else df


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of a frame's size: for files, theirs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once into a scratch folder: for what is read more than once, or joined by its size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only where that is unset, as in tests, a local folder serves."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        place = _own[0]
    path = f"{place}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
