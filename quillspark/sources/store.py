"""Sources and sinks: pages, records, partitions, manifests, suites, blobs, reports, as Spark tables under one folder.

Everything goes through Spark's own readers and writers, so any store that Spark reaches will do. Writes that
replace something are idempotent: they write beside the target and are read from the newest version."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R

#: Corpus formats that this engine reads, and what a corpus may require of it.
FORMAT_VERSIONS = (1,)
CAPABILITIES = {"bm25", "neighbours", "aliases"}


def scan(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a folder; only the columns asked for are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def content(titles: DataFrame, pages: DataFrame, title: str) -> DataFrame:
    """Bodies of the titles; titles without a page come back with nulls."""
    return titles.join(pages, title, "left")


def links(pairs: DataFrame, page: str, link: str) -> DataFrame:
    return pairs.groupBy(page).agg(F.array_sort(F.collect_set(link)).alias("links"))


def upsert(held: DataFrame, fresh: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest version wins; a fresh row wins over a held one of the same version."""
    both = held.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return R.first_per_group(both, key, [F.desc(version), F.desc("_new")]).drop("_new")


def insert_or_ignore(held: DataFrame, fresh: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored rows that are new, ignored rows): the first of a key in order is stored, if the key isn't held."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = fresh.withColumn("_rn", F.row_number().over(w)).join(held.select(*key, F.lit(1).alias("_held")).dropDuplicates(key), key, "left")
    stored = (F.col("_rn") == 1) & F.col("_held").isNull()
    return marked.filter(stored).drop("_rn", "_held"), marked.filter(~stored).drop("_rn", "_held")


def drop_with_snapshot(pages: DataFrame, gone: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed): removed pages keep their records as JSON."""
    derived = records.join(gone, key, "left_semi").groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in records.columns if c != key])))).alias("records"))
    return pages.join(gone, key, "left_anti"), pages.join(gone, key, "left_semi").join(derived, key, "left")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that the frame holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replaced_seeds(held: DataFrame, fresh: DataFrame, preserve: list[str]) -> tuple[DataFrame, DataFrame]:
    """(seeds after, titles that left): enumerated sets are replaced, the preserved ones stay."""
    kept = held.filter(F.col("seed").isin(preserve)) if preserve else held.filter("false")
    after = kept.unionByName(fresh).distinct()
    return after, held.select("title").subtract(after.select("title"))


def write_corpus(tables: dict[str, DataFrame], path: str, manifest: dict[str, object]) -> str:
    """Write all tables under a new version, then its manifest: a version without manifest doesn't exist.

    A failed build leaves the version before it as the newest whole one."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{path}/v{_latest(spark, path) + 1:06d}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{version}/{name}")
    rows = [(k, json.dumps(v)) for k, v in sorted(manifest.items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{version}/manifest")
    return version


def _latest(spark: SparkSession, path: str) -> int:
    """The newest version with a whole manifest."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest/_SUCCESS"))]
    return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)


def read_corpus(spark: SparkSession, path: str) -> tuple[dict[str, object], str]:
    """(manifest, folder) of the newest version; unknown formats and requirements are refused."""
    latest = _latest(spark, path)
    if not latest:
        raise FileNotFoundError(f"no corpus at {path}")
    version = f"{path}/v{latest:06d}"
    return read_manifest(spark.read.parquet(f"{version}/manifest")), version


def read_manifest(rows: DataFrame, required: Iterable[str] = ("format_version",)) -> dict[str, object]:
    manifest = {r["key"]: json.loads(r["value"]) for r in rows.collect()}
    missing = [k for k in required if k not in manifest]
    if missing:
        raise ValueError(f"the manifest lacks {missing}")
    if manifest["format_version"] not in FORMAT_VERSIONS:
        raise ValueError(f"unknown format version {manifest['format_version']!r}")
    unknown = set(manifest.get("requires", [])) - CAPABILITIES
    if unknown:
        raise ValueError(f"the corpus requires {sorted(unknown)}")
    return manifest


def write_suite(suite: DataFrame, path: str) -> None:
    """One JSON object a line, by qid; range-partitioned, so that files in name order are in qid order."""
    suite.repartitionByRange("qid").sortWithinPartitions("qid").write.mode("overwrite").json(path)


def read_suite(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed lines; the first one that can't be read is named in the error."""
    df = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    # A parsed column has to be read beside the raw one.
    bad = df.select("_bad", df.columns[0], F.input_file_name().alias("file")).filter("_bad is not null").limit(1).collect()
    if bad:
        raise ValueError(f"not a suite line in {bad[0]['file']}: {bad[0]['_bad'][:200]}")
    return df.drop("_bad")


def attached(spark: SparkSession, main: str, cache: str | None) -> tuple[DataFrame, DataFrame | None]:
    """A table and its raw cache, if that is there."""
    try:
        raw = spark.read.parquet(cache) if cache else None
    except AnalysisException:
        raw = None
    return spark.read.parquet(main), raw


def put_blobs(held: DataFrame, blobs: DataFrame, body: str) -> DataFrame:
    """Content-addressed: ``key, body`` of blobs that aren't held; equal bodies are one."""
    made = blobs.select(F.sha2(body, 256).alias("key"), F.col(body).cast("binary").alias("body")).dropDuplicates(["key"])
    return made.join(held.select("key"), "key", "left_anti")


def blob_usage(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("bytes"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report's table as Markdown. Reports are aggregates; more than ``limit`` rows are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    show = lambda x: "" if x is None else str(x).replace("|", "\\|")
    head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(map(show, r))} |\n" for r in rows)


def measure(spark: SparkSession, spec: str) -> str:
    """A scalar SQL measure over the session's views; ``?`` where it can't be run."""
    try:
        row = spark.sql(spec).first()
    except AnalysisException:
        return "?"
    return "?" if row is None else str(row[0])
