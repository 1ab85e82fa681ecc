"""A corpus pipeline of five stages; each takes what the one before kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``;
the last returns the packed pieces. Cases that the operators define (nulls, empty texts, repeated rows,
empty tables, extra columns) hold here too: extra columns are carried through the first four stages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import released, stored, table
from quillspark.llm.lines import remove_shared_blocks
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.mixing import mixed
from quillspark.llm.packing import GROUP_DOCS, packed
from quillspark.llm.quality import THRESHOLD, fit_on, scored_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of these documents."""
    scored = scored_rows(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") >= THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the later one; what is left of it stays.

    A document that loses all its lines goes. So does a near copy of a single earlier document, if their common
    lines alone hold three quarters of the five-word runs of both: what is left would match nothing later on."""
    cut = remove_shared_blocks(docs, carry=True)
    cut = cut.filter(((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))) & ~F.col("near_copy"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row")[c].alias(c))
    return cut.select(*columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows that share an id and a text are one document; other texts under its id that are kept stay too."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rest = F.to_json(F.struct(*[docs[c] for c in docs.columns if c not in ("doc_id", "text")]))
    named = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("th"), rest.alias("rest"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = named.filter("id is not null").join(gone, "id", "left_anti")
    # Of rows that differ in other columns only, a fixed one stays.
    first = kept.groupBy("id", "th").agg(F.min_by("row", F.coalesce("rest", F.lit(""))).alias("row"))
    return first.select("row").unionByName(rows.filter("row.doc_id is null")).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix: the files written hold it, in their order and within."""
    ordered = mixed(docs, carry=True).repartitionByRange("slot", "block_offset").sortWithinPartitions("slot", "block_offset")
    return ordered.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. Groups are runs of the mix (file and row order), so sequences follow it.

    Documents that don't come from files are dealt to groups by hash."""
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select(docs["doc_id"], docs["text"], meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    except AnalysisException:
        return packed(docs)
    part = F.coalesce(F.regexp_extract("_file", r"part-(\d{1,6})", 1).try_cast("long"), F.pmod(F.xxhash64("_file"), F.lit(1 << 17)))
    return packed(placed, group=(part % (1 << 17)) * (1 << 20) + F.expr(f"_row div {GROUP_DOCS}"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash dedup", minhash_dedup),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: SQL can express neither the network nor patience diff: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
