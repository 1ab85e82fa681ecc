"""Queries: sources and sinks over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import paged
from ..sources import store as S
from ..sources.scratch import scratch
from ..streaming.streams import drained
from .core import Tables, query


@query("s01_seed_scan", "SELECT DISTINCT lang AS seed, source AS title FROM documents")
def s01(t: Tables) -> DataFrame:
    # The seeds are the languages; each one's list of titles is paged, and names a title once for every document.
    rows = t.documents.select("lang", F.col("source").alias("title"), "doc_id")
    path = paged.answers(rows, scratch(t.spark, "titles"), ["doc_id"], seed="lang", page_rows=100)
    return paged.titles(t.spark, path, paged.seed_names(rows, "lang")).distinct()


@query("s02_table_scan", "SELECT p_partkey, p_name FROM part")
def s02(t: Tables) -> DataFrame:
    return S.scan(t.spark, t.folder, "part", ["p_partkey", "p_name"])


@query("s03_content", "SELECT i.doc_id, d.lang FROM (SELECT doc_id * 3 AS doc_id FROM documents) i LEFT JOIN documents d USING (doc_id)")
def s03(t: Tables) -> DataFrame:
    titles = t.documents.select((F.col("doc_id") * 3).alias("doc_id"))
    return S.content(titles, t.documents.select("doc_id", "lang"), "doc_id")


# Newest first, back to the watermark: a title is named once; more titles than the limit make the feed incomplete.
FEED = """entry AS (SELECT id AS rcid, author::VARCHAR AS title FROM message),
fresh AS (SELECT *, (rcid = max(rcid) OVER (PARTITION BY title))::INT AS first FROM entry WHERE rcid > {watermark}),
named AS (SELECT *, sum(first) OVER (ORDER BY rcid DESC) AS n FROM fresh)
SELECT title, rcid, (SELECT max(rcid) FROM entry)::BIGINT AS watermark, (SELECT max(n) <= {limit} FROM named) AND EXISTS (SELECT 1 FROM entry WHERE rcid <= {watermark}) AS complete FROM named WHERE first = 1 AND n <= {limit} + 1"""


def feed_of(t: Tables) -> str:
    """The messages as a feed of changed authors, newest first; its answers' folder."""
    return paged.answers(t.message.select(F.col("id").alias("rcid"), F.col("author").cast("string").alias("title")), scratch(t.spark, "feed"), [F.desc("rcid")])


@query("s04_change_feed", "WITH " + FEED.format(watermark=500, limit=5000))
def s04(t: Tables) -> DataFrame:
    return paged.changes(t.spark, feed_of(t), 500)


@query("s04_change_stream", "WITH " + FEED.format(watermark=500, limit=5000))
def s04_stream(t: Tables) -> DataFrame:
    return drained(paged.changes(t.spark, feed_of(t), 500, stream=True), "changes")


@query("s05_links", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS links FROM part GROUP BY 1")
def s05(t: Tables) -> DataFrame:
    return S.links(t.part, "p_brand", "p_type").select("p_brand", F.array_join("links", ",").alias("links"))


@query("s06_upsert", "SELECT author, max(id) AS id FROM message GROUP BY author")
def s06(t: Tables) -> DataFrame:
    held, fresh = t.message.filter("id % 2 = 0").select("author", "id"), t.message.filter("id % 2 = 1").select("author", "id")
    return S.upsert(held, fresh, ["author"], "id")


@query("s07_insert_or_ignore", "SELECT 'stored' AS part, count(*) AS n FROM (SELECT DISTINCT author, kind FROM message WHERE id >= 200 EXCEPT SELECT author, kind FROM message WHERE id < 200) UNION ALL SELECT 'ignored', (SELECT count(*) FROM message WHERE id >= 200) - (SELECT count(*) FROM (SELECT DISTINCT author, kind FROM message WHERE id >= 200 EXCEPT SELECT author, kind FROM message WHERE id < 200))")
def s07(t: Tables) -> DataFrame:
    stored, ignored = S.insert_or_ignore(t.message.filter("id < 200"), t.message.filter("id >= 200"), ["author", "kind"], ["id"])
    tally = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return tally(stored, "stored").unionByName(tally(ignored, "ignored"))


@query("s08_snapshot_delete", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS records FROM customer WHERE c_custkey % 10 = 0")
def s08(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_custkey % 10 = 0").select("c_custkey")
    records = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    removed = S.drop_with_snapshot(t.customer, gone, records, "c_custkey")[1]
    return removed.select("c_custkey", F.coalesce(F.json_array_length("records"), F.lit(0)).cast("long").alias("records"))


@query("s10_seed_replace", "SELECT DISTINCT source AS title FROM documents WHERE lang = 'de' AND source NOT IN (SELECT source FROM documents WHERE lang = 'en' AND doc_id % 2 = 0)")
def s10(t: Tables) -> DataFrame:
    held = t.documents.filter("lang = 'de'").select(F.lit("de").alias("seed"), F.col("source").alias("title"))
    fresh = t.documents.filter("lang = 'en' and doc_id % 2 = 0").select(F.lit("en").alias("seed"), F.col("source").alias("title"))
    return S.replaced_seeds(held, fresh, [])[1]


@query("s13_manifest", "SELECT 'units' AS key, count(*)::VARCHAR AS value FROM documents UNION ALL SELECT 'format_version', '1'")
def s13(t: Tables) -> DataFrame:
    made = t.units.agg(F.count("*").cast("string").alias("value")).select(F.lit("units").alias("key"), "value")
    return made.unionByName(t.spark.createDataFrame([("format_version", "1")], "key string, value string"))


@query("s17_blobs", "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id < 20))")
def s17(t: Tables) -> DataFrame:
    held = t.documents.filter("doc_id < 20").select(F.sha2("text", 256).alias("key"))
    return S.blob_usage(S.put_blobs(held, t.documents, "text"))


@query("s19_measure", "SELECT 'orders' AS measure, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'nothing', '?'")
def s19(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("quillspark_orders")
    rows = [("orders", S.measure(t.spark, "select count(*) from quillspark_orders")), ("nothing", S.measure(t.spark, "select count(*) from no_such_view"))]
    return t.spark.createDataFrame(rows, "measure string, value string")


@query("s09_partition_overwrite", "SELECT kind, count(*) AS n FROM message WHERE id % 2 = 0 OR kind = 'view' GROUP BY kind")
def s09(t: Tables) -> DataFrame:
    path = scratch(t.spark, "partitions")
    rows = t.message.select("id", "kind")
    S.replace_partitions(rows.filter("id % 2 = 0"), path, "kind")
    S.replace_partitions(rows.filter("kind = 'view'"), path, "kind")  # the other kinds stay
    return R.grouped_counts(t.spark.read.parquet(path), "kind")


def _corpus(t: Tables) -> str:
    path = scratch(t.spark, "corpus")
    S.write_corpus({"units": t.units, "attribution": t.attribution}, path, {"format_version": 1, "requires": ["bm25"]})
    return path


@query("s11_corpus_swap", "SELECT 2::BIGINT AS versions, (SELECT count(*) FROM units WHERE template = 'en') AS units")
def s11(t: Tables) -> DataFrame:
    path = _corpus(t)
    S.write_corpus({"units": t.units.filter("template = 'en'")}, path, {"format_version": 1})
    _, version = S.read_corpus(t.spark, path)
    return t.spark.read.parquet(f"{version}/units").agg(F.lit(int(version[-6:])).cast("long").alias("versions"), F.count("*").alias("units"))


@query("s12_corpus_tables", "SELECT ord, page, chars FROM units")
def s12(t: Tables) -> DataFrame:
    _, version = S.read_corpus(t.spark, _corpus(t))
    return t.spark.read.parquet(f"{version}/units").select("ord", "page", "chars")


@query("s14_capabilities", "SELECT 'ok' AS corpus, true AS opens UNION ALL SELECT 'unknown', false")
def s14(t: Tables) -> DataFrame:
    def opens(manifest: dict) -> bool:
        rows = t.spark.createDataFrame([(k, json.dumps(v)) for k, v in manifest.items()], "key string, value string")
        try:
            return bool(S.read_manifest(rows))
        except ValueError:
            return False

    return t.spark.createDataFrame([("ok", opens({"format_version": 1, "requires": ["bm25"]})), ("unknown", opens({"format_version": 1, "requires": ["dense"]}))], "corpus string, opens boolean")


@query("s15_suite_lines", "SELECT item_id AS qid, text FROM benchmark")
def s15(t: Tables) -> DataFrame:
    path = scratch(t.spark, "suite")
    S.write_suite(t.benchmark.select(F.col("item_id").alias("qid"), "text"), path)
    return S.read_suite(t.spark, path, "qid long, text string")


@query("s16_attached", "SELECT count(*) AS n, false AS has_raw FROM part")
def s16(t: Tables) -> DataFrame:
    main, raw = S.attached(t.spark, f"{t.folder}/part.parquet", f"{t.folder}/no_such_cache.parquet")
    return main.agg(F.count("*").alias("n")).withColumn("has_raw", F.lit(raw is not None))


@query("s18_report", "SELECT '| ' || kind || ' | ' || count(*) || ' |' AS line FROM message GROUP BY kind")
def s18(t: Tables) -> DataFrame:
    text = S.markdown(R.grouped_counts(t.message, "kind"))
    return t.spark.createDataFrame([(x,) for x in text.splitlines()[2:]], "line string")
