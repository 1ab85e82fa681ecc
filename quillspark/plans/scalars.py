"""Queries: text and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import relational as R
from ..sources.scratch import spread
from .core import Tables, query

STOPWORDS = ["the", "and", "of", "de", "la", "der", "die", "und"]
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _joined(c):
    return F.md5(F.array_join(c, " "))


@query("r01_tokens", f"SELECT ord, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS tokens FROM units")
def r01(t: Tables) -> DataFrame:
    own = t.units.select("ord", X.tokens(F.col("text")).alias("v"))
    return own.select("ord", F.size("v").cast("long").alias("n"), _joined("v").alias("tokens"))


@query("r02_bigram_tokens", f"SELECT scene, seq, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS tokens FROM lines")
def r02(t: Tables) -> DataFrame:
    # The driver's texts are Latin, where bigram tokens are whole words; the CJK branch has its own tests.
    own = t.lines.select("scene", "seq", X.bigram_tokens(F.col("text")).alias("v"))
    return own.select("scene", "seq", F.size("v").cast("long").alias("n"), _joined("v").alias("tokens"))


_KEPT = f"list_filter({TOKENS}, lambda x: NOT list_contains({STOPWORDS}, x))"


@query("r04_query_tokens", f"SELECT item_id, array_to_string(CASE WHEN len({_KEPT}) = 0 THEN {TOKENS} ELSE {_KEPT} END, ' ') AS tokens FROM benchmark")
def r04(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(X.query_tokens(F.col("text"), STOPWORDS), " ").alias("tokens"))


@query("r05_match_terms", f"SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2")
def r05(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


@query(
    "f01_entropy",
    """WITH s AS (SELECT shape, ms // 86400000 AS day, sum(points) / 10000.0 AS v FROM meter GROUP BY 1, 2), w AS (SELECT shape, exp(v - max(v) OVER (PARTITION BY shape)) AS w FROM s),
    p AS (SELECT shape, w / sum(w) OVER (PARTITION BY shape) AS p FROM w) SELECT shape, round(CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) END, 6)::DOUBLE AS entropy FROM p GROUP BY shape""",
)
def f01(t: Tables) -> DataFrame:
    days = t.meter.groupBy("shape", F.expr("ms div 86400000").alias("day")).agg((F.sum("points") / 10000.0).alias("v"))
    return days.groupBy("shape").agg(F.array_sort(F.collect_list("v")).alias("v")).select("shape", F.round(S.softmax_entropy(F.col("v")), 6).alias("entropy"))


@query("f02_gain_discount", "SELECT doc_id, round((pow(2, quality + toxic) - 1) / log2(doc_id % 10 + 2), 6)::DOUBLE AS g FROM labels")
def f02(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.round(S.gain(F.col("quality") + F.col("toxic")) / S.discount(F.col("doc_id") % 10), 6).alias("g"))


@query("f03_token_estimate", "SELECT ord, ceil(length(text) / 4.0)::BIGINT AS tokens FROM units")
def f03(t: Tables) -> DataFrame:
    return t.units.select("ord", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("f04_points", "SELECT id, round(uncached + 0.25 * cached + 4 * output, 6)::DOUBLE AS points FROM meter")
def f04(t: Tables) -> DataFrame:
    return t.meter.select("id", F.round(S.points(F.col("uncached"), F.col("cached"), F.col("output")).cast("double"), 6).alias("points"))


@query("f05_tone", "SELECT doc_id, CASE WHEN doc_id % 200 >= 150 THEN 'deep' WHEN doc_id % 200 >= 100 THEN 'close' WHEN doc_id % 200 >= 60 THEN 'normal' ELSE 'guarded' END AS tone FROM documents")
def f05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.tone(F.col("doc_id") % 200).alias("tone"))


@query("f06_civil", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS days, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def f06(t: Tables) -> DataFrame:
    days = S.civil_days(F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", days.alias("days"), S.civil(days).cast("string").alias("day"))


@query("f07_times", "SELECT id, lpad((id % 30)::VARCHAR, 2, '0') || ':' || lpad((id % 60)::VARCHAR, 2, '0') AS hhmm, id % 30 * 60 + id % 60 AS minute FROM message WHERE id % 30 < 24")
def f07(t: Tables) -> DataFrame:
    raw = F.concat((F.col("id") % 30).cast("string"), F.lit(":"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"))
    made = t.message.select("id", S.hhmm(raw).alias("hhmm"), S.minute_of(raw).cast("long").alias("minute"))
    return made.filter("hhmm is not null")


@query("f08_in_world", "SELECT id, lpad((year(d) - 1000)::VARCHAR, 4, '0') || strftime(d, '-%m-%d') AS day FROM (SELECT id, make_timestamp((ms + 7200000) * 1000) AS d FROM message)")
def f08(t: Tables) -> DataFrame:
    return t.message.select("id", S.in_world_date(F.col("ms"), 1000, 120).alias("day"))


@query("f09_day_month", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS md FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 > 0")
def f09(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, day).otherwise(F.lit("13-40"))
    return t.orders.select("o_orderkey", S.day_month(raw).alias("md"))


@query("f10_trim_punctuation", r"SELECT scene, seq, md5(regexp_replace(text, '^[\p{P}\p{Z}\p{S}]+|[\p{P}\p{Z}\p{S}]+$', '', 'g')) AS h FROM lines")
def f10(t: Tables) -> DataFrame:
    return t.lines.select("scene", "seq", F.md5(X.trimmed_punctuation(F.col("text"))).alias("h"))


@query("f11_citations", "SELECT id, 'u' || author || ',c' || channel AS ids, 'says ' || kind AS text FROM message")
def f11(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("says "), "kind", F.lit(" [#u"), "author", F.lit(", #c"), "channel", F.lit("]"))
    return t.message.select("id", F.array_join(X.citation_ids(raw), ",").alias("ids"), X.without_citations(raw).alias("text"))


@query("f12_leak_cut", "SELECT id, CASE WHEN channel < 5 THEN 'hello ' || kind || chr(10) ELSE 'hello ' || kind || chr(10) || 'as ever' END AS text FROM message")
def f12(t: Tables) -> DataFrame:
    tail = F.when(F.col("channel") < 5, F.concat(F.lit("Turn "), "channel", F.lit(" of "), "kind", F.lit("\nmore"))).otherwise(F.lit("as ever"))
    return t.message.select("id", X.cut_at_leak(F.concat(F.lit("hello "), "kind", F.lit("\n"), tail), ["Turn {n} of {word}"]).alias("text"))


@query("f13_reply_guard", "SELECT id, CASE channel WHEN 0 THEN 'empty' WHEN 1 THEN 'json' WHEN 2 THEN 'tool call' WHEN 3 THEN 'boilerplate' WHEN 4 THEN 'wrap-up json' ELSE 'fine' END AS verdict FROM message")
def f13(t: Tables) -> DataFrame:
    raw = F.when(F.col("channel") == 0, " ... ").when(F.col("channel") == 1, F.col("props")).when(F.col("channel") == 2, 'I call search("x") now').when(F.col("channel") == 3, "As an AI  model, no").when(
        F.col("channel") == 4, 'so "facts": 1, "summary": 2'
    ).otherwise(F.concat(F.lit("said "), "kind"))
    return t.message.select("id", X.reply_verdict(raw, ["search"], ["as an ai model"], [], []).alias("verdict"))


@query("f14_clip", r"SELECT ord, md5(left(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 80)) AS h FROM units")
def f14(t: Tables) -> DataFrame:
    return t.units.select("ord", F.md5(X.clipped(F.col("text"), 80)).alias("h"))


@query("f15_reword", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^small ') THEN regexp_replace(p_name, '^small ', 'little ') WHEN regexp_matches(p_name, 'ring$') THEN regexp_replace(p_name, 'ring$', 'band') ELSE p_name END AS name FROM part")
def f15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.reworded(F.col("p_name"), [("^small ", "little "), ("ring$", "band")]).alias("name"))


@query("f16_crumbs", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN p_type ELSE p_type || ' > ' || p_brand END AS path FROM part")
def f16(t: Tables) -> DataFrame:
    path = F.array("p_type", "p_type", "p_brand", "p_brand")
    return t.part.select("p_partkey", F.array_join(X.crumbs(path, ["Brand#2"]), " > ").alias("path"))


@query("f17_repeated_segment", "SELECT p_partkey, len(list_distinct([p_type, p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) < 4 AS repeats FROM part")
def f17(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", X.repeats_a_segment(F.array(F.col("p_type"), F.col("p_brand"), F.get(words, F.lit(0)), F.get(words, F.lit(1)))).alias("repeats"))


@query("f18_page_url", "SELECT p_partkey, 'https://wiki.example/' || replace(p_name, ' ', '_') || '?v=1' AS url FROM part")
def f18(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.page_url("https://wiki.example/{page}?v=1", F.col("p_name")).alias("url"))


@query("f19_shape", "SELECT ord, CASE template WHEN 'en' THEN 'lore' WHEN 'fr' THEN 'dialogue' ELSE template END AS shape FROM units")
def f19(t: Tables) -> DataFrame:
    return t.units.select("ord", X.shape_of(F.col("template"), {"en": "lore", "fr": "dialogue"}).alias("shape"))


@query("f20_touches", "SELECT a.span_of, a.lo, a.hi, b.lo AS lo2, b.hi AS hi2 FROM ranges a JOIN ranges b ON a.span_of = b.span_of AND a.hi + 1 = b.lo")
def f20(t: Tables) -> DataFrame:
    b = t.ranges.toDF("s2", "lo2", "hi2")
    near = S.touches(F.col("span_of"), F.col("lo"), F.col("hi"), F.col("s2"), F.col("lo2"), F.col("hi2"))
    return t.ranges.join(b, near & (F.col("span_of") == F.col("s2"))).filter("lo < lo2").select("span_of", "lo", "hi", "lo2", "hi2")


@query("f21_json", "SELECT id, json_extract_string(props, '$.k')::BIGINT AS k, json_valid(props) AS valid FROM message")
def f21(t: Tables) -> DataFrame:
    return t.message.select("id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("f22_speaker_lines", "SELECT doc_id, count(*) AS spoken FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[^:\\n]{1,40}: .+$') GROUP BY 1")
def f22(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.explode(X.speaker_lines(F.col("text"))).alias("s"))
    return own.groupBy("doc_id").agg(F.count("*").alias("spoken"))


@query("t08_day_bucket", "SELECT strftime(make_timestamp((ms + 7200000) * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM message GROUP BY 1")
def t08(t: Tables) -> DataFrame:
    return t.message.groupBy(S.local_date(F.col("ms"), 120).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("t10_quiet_hours", "SELECT id, (m >= 1380 OR m < 420) AS quiet FROM (SELECT id, ms // 60000 % 1440 AS m FROM message)")
def t10(t: Tables) -> DataFrame:
    return t.message.select("id", S.in_quiet_hours(S.local_minute(F.col("ms")), 1380, 420).alias("quiet"))


@query("t11_cooldown", "SELECT id, coalesce(ms - lag(ms) OVER (PARTITION BY author ORDER BY ms, id) < 1800000, false) AS too_soon FROM message")
def t11(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    last = F.lag("ms").over(Window.partitionBy("author").orderBy("ms", "id"))
    return t.message.withColumn("last", last).select("id", S.too_soon(F.col("last"), F.col("ms"), 30).alias("too_soon"))


@query(
    "v04_duplicate_texts",
    r"SELECT min(doc_id) AS first, count(*) AS n FROM (SELECT doc_id, lang, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS plain FROM documents) GROUP BY lang, plain HAVING count(*) > 1",
)
def v04(t: Tables) -> DataFrame:
    plain = t.documents.select("doc_id", "lang", F.sha2(X.normalised(F.col("text")), 256).alias("plain"))
    return plain.groupBy("lang", "plain").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first", "n")


_BIGRAMS = r"list_distinct(list_transform(range(length({0}) - 1), lambda i: substr({0}, i + 1, 2)))"


@query(
    "v05_similarity",
    "SELECT a, b, (100 * len(list_intersect(x, y)) // greatest(len(list_distinct(list_concat(x, y))), 1))::BIGINT AS similar FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, "
    + _BIGRAMS.format("replace(a.p_name, ' ', '')")
    + " AS x, "
    + _BIGRAMS.format("replace(b.p_name, ' ', '')")
    + " AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)",
)
def v05(t: Tables) -> DataFrame:
    return R.similar_pairs(spread(t.part), "p_brand", "p_name", "p_partkey", plain=lambda x: F.replace(x, F.lit(" "), F.lit("")))


@query("c11_signature", "SELECT p_partkey, left(sha256(p_name || chr(31) || p_brand), 16) AS sig FROM part")
def c11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.signature(F.col("p_name"), F.col("p_brand")).alias("sig"))
