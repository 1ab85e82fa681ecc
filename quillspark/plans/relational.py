"""Queries: filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .core import Tables, query

# ---- P: filters ------------------------------------------------------------------------------------


@query("p01_in_filters", "SELECT ord, page, chars FROM units WHERE template IN ('en', 'fr') AND page IN ('src1', 'src2', 'src3')")
def p01(t: Tables) -> DataFrame:
    return R.in_filters(t.units, template=["en", "fr"], page=["src1", "src2", "src3"], id=[]).select("ord", "page", "chars")


@query("p02_point_lookup", "SELECT ord, id, page, chars FROM units WHERE id = 'u7'")
def p02(t: Tables) -> DataFrame:
    return t.units.filter(F.col("id") == "u7").select("ord", "id", "page", "chars")


@query("p03_multi_get", "SELECT w.pos, u.ord, u.page FROM (VALUES (0, 42::BIGINT), (1, 7), (2, 10000000000), (3, 19)) w(pos, ord) JOIN units u ON u.ord = w.ord")
def p03(t: Tables) -> DataFrame:
    return R.multi_get(t.units, "ord", [42, 7, 10_000_000_000, 19]).orderBy("pos").select("pos", "ord", "page")


@query("p04_half_open", "SELECT id, ms, points FROM meter WHERE ms > 1704412800000 AND ms <= 1705017600000")
def p04(t: Tables) -> DataFrame:
    return R.half_open(t.meter, "ms", 1704412800000, 1705017600000).select("id", "ms", "points")


@query("p05_page_before", "SELECT id, author FROM (SELECT * FROM message WHERE channel = 3 AND id < 800 ORDER BY id DESC LIMIT 25)")
def p05(t: Tables) -> DataFrame:
    return R.page_before(t.message.filter("channel = 3"), "id", 800, 25).select("id", "author")


@query("p06_all_terms", "SELECT scene, seq FROM lines WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND speaker IN (SELECT DISTINCT speaker FROM lines WHERE speaker <> 'system')")
def p06(t: Tables) -> DataFrame:
    live = t.lines.filter("speaker <> 'system'").select("speaker").distinct()
    return R.keep_matching(t.lines.filter(R.has_all_terms(F.col("text"), ["The", "and"])), live, "speaker").select("scene", "seq")


@query("p07_whole_word", "SELECT ord FROM units WHERE regexp_matches(text, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)')")
def p07(t: Tables) -> DataFrame:
    return t.units.filter(R.has_whole_word(F.col("text"), "the")).select("ord")


@query("p08_any_part", "SELECT scene, seq FROM lines WHERE instr(text, 'the ') > 0 OR instr(text, 'and ') > 0")
def p08(t: Tables) -> DataFrame:
    return t.lines.filter(R.has_any_part(F.col("text"), ["the ", "and "])).select("scene", "seq")


@query("p09_not_suffix", "SELECT ord FROM units WHERE page NOT LIKE '%1'")
def p09(t: Tables) -> DataFrame:
    return t.units.filter(~F.col("page").endswith("1")).select("ord")


@query("p10_null_safe", "SELECT a.person, count(b.person) AS twins, min(b.person) AS first FROM (SELECT person, nullif(region, 2) AS r FROM persons) a JOIN (SELECT person, nullif(region, 2) AS r FROM persons) b ON a.r IS NOT DISTINCT FROM b.r GROUP BY 1")
def p10(t: Tables) -> DataFrame:
    # One row a person: what shares its region, null with null, is counted before the join.
    a = t.persons.select("person", F.nullif("region", F.lit(2)).alias("r"))
    sizes = a.groupBy(F.col("r").alias("r2")).agg(F.count("*").alias("twins"), F.min("person").alias("first"))
    return a.join(sizes, F.col("r").eqNullSafe(F.col("r2"))).select("person", "twins", "first")


@query("p11_length_between", "SELECT p_partkey, p_name FROM part WHERE length(p_name) BETWEEN 4 AND 24")
def p11(t: Tables) -> DataFrame:
    return t.part.filter(F.length("p_name").between(4, 24)).select("p_partkey", "p_name")


@query(
    "p12_checks",
    """SELECT 'kind' AS rule, sum((kind NOT IN ('view', 'click', 'purchase'))::INT)::BIGINT AS violations FROM message
    UNION ALL SELECT 'channel', sum((NOT channel < 9)::INT)::BIGINT FROM message
    UNION ALL SELECT 'props', sum((NOT props LIKE '{%')::INT)::BIGINT FROM message""",
)
def p12(t: Tables) -> DataFrame:
    return R.violations(t.message, {"kind": F.col("kind").isin("view", "click", "purchase"), "channel": F.col("channel") < 9, "props": F.col("props").startswith("{")})


@query("p13_scope", "SELECT id, kind, author FROM message WHERE kind IN ('error', 'signup') AND author IN (SELECT author FROM message WHERE kind = 'purchase')")
def p13(t: Tables) -> DataFrame:
    reach = t.message.filter("kind = 'purchase'").select("author").distinct()
    return R.keep_matching(R.in_filters(t.message, kind=["error", "signup"]), reach, "author").select("id", "kind", "author")


# ---- J: joins --------------------------------------------------------------------------------------


@query("j01_hits_to_units", "SELECT l_orderkey AS hit, id, page FROM lineitem JOIN units ON ord = l_orderkey WHERE l_linenumber = 1")
def j01(t: Tables) -> DataFrame:
    hits = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("hit"))
    return hits.join(t.units, F.col("ord") == F.col("hit")).select("hit", "id", "page")


@query("j02_three_way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j02(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("j03_semi", "SELECT unit FROM (SELECT DISTINCT unit FROM attribution) u WHERE EXISTS (SELECT 1 FROM attribution a WHERE a.unit = u.unit AND a.person IN (1, 2, 3))")
def j03(t: Tables) -> DataFrame:
    return R.keep_matching(t.attribution.select("unit").distinct(), R.in_filters(t.attribution, person=[1, 2, 3]), "unit")


@query("j04_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j04(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.drop_matching(t.customer, done, "c_custkey").select("c_custkey", "c_name")


@query("j05_semi_list", "SELECT id, author FROM message WHERE author IN (SELECT unnest(json_extract('[3, 5, 8]', '$[*]')::BIGINT[]))")
def j05(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame([("[3, 5, 8]",)], "j string").select(F.explode(F.from_json("j", "array<bigint>")).alias("author"))
    return R.keep_matching(t.message, F.broadcast(listed), "author").select("id", "author")


@query("j06_exclude", "SELECT person, count(*) AS units FROM attribution WHERE person NOT IN (2, 4, 6) GROUP BY person")
def j06(t: Tables) -> DataFrame:
    out = t.spark.createDataFrame([(2,), (4,), (6,)], "person long")
    return R.drop_matching(t.attribution, F.broadcast(out), "person").groupBy("person").agg(F.count("*").alias("units"))


@query("j07_left_group", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def j07(t: Tables) -> DataFrame:
    both = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("j08_lookup_default", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def j08(t: Tables) -> DataFrame:
    return R.with_default(t.documents.select("doc_id"), t.labels, "doc_id", "quality", -1)


@query("j09_scalar_subquery", "SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM attribution x WHERE x.unit = l_orderkey) AS attributed FROM lineitem WHERE l_quantity >= 45")
def j09(t: Tables) -> DataFrame:
    counts = t.attribution.groupBy(F.col("unit").alias("l_orderkey")).agg(F.count("*").alias("attributed"))
    hits = t.lineitem.filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.with_default(hits, counts, "l_orderkey", "attributed", 0)


@query("j10_newest_first", "SELECT channel, newest, row_number() OVER (ORDER BY newest DESC NULLS LAST, channel) AS place FROM (SELECT c.channel, max(m.ms) AS newest FROM range(12) c(channel) LEFT JOIN message m USING (channel) GROUP BY c.channel)")
def j10(t: Tables) -> DataFrame:
    newest = t.message.groupBy("channel").agg(F.max("ms").alias("newest"))
    listed = t.spark.range(12).withColumnRenamed("id", "channel").join(newest, "channel", "left")
    return listed.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("newest"), "channel")).cast("long"))


@query(
    "j11_neighbours",
    "SELECT h.span_of, h.lo AS hit_lo, h.hi AS hit_hi, r.lo, r.hi FROM ranges h JOIN ranges r ON r.span_of = h.span_of AND r.lo <= h.hi + 1 AND r.hi >= h.lo - 1 WHERE h.lo = 2 AND NOT (r.lo = h.lo AND r.hi = h.hi)",
)
def j11(t: Tables) -> DataFrame:
    return R.overlapping(t.ranges.filter("lo = 2"), t.ranges, "span_of", "lo", "hi", 1, 1).select("span_of", "hit_lo", "hit_hi", "lo", "hi")


@query(
    "j12_best_overlap",
    "SELECT span_of, a, b, lo, hi, overlap FROM (SELECT *, row_number() OVER (PARTITION BY span_of, a, b ORDER BY overlap DESC, lo, hi) AS rn FROM (SELECT q.span_of, q.a, q.b, r.lo, r.hi, least(r.hi, q.b) - greatest(r.lo, q.a) + 1 AS overlap FROM (SELECT DISTINCT span_of, 2::BIGINT AS a, 4::BIGINT AS b FROM ranges) q JOIN ranges r ON r.span_of = q.span_of AND r.lo <= q.b AND r.hi >= q.a)) WHERE rn = 1",
)
def j12(t: Tables) -> DataFrame:
    asked = t.ranges.select("span_of", F.lit(2).cast("long").alias("a"), F.lit(4).cast("long").alias("b")).distinct()
    return R.best_overlap(asked, t.ranges, "span_of", "lo", "hi", ["lo", "hi"]).select("span_of", "a", "b", "lo", "hi", "overlap")


@query("j13_pairs", "SELECT x.person AS a, y.person AS b, count(*) AS n FROM attribution x JOIN attribution y ON x.unit = y.unit AND x.person < y.person GROUP BY 1, 2")
def j13(t: Tables) -> DataFrame:
    return R.unordered_pairs(t.attribution, "unit", "person")


@query("j14_band", "SELECT DISTINCT l.scene, l.seq FROM lines l WHERE EXISTS (SELECT 1 FROM lines c WHERE c.scene = l.scene AND c.speaker = 'system' AND abs(c.seq - l.seq) <= 2)")
def j14(t: Tables) -> DataFrame:
    return R.within_band(t.lines, t.lines.filter("speaker = 'system'"), "scene", "seq", 2).select("scene", "seq").distinct()


@query("j15_next_row", "SELECT a.scene, a.seq, a.speaker, b.speaker AS next_speaker FROM lines a LEFT JOIN lines b ON b.scene = a.scene AND b.seq = a.seq + 1")
def j15(t: Tables) -> DataFrame:
    return R.with_next(t.lines, ["scene"], "seq", "speaker", "next_speaker").select("scene", "seq", "speaker", "next_speaker")


@query("j16_alias_targets", "SELECT DISTINCT p_brand AS alias, l_suppkey AS target FROM part JOIN lineitem ON l_partkey = p_partkey JOIN persons ON person = l_suppkey")
def j16(t: Tables) -> DataFrame:
    aliases = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("alias"), F.col("l_suppkey").alias("target")).distinct()
    return R.keep_matching(aliases, t.persons.select(F.col("person").alias("target")), "target")


@query("j17_align", "SELECT a.channel, a.n AS before, b.n AS after FROM (SELECT channel, count(*) AS n FROM message WHERE id % 2 = 0 GROUP BY 1) a JOIN (SELECT channel, count(*) AS n FROM message WHERE id % 2 = 1 GROUP BY 1) b USING (channel)")
def j17(t: Tables) -> DataFrame:
    run = lambda odd, name: t.message.filter(F.col("id") % 2 == odd).groupBy("channel").agg(F.count("*").alias(name))
    return run(0, "before").join(run(1, "after"), "channel")


@query("j18_same_set", "SELECT unit FROM attribution GROUP BY unit HAVING list_sort(list(DISTINCT person)) = [1, 2]")
def j18(t: Tables) -> DataFrame:
    return R.same_members(t.attribution, "unit", "person", [2, 1, 2])


@query("j19_division", "SELECT kind, day FROM (SELECT DISTINCT kind, ms // 86400000 AS day, channel FROM message WHERE channel IN (0, 1, 2)) GROUP BY kind, day HAVING count(DISTINCT channel) = 3")
def j19(t: Tables) -> DataFrame:
    seen = t.message.withColumn("item", F.struct("kind", F.expr("ms div 86400000").alias("day")))
    viewers = t.spark.createDataFrame([(0,), (1,), (2,)], "channel long")
    return R.seen_by_all(seen, "item", "channel", viewers).select("item.kind", "item.day")


@query("j20_contained", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def j20(t: Tables) -> DataFrame:
    # Containment of whole passages: both sides are keyed by a rare window of the passage first.
    from ..operators.contain import contained_in

    return contained_in(t.benchmark, "item_id", "text", t.dealt_documents, "doc_id", "text")


# ---- A: aggregates ---------------------------------------------------------------------------------


@query("a01_group_count", "SELECT e.kind, count(m.id) AS n FROM (SELECT unnest(['view', 'click', 'never']) AS kind) e LEFT JOIN message m USING (kind) GROUP BY 1")
def a01(t: Tables) -> DataFrame:
    return R.counts_for_all(t.message, "kind", t.spark.createDataFrame([("view",), ("click",), ("never",)], "kind string"))


@query("a02_group_sum", "SELECT person, sum(chars)::BIGINT AS material FROM attribution JOIN units ON ord = unit WHERE template <> 'de' GROUP BY person")
def a02(t: Tables) -> DataFrame:
    return t.attribution.join(t.units.filter("template <> 'de'"), F.col("ord") == F.col("unit")).groupBy("person").agg(F.sum("chars").alias("material"))


@query("a03_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS persons FROM lineitem GROUP BY 1")
def a03(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("persons"))


@query("a04_group_max", "SELECT author, max(ms) AS newest, min(ms) AS oldest FROM message GROUP BY author")
def a04(t: Tables) -> DataFrame:
    return t.message.groupBy("author").agg(F.max("ms").alias("newest"), F.min("ms").alias("oldest"))


@query("a05_by_shape", "SELECT shape, count(*) AS calls, sum(uncached)::BIGINT AS uncached, sum(cached)::BIGINT AS cached, sum(output)::BIGINT AS output, sum(points)::BIGINT AS points FROM meter WHERE ms > 1704412800000 AND ms <= 1705622400000 GROUP BY shape")
def a05(t: Tables) -> DataFrame:
    held = R.half_open(t.meter, "ms", 1704412800000, 1705622400000)
    return held.groupBy("shape").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("uncached", "cached", "output", "points")])


@query("a06_conditional_sum", "SELECT shape, round(sum(CASE WHEN requests > 0 THEN 1 ELSE points / 3000.0 END), 6)::DOUBLE AS spent FROM meter GROUP BY shape")
def a06(t: Tables) -> DataFrame:
    spent = F.when(F.col("requests") > 0, F.lit(1.0)).otherwise(F.col("points") / 3000.0)
    return t.meter.groupBy("shape").agg(F.round(F.sum(spent), 6).alias("spent"))


@query("a07_ratio", "SELECT shape, round(CASE WHEN sum(cached + uncached) > 0 THEN sum(cached) / sum(cached + uncached) END, 6)::DOUBLE AS hit FROM meter GROUP BY shape")
def a07(t: Tables) -> DataFrame:
    return t.meter.groupBy("shape").agg(F.round(F.try_divide(F.sum("cached"), F.sum(F.col("cached") + F.col("uncached"))), 6).alias("hit"))


@query("a08_having", "SELECT person, count(*) AS units FROM attribution GROUP BY person HAVING count(*) >= 100")
def a08(t: Tables) -> DataFrame:
    return t.attribution.groupBy("person").agg(F.count("*").alias("units")).filter("units >= 100")


_SORTED = "SELECT template, list_sort(list(chars)) AS v FROM units GROUP BY template"


@query("a09_floor_percentile", f"SELECT template, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95 FROM ({_SORTED})")
def a09(t: Tables) -> DataFrame:
    return R.values_at(t.units, ["template"], "chars", {"p50": R.floor_place(0.5), "p95": R.floor_place(0.95)}).drop("n")


@query("a10_upper_median", f"SELECT template, v[len(v) // 2 + 1] AS median FROM ({_SORTED})")
def a10(t: Tables) -> DataFrame:
    return R.values_at(t.units, ["template"], "chars", {"median": R.upper_place}).drop("n")


@query("a11_nearest_rank", f"SELECT template, v[floor((len(v) - 1) * 0.9 + 0.5)::INT + 1] AS p90 FROM ({_SORTED})")
def a11(t: Tables) -> DataFrame:
    return R.values_at(t.units, ["template"], "chars", {"p90": R.nearest_place(0.9)}).drop("n")


@query("a12_even_quantiles", "SELECT template, i::BIGINT AS i, v[(i * (len(v) - 1)) // 7 + 1] AS cut FROM (SELECT template, list_sort(list(DISTINCT chars)) AS v FROM units GROUP BY template), range(8) r(i) WHERE len(v) > 8")
def a12(t: Tables) -> DataFrame:
    return R.evenly_spaced(t.units, ["template"], "chars", 8)


@query("a13_sorted_list", "SELECT unit, array_to_string(list_sort(list(person)), ',') AS persons FROM attribution GROUP BY unit")
def a13(t: Tables) -> DataFrame:
    return t.attribution.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list("person")), lambda p: p.cast("string")), ",").alias("persons"))


@query("a14_first_wins", "SELECT min(doc_id) AS first, count(*) - 1 AS copies, array_to_string(list_sort(list(doc_id))[2:], ',') AS others FROM documents GROUP BY lang, text")
def a14(t: Tables) -> DataFrame:
    made = R.first_and_copies(t.documents.withColumn("sig", F.sha2("text", 256)), ["lang", "sig"], "doc_id")
    return made.select("first", F.size("copies").cast("long").alias("copies"), F.array_join(F.transform("copies", lambda x: x.cast("string")), ",").alias("others"))


@query("a15_argmax", "SELECT channel, author, n FROM (SELECT channel, author, count(*) AS n, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, author) AS rn FROM message GROUP BY 1, 2) WHERE rn = 1")
def a15(t: Tables) -> DataFrame:
    counts = t.message.groupBy("channel", "author").agg(F.count("*").alias("n"))
    best = counts.groupBy("channel").agg(F.max(F.struct("n", (-F.col("author")).alias("m"))).alias("b"))
    return best.select("channel", (-F.col("b.m")).alias("author"), F.col("b.n").alias("n"))


@query(
    "a16_redundancy",
    "SELECT mode, round(sum(times) / count(*) - 1, 6)::DOUBLE AS redundancy FROM (SELECT span_of % 4 AS mode, span_of, pos, count(*) AS times FROM (SELECT span_of, unnest(range(lo, hi + 1)) AS pos FROM ranges) GROUP BY ALL) GROUP BY mode",
)
def a16(t: Tables) -> DataFrame:
    every = t.ranges.select(F.struct("span_of").alias("span"), (F.col("span_of") % 4).alias("mode"), F.explode(F.sequence("lo", "hi")).alias("pos"))
    counts = every.groupBy("mode", "span", "pos").agg(F.count("*").alias("times"))
    return counts.groupBy("mode").agg(F.round(F.sum("times") / F.count("*") - 1, 6).alias("redundancy"))


@query("a17_gaps", "SELECT span_of, lo, prev_hi FROM (SELECT span_of, lo, hi, lag(hi) OVER (PARTITION BY span_of ORDER BY lo, hi) AS prev_hi FROM ranges) WHERE prev_hi IS NOT NULL AND lo <> prev_hi + 1")
def a17(t: Tables) -> DataFrame:
    return R.gaps(t.ranges, "span_of", "lo", "hi").select("span_of", "lo", "prev_hi")


@query("a18_missing", "SELECT s.span_of, p.pos FROM (SELECT DISTINCT span_of FROM ranges) s, (SELECT unnest(range(1, 9)) AS pos) p WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.span_of = s.span_of AND p.pos BETWEEN r.lo AND r.hi)")
def a18(t: Tables) -> DataFrame:
    points = t.ranges.select("span_of").distinct().withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    return R.uncovered(points, t.ranges, "span_of", "pos", "lo", "hi")


@query("a19_macro", "SELECT round(avg(m), 6)::DOUBLE AS macro FROM (SELECT template, avg(chars) AS m FROM units GROUP BY template)")
def a19(t: Tables) -> DataFrame:
    return R.macro_average(t.units, "template", "chars")


@query("a20_last_instant", "SELECT channel, nullif(greatest(coalesce(max(CASE WHEN kind = 'signup' THEN ms END), 0), coalesce(max(CASE WHEN kind = 'error' THEN ms END), 0)), 0) AS last FROM message GROUP BY channel")
def a20(t: Tables) -> DataFrame:
    newest = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("ms"))), F.lit(0))
    return t.message.groupBy("channel").agg(F.nullif(F.greatest(newest("signup"), newest("error")), F.lit(0)).alias("last"))


@query("a21_residue", "SELECT lower(hit) AS hit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '</?[A-Za-z]+')) AS hit FROM pages) GROUP BY 1")
def a21(t: Tables) -> DataFrame:
    hits = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit("</?[A-Za-z]+"), 0)).alias("hit"))
    return hits.groupBy(F.lower("hit").alias("hit")).agg(F.count("*").alias("n"))


# ---- W: windows ------------------------------------------------------------------------------------


@query("w01_count_over", "SELECT unit, person, count(*) OVER (PARTITION BY person) AS own FROM attribution")
def w01(t: Tables) -> DataFrame:
    return t.attribution.withColumn("own", F.count("*").over(Window.partitionBy("person")))


_SHARED = "SELECT unit, person, count(*) OVER (PARTITION BY unit) AS n FROM attribution"


@query("w02_sum_over", f"SELECT person, max(specific)::BIGINT AS specific FROM (SELECT person, sum((n <= 2)::INT) OVER (PARTITION BY person) AS specific FROM ({_SHARED})) GROUP BY person")
def w02(t: Tables) -> DataFrame:
    shared = t.attribution.withColumn("n", F.count("*").over(Window.partitionBy("unit")))
    return shared.withColumn("specific", F.sum((F.col("n") <= 2).cast("long")).over(Window.partitionBy("person"))).groupBy("person").agg(F.max("specific").alias("specific"))


@query("w03_first_per_partition", "SELECT person, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, unit) AS rn FROM (" + _SHARED + ")) WHERE rn = 1")
def w03(t: Tables) -> DataFrame:
    shared = t.attribution.withColumn("n", F.count("*").over(Window.partitionBy("unit")))
    return R.first_per_group(shared, ["person"], [F.desc("n"), "unit"]).select("person", "unit", "n")


@query("w04_rolling", "SELECT id, sum(points) OVER (ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM meter")
def w04(t: Tables) -> DataFrame:
    return R.rolling_sum(t.meter, "ms", "points", 3_600_000).select("id", "rolling")


@query(
    "w05_release",
    "SELECT shape, min(ms) + 3600000 AS release FROM (SELECT shape, ms, sum(points) OVER (PARTITION BY shape) - sum(points) OVER (PARTITION BY shape ORDER BY ms, id) AS left_ FROM meter) WHERE left_ < 5000 GROUP BY shape",
)
def w05(t: Tables) -> DataFrame:
    w = Window.partitionBy("shape")
    rest = t.meter.withColumn("rest", F.sum("points").over(w) - F.sum("points").over(w.orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)))
    return rest.filter("rest < 5000").groupBy("shape").agg((F.min("ms") + 3_600_000).alias("release"))


@query("w06_sequence", "SELECT id, channel, kind, row_number() OVER (PARTITION BY channel, kind ORDER BY ms, id) - 1 AS seq FROM message")
def w06(t: Tables) -> DataFrame:
    return t.message.withColumn("seq", (F.row_number().over(Window.partitionBy("channel", "kind").orderBy("ms", "id")) - 1).cast("long")).select("id", "channel", "kind", "seq")


@query("w07_ordinal", "SELECT ord, row_number() OVER (ORDER BY template, page, ord) - 1 AS ordinal FROM units")
def w07(t: Tables) -> DataFrame:
    return R.dense_ordinal(t.units.select("template", "page", "ord"), ["page", "ord"], "ordinal", "template").select("ord", "ordinal")


@query("w08_place", "SELECT page, ord, piece::BIGINT AS piece, row_number() OVER (PARTITION BY page ORDER BY ord, piece) - 1 AS place FROM (SELECT page, ord, unnest(range(len(string_split(text, chr(10))))) AS piece FROM units)")
def w08(t: Tables) -> DataFrame:
    pieces = t.units.select("page", "ord", F.posexplode(F.split("text", "\n")).alias("piece", "line"))
    return pieces.select("page", "ord", F.col("piece").cast("long").alias("piece"), (F.row_number().over(Window.partitionBy("page").orderBy("ord", "piece")) - 1).cast("long").alias("place"))


@query("w10_interleave", "SELECT id, kind, row_number() OVER (PARTITION BY kind, channel ORDER BY ms, id) AS place FROM message")
def w10(t: Tables) -> DataFrame:
    return R.interleaved(t.message, ["kind", "channel"], ["ms", "id"], []).select("id", "kind", F.col("place").cast("long").alias("place"))


@query(
    "w11_largest_drop",
    """WITH r AS (SELECT channel, author, n, row_number() OVER (PARTITION BY channel ORDER BY n DESC, author) AS rn, lead(n) OVER (PARTITION BY channel ORDER BY n DESC, author) AS nx FROM (SELECT channel, author, count(*) AS n FROM message GROUP BY 1, 2)),
    d AS (SELECT channel, rn, CASE WHEN nx IS NOT NULL AND rn < 6 THEN round((n - nx) / n::DOUBLE, 6) ELSE 0.0 END AS d FROM r WHERE rn <= 6)
    SELECT channel, arg_max(rn, struct_pack(d := d, r := -rn)) AS cluster, max(d)::DOUBLE AS drop FROM d GROUP BY channel""",
)
def w11(t: Tables) -> DataFrame:
    counts = t.message.groupBy("channel", "author").agg(F.count("*").alias("n"))
    return R.largest_drop(counts, ["channel"], [F.desc("n"), "author"], "n", 6)


# ---- O: orders and samples -------------------------------------------------------------------------


@query("o01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o01(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("o02_three_keys", "SELECT id, shape, row_number() OVER (PARTITION BY shape ORDER BY points DESC, uncached DESC, id) AS place FROM meter")
def o02(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("points"), F.desc("uncached"), "id"))
    return t.meter.select("id", "shape", place.cast("long").alias("place"))


@query("o03_floor_cut", "SELECT shape, id, points FROM (SELECT *, max(points) OVER (PARTITION BY shape) AS best FROM meter) WHERE points >= best * 0.55")
def o03(t: Tables) -> DataFrame:
    return R.relative_floor(t.meter, ["shape"], "points", 0.55).select("shape", "id", "points")


@query("o04_top_n", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def o04(t: Tables) -> DataFrame:
    return R.grouped_counts(t.part, "p_brand").orderBy(F.desc("n"), "p_brand").limit(10)


_NTH = """SELECT {key} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {key}) - 1 AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM {table})
WHERE rn IN (SELECT unnest(list_transform(range(least(greatest({want}, 1), n)), lambda i: i * n // least(greatest({want}, 1), n))))"""


@query("o05_stratify", _NTH.format(key="ord", group="template", table="units", want="(2 * n + 9) // 20"))
def o05(t: Tables) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("template"))
    rows = t.units.select("ord", "template").withColumn("want", F.floor((2 * n + 9) / 20))
    return R.every_nth(rows, ["template"], ["ord"], F.col("want")).select("ord")


@query("o06_per_family", _NTH.format(key="id", group="kind", table="message", want="25"))
def o06(t: Tables) -> DataFrame:
    return R.every_nth(t.message, ["kind"], ["id"], F.lit(25)).select("id")


@query("o07_cap", "SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(id::VARCHAR), id) AS rn FROM message) WHERE rn <= 30")
def o07(t: Tables) -> DataFrame:
    return R.top_per_group(t.message, ["kind"], [F.md5(F.col("id").cast("string")), "id"], 30).select("id", "kind")


@query(
    "o10_diversified",
    "SELECT person, region, turn FROM (SELECT person, region, balance, CASE WHEN region IS NULL THEN 1 ELSE least(row_number() OVER (PARTITION BY region ORDER BY balance DESC, person), 2) END AS turn FROM persons) ORDER BY turn, balance DESC, person LIMIT 8",
)
def o10(t: Tables) -> DataFrame:
    order = [F.desc("balance"), "person"]
    return R.one_per_group_then_fill(t.persons, "region", order, 8, order).select("person", "region", F.col("turn").cast("long").alias("turn"))


@query(
    "o11_boundary",
    "SELECT template, arg_min(ord, struct_pack(c := chars, o := ord)) AS smallest, arg_min(ord, struct_pack(c := -chars, o := ord)) AS largest, min(ord) AS first FROM units GROUP BY template",
)
def o11(t: Tables) -> DataFrame:
    pick = lambda key: F.min_by("ord", F.struct(key, "ord"))
    return t.units.groupBy("template").agg(pick(F.col("chars")).alias("smallest"), pick((-F.col("chars")).alias("c")).alias("largest"), F.min("ord").alias("first"))


@query(
    "o12_probe_set",
    """WITH top AS (SELECT person FROM persons ORDER BY balance DESC, person LIMIT 3)
    SELECT person, 'top' AS part FROM top UNION ALL SELECT person, 'bottom' FROM (SELECT person FROM persons WHERE person NOT IN (SELECT person FROM top) ORDER BY balance, person LIMIT 2)""",
)
def o12(t: Tables) -> DataFrame:
    top = t.persons.orderBy(F.desc("balance"), "person").limit(3).select("person")
    bottom = R.drop_matching(t.persons, top, "person").orderBy("balance", "person").limit(2).select("person")
    return top.withColumn("part", F.lit("top")).unionByName(bottom.withColumn("part", F.lit("bottom")))


@query("o13_seeded_sample", "SELECT id FROM message ORDER BY md5('7|' || id), id LIMIT 100")
def o13(t: Tables) -> DataFrame:
    return R.hash_sample(t.message, "id", 100, 7).select("id")


_PAIRS = "SELECT x.person AS a, y.person AS b, count(*) AS n FROM attribution x JOIN attribution y ON x.unit = y.unit AND x.person < y.person GROUP BY 1, 2"
_BOTH = f"SELECT a AS one, b AS other, n FROM ({_PAIRS}) UNION ALL SELECT b, a, n FROM ({_PAIRS})"


@query("o14_companions", f"SELECT one, other, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY one ORDER BY n DESC, other) AS rn FROM ({_BOTH})) WHERE rn <= 8")
def o14(t: Tables) -> DataFrame:
    both = R.both_directions(R.unordered_pairs(t.attribution, "unit", "person"), "a", "b")
    return R.top_per_group(both, ["one"], [F.desc("n"), "other"], 8).withColumn("rank", F.col("rank").cast("long"))


# ---- X: sets ---------------------------------------------------------------------------------------


@query("x01_both_directions", _BOTH)
def x01(t: Tables) -> DataFrame:
    return R.both_directions(R.unordered_pairs(t.attribution, "unit", "person"), "a", "b")


@query("x02_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def x02(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("x03_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def x03(t: Tables) -> DataFrame:
    of = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select("l_partkey")
    return of("R").intersect(of("A"))


_DELTA = """WITH b AS (SELECT author, max(ms) AS v FROM message WHERE ms < 1705000000000 GROUP BY 1), a AS (SELECT author, max(ms) AS v FROM message WHERE kind <> 'signup' GROUP BY 1)
SELECT coalesce(a.author, b.author) AS author, CASE WHEN b.author IS NULL THEN 'added' WHEN a.author IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN a USING (author) WHERE b.author IS NULL OR a.author IS NULL OR a.v IS DISTINCT FROM b.v"""


@query("x04_delta", _DELTA)
def x04(t: Tables) -> DataFrame:
    newest = lambda df: df.groupBy("author").agg(F.max("ms").alias("v"))
    return R.symmetric_delta(newest(t.message.filter("ms < 1705000000000")), newest(t.message.filter("kind <> 'signup'")), "author", "v")


@query("x05_minus", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def x05(t: Tables) -> DataFrame:
    return R.drop_matching(t.benchmark, t.labels.select(F.col("doc_id").alias("item_id")), "item_id").select("item_id")


@query("x06_distinct", "SELECT DISTINCT lang, source FROM documents")
def x06(t: Tables) -> DataFrame:
    return t.documents.select("lang", "source").distinct()
