"""Queries: cleaning, units, identities, statistics and guards over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import guards as G
from ..operators import relational as R
from ..operators.names import leak_share, name_leaks
from ..sources.scratch import scratch
from .core import Tables, query
from .scalars import TOKENS

_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?s)<[^>]*>', '', 'g'), '[^\p{L}\p{N}]', '', 'g')"


@query("c01_comments", r"SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g')) AS h FROM pages")
def c01(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(C.without_comments(F.col("html"))).alias("h"))


# Columns of a part in nested tables; every fifth part's outer table isn't closed. The pages themselves come too.
@query("c02_strip_tables", "SELECT 'part' AS kind, p_partkey AS id, md5(p_brand || '<b>' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size || p_brand END) AS h FROM part UNION ALL SELECT 'page', page_id, md5(regexp_replace(html, '(?is)<table\\b.*', '', 'g')) FROM pages")
def c02(t: Tables) -> DataFrame:
    @F.pandas_udf("string")
    def strip(html):
        return html.map(lambda x: None if x is None else C.strip_tables(x))

    inner = F.concat(F.lit('<TABLE class="a"><tr><td>'), "p_name", F.lit("</td></tr></TABLE >"))
    close = F.when(F.col("p_partkey") % 5 == 0, "").otherwise("</table>")
    html = F.concat("p_brand", F.lit("<b><table><tr><td>"), "p_type", inner, "p_type", inner, F.lit("</td></tr>"), close, "p_size", inner, "p_brand")
    parts = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), html.alias("html"))
    every = parts.unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "html"))
    return every.select("kind", "id", F.md5(strip("html")).alias("h"))


@query("c05_flatten", r"SELECT page_id, length(" + _VISIBLE.replace("html,", r"regexp_replace(regexp_replace(regexp_replace(html, '(?si)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?si)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?si)<nav\b[^>]*>.*?</nav\s*>', '', 'g'),", 1) + r")::BIGINT AS letters FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '('), '&gt;', ')'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '+') AS html FROM pages)")
def c05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.visible_letters(C.flattened(F.col("html"))).cast("long").alias("letters"))


@query("c07_sections")
def c07(t: Tables) -> DataFrame:
    made = C.page_sections(t.pages, "page_id", "html")
    return made.select("page_id", "seq", F.array_join("path", " > ").alias("path"), F.length("body").alias("chars"), "at")


# A commented-out heading, a short section, a lead, a skipped level and a dropped section round columns of a part.
@query(
    "c07_part_sections",
    """SELECT p_partkey AS id, 0 AS seq, 'lead' AS path, 'of the make ' || p_brand || ' and of ' || p_type AS body, 0 AS at FROM part
    UNION ALL SELECT p_partkey, 1, p_name, 'body of some length about ' || p_type, length(p_brand) + length(p_type) + 23 FROM part
    UNION ALL SELECT p_partkey, 2, p_name || ' > ' || p_size, 'deeper text about the size of ' || p_brand, length(p_brand) + 2 * length(p_type) + length(p_name) + 58 FROM part""",
)
def c07_parts(t: Tables) -> DataFrame:
    html = F.concat(
        F.lit("<p>of the make "), "p_brand", F.lit(" and of "), "p_type", F.lit("<!-- <h2>gone</h2> -->"),
        F.lit("<h2>"), "p_name", F.lit("</h2>body of some length about "), "p_type",
        F.lit("<h4><i>"), "p_size", F.lit("</i></h4>deeper text about the size of "), "p_brand",
        F.lit("<h3>short</h3>few words<h2>Notes</h2>what is long enough but stands under a dropped heading"),
    )
    made = C.page_sections(t.part.select("p_partkey", html.alias("html")), "p_partkey", "html", drop=("Notes",))
    return made.select(F.col("p_partkey").alias("id"), "seq", F.array_join("path", " > ").alias("path"), "body", "at")


@query("c04_headings", r"SELECT page_id, len(regexp_extract_all(html, '(?si)<h[1-6][^>]*>(.*?)</h[1-6]>'))::BIGINT AS n FROM pages")
def c04(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(C.headings(F.col("html"))).cast("long").alias("n"))


@query("c08_visible", f"SELECT page_id, length({_VISIBLE})::BIGINT AS letters FROM pages")
def c08(t: Tables) -> DataFrame:
    plain = F.regexp_replace(C.without_comments(F.col("html")), r"(?s)<[^>]*>", "")
    return t.pages.select("page_id", C.visible_letters(plain).cast("long").alias("letters"))


@query("c09_routes", "SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/en/') THEN 'english' ELSE 'any' END AS route FROM pages")
def c09(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("any", "^h"), ("french", "/fr/"), ("english", "/en/")], "route string, pattern string")
    return C.routed(t.pages.select("page_id", "url"), rules, "url").select("page_id", "route")


def _paragraphs(html: str) -> tuple[list[tuple[str, str]], list[str]]:
    return [("line", x) for x in re.findall(r"<p>([^<]*)", html)], (["entities"] if "&amp;&amp;" in html else [])


def _links(html: str) -> tuple[list[tuple[str, str]], list[str]]:
    return [("ref", x) for x in re.findall(r'href="/([^"]*)"', html)], []


@query(
    "c10_page_records",
    """WITH r AS (SELECT page_id, html, CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de') THEN 'bare' END AS route FROM pages),
    x AS (SELECT page_id, route, CASE route WHEN 'english' THEN 'line' ELSE 'ref' END AS kind, CASE route WHEN 'english' THEN regexp_extract_all(html, '<p>([^<]*)', 1) WHEN 'french' THEN regexp_extract_all(html, 'href="/([^"]*)"', 1) ELSE [] END AS v, html FROM r WHERE route IS NOT NULL)
    SELECT page_id, route, kind, (unnest(range(len(v))))::INT AS seq, md5(unnest(v)) AS h FROM x WHERE len(v) > 0
    UNION ALL SELECT page_id, route, CASE route WHEN 'bare' THEN 'expected empty' ELSE 'empty' END, 0, NULL FROM x WHERE len(v) = 0
    UNION ALL SELECT page_id, route, 'warning', greatest(len(v), 1)::INT, md5('entities') FROM x WHERE route = 'english' AND contains(html, '&amp;&amp;')
    UNION ALL SELECT page_id, route, 'unrouted', 0, NULL FROM r WHERE route IS NULL""",
)
def c10(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("bare", "/de"), ("french", "/fr/"), ("english", "/en/")], "route string, pattern string")
    parsers = {"english": _paragraphs, "french": _links, "bare": lambda html: ([], [])}
    made = C.page_records(t.pages.select("page_id", "url", "html"), rules, "url", "html", parsers, bare=("bare",))
    return made.select("page_id", "route", "kind", F.col("seq").cast("int").alias("seq"), F.md5("value").alias("h"))


_DECLARED = "declared AS (SELECT p_partkey AS page, p_partkey - p_partkey % 5 AS canonical FROM part WHERE p_partkey % 5 IN (1, 2)), pages_ AS (SELECT p_partkey AS page FROM part)"


@query("c12_identity", f"WITH {_DECLARED} SELECT p.page, coalesce(d.canonical, p.page) AS person FROM pages_ p LEFT JOIN declared d USING (page)")
def c12(t: Tables) -> DataFrame:
    pages = t.part.select(F.col("p_partkey").alias("page"))
    declared = pages.filter("page % 5 in (1, 2)").withColumn("canonical", F.expr("page - page % 5"))
    return C.resolved_identity(pages, declared, pages)[0].select("page", "person")


@query("c13_redirects", "WITH RECURSIVE e AS (SELECT c_custkey AS node, c_custkey // 2 AS next FROM customer WHERE c_custkey > 0), w AS (SELECT node, next AS target FROM e UNION ALL SELECT w.node, e.next FROM w JOIN e ON e.node = w.target) SELECT node, min(target) AS target FROM w GROUP BY node")
def c13(t: Tables) -> DataFrame:
    edges = t.customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 2").alias("next"))
    return C.followed(edges)


_ALIAS = "a AS (SELECT DISTINCT p_brand AS alias, p_type AS target FROM part UNION SELECT DISTINCT p_type, p_type || '!' FROM part)"


def _aliases(t: Tables) -> DataFrame:
    one = t.part.select(F.col("p_brand").alias("alias"), F.col("p_type").alias("target"))
    return one.unionByName(t.part.select(F.col("p_type").alias("alias"), F.concat("p_type", F.lit("!")).alias("target"))).distinct()


@query("c14_settled", f"WITH {_ALIAS}, u AS (SELECT alias, min(target) AS t FROM a GROUP BY 1 HAVING count(DISTINCT target) = 1) SELECT a.alias, coalesce(u.t, a.target) AS target FROM a LEFT JOIN u ON u.alias = a.target")
def c14(t: Tables) -> DataFrame:
    return C.settled_targets(_aliases(t))


@query("c15_term_aliases", "SELECT DISTINCT trim(unnest(string_split(replace(p_name, ' ', '/'), '/'))) AS alias, p_brand AS target FROM part")
def c15(t: Tables) -> DataFrame:
    return C.term_aliases(t.part.withColumn("r", F.replace("p_name", F.lit(" "), F.lit(" / "))), "p_brand", "r")


@query("c16_exact_terms", "SELECT DISTINCT n AS alias, CASE WHEN length(n) <= 4 THEN 'term_exact' ELSE 'term' END AS kind FROM (SELECT split_part(p_name, ' ', 2) AS n FROM part)")
def c16(t: Tables) -> DataFrame:
    names = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("alias")).distinct()
    return names.select("alias", C.exact_terms(F.col("alias"), F.lit("term")).alias("kind"))


@query("c17_site_aliases", "SELECT count(*) FILTER (l_suppkey IN (SELECT person FROM persons WHERE region = 1)) AS kept, count(*) FILTER (l_suppkey NOT IN (SELECT person FROM persons WHERE region = 1)) AS dropped FROM lineitem")
def c17(t: Tables) -> DataFrame:
    held = t.persons.filter("region = 1").select(F.col("person").alias("l_suppkey"), F.lit(1).alias("in"))
    both = t.lineitem.select("l_suppkey").join(held, "l_suppkey", "left")
    return both.agg(F.count("in").alias("kept"), (F.count("*") - F.count("in")).alias("dropped"))


@query("c18_owner_ladder", "SELECT b.p_brand AS label, coalesce(x.person, y.person) AS person FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand, min(p_size) AS person FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1) x USING (p_brand) LEFT JOIN (SELECT p_brand, min(p_partkey) AS person FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) = 1) y USING (p_brand)")
def c18(t: Tables) -> DataFrame:
    labels = t.part.select(F.col("p_brand").alias("label"), F.col("p_size").cast("long").alias("size"), "p_partkey")
    one = labels.select("label", F.col("size").alias("person"))
    two = labels.filter("size > 40").select("label", F.col("p_partkey").alias("person"))
    return C.owner_ladder(labels, "label", one, two)


@query("c19_majority", "SELECT l_shipmode_ AS label, person, n, all_ AS \"all\" FROM (SELECT label AS l_shipmode_, person, n, sum(n) OVER (PARTITION BY label)::BIGINT AS all_, row_number() OVER (PARTITION BY label ORDER BY n DESC, person) AS rn FROM (SELECT l_orderkey % 50 AS label, l_suppkey % 2 AS person, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rn = 1 AND n >= 10 AND n * 2 >= all_")
def c19(t: Tables) -> DataFrame:
    lines = t.lineitem.select((F.col("l_orderkey") % 50).alias("label"), (F.col("l_suppkey") % 2).alias("person"))
    return C.majority(lines, "label", "person", 10, 0.5)


@query("c20_own_chars", "SELECT speaker, sum(length(text))::BIGINT AS chars FROM lines GROUP BY speaker")
def c20(t: Tables) -> DataFrame:
    return t.lines.groupBy("speaker").agg(F.sum(F.length("text")).alias("chars"))


@query("c21_conflicts", "SELECT scene, speaker FROM lines GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (length(text) % 2 = 0) = count(*)")
def c21(t: Tables) -> DataFrame:
    made = t.lines.groupBy("scene", "speaker").agg(F.count("*").alias("n"), F.sum((F.length("text") % 2 == 0).cast("int")).alias("other"))
    return made.filter("n >= 3 and other = n").select("scene", "speaker")


# The cut as a recursion over what is left of each text; pieces lose outer white space, the last one only in front.
_CUT = r"""RECURSIVE cut(ord, n, piece, rest) AS (SELECT ord, -1, '', text FROM units WHERE text <> ''
  UNION ALL SELECT ord, n + 1, CASE WHEN length(rest) <= 600 THEN rest ELSE regexp_replace(substr(rest, 1, upto), '^\s+|\s+$', '', 'g') END, CASE WHEN length(rest) <= 600 THEN '' ELSE regexp_replace(substr(rest, upto + 1), '^\s+', '') END
  FROM (SELECT *, CASE WHEN p1 > 200 THEN p1 + 1 WHEN p2 > 200 THEN p2 + 2 WHEN p3 > 200 THEN p3 + 1 ELSE 600 END AS upto FROM (
    SELECT *, length(regexp_extract(substr(rest, 1, 600), '(?s)^(.*)\n', 1)) AS p1, length(regexp_extract(substr(rest, 1, 600), '(?s)^(.*)\. ', 1)) AS p2, length(regexp_extract(substr(rest, 1, 600), '(?s)^(.*) ', 1)) AS p3 FROM cut WHERE rest <> ''))),
pieces AS (SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY n) - 1)::INT AS piece, piece AS text FROM cut WHERE n >= 0 AND piece <> '')"""


@query("c22_split_text", f"WITH {_CUT} SELECT ord, piece, md5(text) AS h FROM pieces")
def c22(t: Tables) -> DataFrame:
    return C.pieces(t.units, "ord", "text", 600).select("ord", "piece", F.md5("text").alias("h"))


@query("c23_lore_units", f"WITH {_CUT} SELECT page || '#' || (row_number() OVER (PARTITION BY page ORDER BY ord, piece) - 1) AS id, page || ' > ' || template AS header, length(pieces.text) AS chars FROM pieces JOIN units USING (ord)")
def c23(t: Tables) -> DataFrame:
    made = C.pieces(t.units, "ord", "text", 600).join(t.units.select("ord", "page", "template"), "ord")
    place = F.row_number().over(Window.partitionBy("page").orderBy("ord", "piece")) - 1
    return made.select(F.concat_ws("#", "page", place.cast("string")).alias("id"), F.concat_ws(" > ", "page", "template").alias("header"), F.length("text").alias("chars"))


def _folded(target: int, most: int) -> str:
    return f"""RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY seq) AS rn, lead(speaker) OVER (PARTITION BY scene ORDER BY seq) IS DISTINCT FROM speaker AS turn FROM lines),
f(scene, rn, unit, held, chars) AS (SELECT scene, 1::BIGINT, 0::BIGINT, 1, length(coalesce(text, '')) FROM l WHERE rn = 1
  UNION ALL SELECT l.scene, l.rn, f.unit + closed::INT, CASE WHEN closed THEN 1 ELSE f.held + 1 END, CASE WHEN closed THEN 0 ELSE f.chars END + length(coalesce(l.text, ''))
  FROM (SELECT f.*, held >= {most} OR (turn AND chars >= {target}) AS closed FROM f JOIN l USING (scene, rn)) f JOIN l ON l.scene = f.scene AND l.rn = f.rn + 1),
said AS (SELECT * FROM f JOIN l USING (scene, rn)), bounds AS (SELECT scene, unit, min(seq) AS lo, max(seq) AS hi FROM said GROUP BY 1, 2)"""


@query(
    "c24_dialogue_units",
    f"""WITH {_folded(600, 4)}, who AS (SELECT scene, unit, string_agg(speaker, ',' ORDER BY first) AS speakers FROM (SELECT scene, unit, speaker, min(rn) AS first FROM said GROUP BY 1, 2, 3) GROUP BY 1, 2),
    body AS (SELECT scene, unit, md5(string_agg(speaker || ': ' || coalesce(text, ''), chr(10) ORDER BY rn)) AS h FROM said GROUP BY 1, 2) SELECT scene, unit, lo, hi, speakers, h FROM bounds JOIN who USING (scene, unit) JOIN body USING (scene, unit)""",
)
def c24(t: Tables) -> DataFrame:
    return C.dialogue_units(t.lines).select("scene", "unit", "lo", "hi", "speakers", F.md5("text").alias("h"))


@query("w09_turn_cuts", f"WITH {_folded(300, 3)} SELECT scene, unit, lo, hi FROM bounds")
def w09(t: Tables) -> DataFrame:
    return C.dialogue_units(t.lines, 300, 3).select("scene", "unit", "lo", "hi")


@query("c25_replies", "SELECT a.scene, a.seq, min(b.seq) AS reply FROM lines a JOIN lines b ON b.scene = a.scene AND b.seq > a.seq AND b.speaker = 'assistant' WHERE a.speaker = 'user' GROUP BY 1, 2")
def c25(t: Tables) -> DataFrame:
    # The next assistant turn of each user turn, by a window instead of a range join.
    w = Window.partitionBy("scene").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    reply = F.first(F.when(F.col("speaker") == "assistant", F.col("seq")), ignorenulls=True).over(w)
    return t.lines.withColumn("reply", reply).filter("speaker = 'user' and reply is not null").select("scene", "seq", "reply")


# A person's units in order: those on the skip list go, of one form (customer) the first stays, and variants are told.
@query(
    "c26_voice_units",
    """WITH v AS (SELECT a.person, a.unit, o.o_custkey AS form, o.o_orderpriority AS variant FROM attribution a JOIN orders o ON o.o_orderkey = a.unit WHERE a.unit NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person, form ORDER BY unit) AS rn FROM v) WHERE rn = 1)
    SELECT person, unit, row_number() OVER (PARTITION BY person ORDER BY unit) - 1 AS seq, 'person ' || person || ' > ' || variant AS header FROM first""",
)
def c26(t: Tables) -> DataFrame:
    skipped = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("unit"))
    forms = t.orders.select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("form"), F.col("o_orderpriority").alias("variant"))
    own = R.drop_matching(t.attribution, skipped, "unit").join(forms, "unit")
    first = R.first_per_group(own, ["person", "form"], ["unit"])
    seq = F.row_number().over(Window.partitionBy("person").orderBy("unit")) - 1
    return first.select("person", "unit", seq.cast("long").alias("seq"), F.concat(F.lit("person "), "person", F.lit(" > "), "variant").alias("header"))


@query("c27_facet_cards", "WITH f AS (SELECT p_brand AS person, p_partkey AS page, p_type, p_size FROM part), b AS (SELECT person, arg_min(page, page) AS page0, arg_min(p_type, page) AS t0, arg_min(p_size, page) AS s0 FROM f GROUP BY 1) SELECT person, page, concat_ws(',', CASE WHEN p_size <> s0 THEN 'size' END, CASE WHEN p_type <> t0 THEN 'type' END) AS fields FROM f JOIN b USING (person) WHERE page <> page0")
def c27(t: Tables) -> DataFrame:
    facets = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return C.facet_cards(t.part.select(F.col("p_brand").alias("person"), F.col("p_partkey").alias("page"), facets.alias("facets")), "person", "page", "facets")


@query("c28_letters", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || chr(10) || c_name AS body FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def c28(t: Tables) -> DataFrame:
    both = t.orders.filter("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n"), "c_name").alias("body"))


@query("c29_first_copies", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def c29(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("sig")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("c30_attribution", "SELECT unit, person FROM attribution WHERE person IN (SELECT person FROM persons WHERE region < 3)")
def c30(t: Tables) -> DataFrame:
    return R.keep_matching(t.attribution, t.persons.filter("region < 3"), "person").select("unit", "person")


@query("c31_co_appearance", "SELECT a.speaker AS a, b.speaker AS b, count(DISTINCT a.scene) AS scenes FROM lines a JOIN lines b ON a.scene = b.scene AND a.speaker < b.speaker GROUP BY 1, 2")
def c31(t: Tables) -> DataFrame:
    return R.unordered_pairs(t.lines, "scene", "speaker").select("a", "b", F.col("n").alias("scenes"))


@query("c32_knowledge_scope", "SELECT scene, seq, CASE WHEN speaker = 'assistant' THEN 'self' ELSE 'lived' END AS kind FROM lines l WHERE EXISTS (SELECT 1 FROM lines c WHERE c.scene = l.scene AND c.speaker = 'assistant' AND abs(c.seq - l.seq) <= 2)")
def c32(t: Tables) -> DataFrame:
    near = R.within_band(t.lines, t.lines.filter("speaker = 'assistant'"), "scene", "seq", 2)
    return near.select("scene", "seq", F.when(F.col("speaker") == "assistant", "self").otherwise("lived").alias("kind"))


@query("c33_roster", "WITH m AS (SELECT person, count(*) AS material FROM attribution GROUP BY 1), v AS (SELECT list_sort(list(material)) AS v FROM m) SELECT person, material, round(material / (material + v[len(v) // 2 + 1])::DOUBLE, 4)::DOUBLE AS confidence FROM m, v")
def c33(t: Tables) -> DataFrame:
    return C.roster_confidence(t.attribution.groupBy("person").agg(F.count("*").alias("material")), "material")


@query("c34_template_stats", "SELECT template, count(*) AS n, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95, v[len(v)] AS max FROM (SELECT template, list_sort(list(chars)) AS v FROM units GROUP BY template), units USING (template) GROUP BY template, v".replace(", units USING (template) GROUP BY template, v", "").replace("count(*) AS n", "len(v)::BIGINT AS n"))
def c34(t: Tables) -> DataFrame:
    return C.template_stats(t.units, "template", "chars")


@query("c35_fingerprint", "SELECT sha256(concat_ws(' ', count(*), sum(a)::HUGEINT, sum(b)::HUGEINT, bit_xor(a), bit_xor(b))) AS fingerprint FROM (SELECT ('0x' || substr(md5(id), 1, 15))::BIGINT AS a, ('0x' || substr(md5(id), 16, 15))::BIGINT AS b FROM units)")
def c35(t: Tables) -> DataFrame:
    return C.fingerprint(t.units, "id")


@query("c36_metadata_header", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '(^|[^a-z])(ref|page)([^a-z]|$)')")
def c36(t: Tables) -> DataFrame:
    return t.pages.filter(F.lower("url").rlike("(?<![a-z])(?:ref|page)(?![a-z])")).select("page_id")


@query("c37_column_order")
def c37(t: Tables) -> DataFrame:
    order = C.merged_order([t.part.columns, ["p_partkey", "p_note", "p_name"], ["p_size", "p_extra"]])
    return t.spark.createDataFrame(list(enumerate(order)), "place int, name string")


@query("c38_yield", f"SELECT page_id FROM pages WHERE length({_VISIBLE}) * 2 < length(html) AND length({_VISIBLE}) >= 200")
def c38(t: Tables) -> DataFrame:
    letters = C.visible_letters(F.regexp_replace(C.without_comments(F.col("html")), r"(?s)<[^>]*>", ""))
    return t.pages.withColumn("l", letters).filter((F.col("l") * 2 < F.length("html")) & (F.col("l") >= C.MIN_VISIBLE)).select("page_id")


# ---- G: guards -----------------------------------------------------------------------------------------


@query("g01_drift", "SELECT coalesce(a.author, b.author) AS author, CASE WHEN b.n IS NULL THEN 'low' WHEN coalesce(a.n, 0) < b.n THEN 'high' ELSE 'low' END AS severity FROM (SELECT author, count(*) AS n FROM message WHERE id % 2 = 0 GROUP BY 1) a FULL OUTER JOIN (SELECT author, count(*) AS n FROM message WHERE id % 2 = 1 AND author % 9 > 0 GROUP BY 1) b USING (author) WHERE a.n IS DISTINCT FROM b.n")
def g01(t: Tables) -> DataFrame:
    now = R.grouped_counts(t.message.filter("id % 2 = 0"), "author")
    return G.drift(now, R.grouped_counts(t.message.filter("id % 2 = 1 and author % 9 > 0"), "author"), "author")


@query("g02_reconciled", "SELECT lang, count(*) AS made, count(DISTINCT text) AS kept, 0::BIGINT AS ignored FROM documents GROUP BY lang HAVING count(*) <> count(DISTINCT text)")
def g02(t: Tables) -> DataFrame:
    made = R.grouped_counts(t.documents, "lang")
    kept = R.grouped_counts(t.documents.select("lang", F.sha2("text", 256).alias("s")).distinct(), "lang")
    return G.reconciled(made, kept, made.filter("false"), "lang")


@query("g03_unknown_constructs", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) WHERE tag NOT IN ('p', 'b', 'i', 'a', 'div', 'h1', 'h2', 'ul', 'li', 'br') GROUP BY 1")
def g03(t: Tables) -> DataFrame:
    tags = t.pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return R.grouped_counts(tags.filter(~F.col("tag").isin("p", "b", "i", "a", "div", "h1", "h2", "ul", "li", "br")), "tag")


@query("g04_empty_pages", "SELECT doc_id, CASE WHEN lang IN ('de') THEN 'low' ELSE 'high' END AS severity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def g04(t: Tables) -> DataFrame:
    return G.empty_pages(t.documents, t.labels, "doc_id", F.when(F.col("lang") == "de", "known"))


@query("g05_alias_conflicts", f"WITH {_ALIAS} SELECT DISTINCT alias, 'hop' AS problem FROM a WHERE target IN (SELECT alias FROM a) AND alias <> target UNION ALL SELECT DISTINCT alias, 'sentence' FROM a WHERE length(alias) > 25 UNION ALL SELECT alias, 'conflict' FROM a GROUP BY alias HAVING count(DISTINCT target) > 1")
def g05(t: Tables) -> DataFrame:
    return G.alias_conflicts(_aliases(t), C.ALIAS_MAX_CHARS)


@query("g06_attribution", "SELECT template, round(count(*) FILTER (ord NOT IN (SELECT unit FROM attribution)) / count(*)::DOUBLE, 6)::DOUBLE AS missing FROM units GROUP BY template")
def g06(t: Tables) -> DataFrame:
    held = t.attribution.select(F.col("unit").alias("ord"), F.lit(1).alias("in")).distinct()
    both = t.units.select("ord", "template").join(held, "ord", "left")
    return both.groupBy("template").agg(F.round(1 - F.count("in") / F.count("*"), 6).alias("missing"))


@query("g07_size_budget", "SELECT template, n, over, under, CASE WHEN (over * 100 >= n AND over > 0) OR (under * 5 >= n AND under > 0) THEN 'high' ELSE 'low' END AS severity FROM (SELECT template, count(*) AS n, sum((chars * 100 > 3000 * 125)::INT)::BIGINT AS over, sum((chars < 24)::INT)::BIGINT AS under FROM units GROUP BY 1) WHERE over > 0 OR under > 0")
def g07(t: Tables) -> DataFrame:
    return G.size_budget(t.units, "template", "chars", 3000)


@query("g08_redundancy", "SELECT span_of % 3 AS mode, round(sum(times) / count(*) - 1, 6)::DOUBLE AS redundancy FROM (SELECT span_of, pos, count(*) AS times FROM (SELECT span_of, unnest(range(lo, hi + 1)) AS pos FROM ranges) GROUP BY ALL) GROUP BY 1")
def g08(t: Tables) -> DataFrame:
    every = t.ranges.select("span_of", F.explode(F.sequence("lo", "hi")).alias("pos"))
    counts = every.groupBy("span_of", "pos").agg(F.count("*").alias("times"))
    return counts.groupBy((F.col("span_of") % 3).alias("mode")).agg(F.round(F.sum("times") / F.count("*") - 1, 6).alias("redundancy"))


@query("g09_unread_kinds", "SELECT DISTINCT kind FROM message WHERE kind NOT IN ('view', 'purchase')")
def g09(t: Tables) -> DataFrame:
    return G.unread_kinds(t.message, t.spark.createDataFrame([("view",), ("purchase",)], "kind string"))


@query("g10_figures", "SELECT 'units' AS figure, count(*)::DOUBLE AS value, true AS ok FROM units UNION ALL SELECT 'mean_chars', round(avg(chars), 6)::DOUBLE, round(avg(chars), 6) < 100000 FROM units UNION ALL SELECT 'persons', count(*)::DOUBLE, true FROM persons")
def g10(t: Tables) -> DataFrame:
    from ..plans.figures import figure_table

    return figure_table(t, {"units": ">= 1", "mean_chars": "< 100000", "persons": "> 0"})


@query("g11_unexplained", "SELECT id FROM message WHERE kind = 'error' AND NOT regexp_matches(props, '[13579]}$')")
def g11(t: Tables) -> DataFrame:
    findings = t.message.filter("kind = 'error'").withColumn("severity", F.lit("low"))
    notes = t.spark.createDataFrame([("[135]}$",), ("[79]}$",)], "pattern string")
    return G.unexplained(findings, notes, "props").select("id")


# A conversation stands for a person; the words that its first turn opens with and ends on are its aliases.
_LEAKS = r"""names AS (SELECT scene, name FROM (SELECT scene, unnest([scene::VARCHAR, regexp_extract(text, '^[A-Za-z]+'), regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)]) AS name FROM lines WHERE seq = 0) WHERE length(name) >= 2),
leaks AS (SELECT l.scene, count(*) FILTER (EXISTS (SELECT 1 FROM names n WHERE n.scene = l.scene AND contains(l.text, n.name))) AS leaks, count(*) AS n FROM lines l WHERE text IS NOT NULL GROUP BY l.scene HAVING count(*) >= 2)"""


def _leaks(t: Tables) -> DataFrame:
    own = t.lines.filter("seq = 0").select("scene", F.explode(F.array(F.col("scene").cast("string"), F.regexp_extract("text", r"^[A-Za-z]+", 0), F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]*$", 1))).alias("name"))
    return name_leaks(t.lines, own, "scene", "name", "seq", "text", min_lines=2)


@query("g12_name_leak", f"WITH {_LEAKS} SELECT scene, leaks, n FROM leaks")
def g12(t: Tables) -> DataFrame:
    return _leaks(t)


@query("g12_leak_share", f"WITH {_LEAKS} SELECT round(sum(leaks) / sum(n)::DOUBLE, 6)::DOUBLE AS share FROM leaks")
def g12_share(t: Tables) -> DataFrame:
    return leak_share(_leaks(t))


@query("g13_stopword_df", f"SELECT term, round(count(DISTINCT ord) / (SELECT count(*) FROM units)::DOUBLE, 6)::DOUBLE AS share FROM (SELECT ord, unnest({TOKENS}) AS term FROM units) WHERE term IN ('the', 'and', 'of', 'de') GROUP BY term")
def g13(t: Tables) -> DataFrame:
    from .retrieval import index_of

    index = index_of(t)
    held = index.df.filter(F.col("term").isin("the", "and", "of", "de"))
    return held.crossJoin(F.broadcast(index.stats)).select("term", F.round(F.col("df") / F.col("n"), 6).alias("share"))


@query("g14_attribution_report", "SELECT page, max(ord) AS revid, count(*) AS units, coalesce((SELECT n_name FROM nation WHERE n_nationkey = max(ord) % 40), '?') AS editor FROM units GROUP BY page")
def g14(t: Tables) -> DataFrame:
    made = t.units.groupBy("page").agg(F.max("ord").alias("revid"), F.count("*").alias("units")).withColumn("k", (F.col("revid") % 40).cast("int"))
    named = made.join(t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), "k", "left")
    return named.select("page", "revid", "units", F.coalesce("n_name", F.lit("?")).alias("editor"))


@query("g15_residue", "SELECT pattern, count(*) FILTER (contains(html, pattern)) AS hits, count(*) AS total FROM pages, (SELECT unnest(['&amp;', '<!--', '{{']) AS pattern) GROUP BY 1")
def g15(t: Tables) -> DataFrame:
    patterns = ["&amp;", "<!--", "{{"]
    sums = t.pages.agg(F.count("*").alias("total"), *[F.sum(F.contains("html", F.lit(p)).cast("long")).alias(f"h{i}") for i, p in enumerate(patterns)])
    return sums.select("total", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"h{i}").alias("hits")) for i, p in enumerate(patterns)])).alias("x")).select("x.pattern", "x.hits", "total")


@query("g16_token_medians", "SELECT template, v[len(v) // 2 + 1] AS median FROM (SELECT template, list_sort(list(ceil(length(text) / 4.0)::BIGINT)) AS v FROM units GROUP BY template)")
def g16(t: Tables) -> DataFrame:
    from ..functions.text import token_estimate

    sized = t.units.select("template", token_estimate(F.col("text")).cast("long").alias("tokens"))
    return R.values_at(sized, ["template"], "tokens", {"median": R.upper_place}).drop("n")


@query("g17_dangling_links", "SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS link FROM pages) WHERE link NOT IN (SELECT lower(link) FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS link FROM pages))")
def g17(t: Tables) -> DataFrame:
    links = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("link"))
    return R.drop_matching(links.distinct(), links.select(F.lower("link").alias("link")), "link")


# The first half of the messages is accepted; what all of them measure is held against it, seeds by kind and authors by form.
@query(
    "g18_baseline",
    """WITH half AS (SELECT max(id) // 2 AS mark FROM message), rows_ AS (SELECT id, 'seeds' AS part, kind AS name FROM message UNION ALL SELECT id, 'identity', 'form:' || author % 4 FROM message WHERE kind <> 'view'),
    old AS (SELECT part, name, count(*) AS was FROM rows_, half WHERE id <= mark AND name <> 'click' GROUP BY 1, 2), new AS (SELECT part, name, count(*) AS n FROM rows_ WHERE name <> 'signup' GROUP BY 1, 2)
    SELECT part, name, coalesce(n, 0) AS n, was, CASE WHEN was IS NULL OR coalesce(n, 0) > was THEN 'low' ELSE 'high' END AS severity FROM new FULL JOIN old USING (part, name) WHERE was IS NULL OR coalesce(n, 0) <> was
    UNION ALL SELECT 'meta', 'watermark', max(id), (SELECT max(id) FROM message, half WHERE id <= mark AND kind <> 'click'), 'none' FROM message WHERE kind <> 'signup'""",
)
def g18(t: Tables) -> DataFrame:
    form = F.concat(F.lit("form:"), (F.col("author") % 4).cast("string"))
    measure = lambda df: G.measured(F.max("id"), seeds=df.withColumn("name", F.col("kind")), identity=t.message.filter(F.col("kind") != "view").withColumn("name", form))
    half = t.message.agg(F.expr("max(id) div 2")).first()[0]
    older = t.message.filter(F.col("id") <= half)
    path = scratch(t.spark, "baseline")
    first = G.measured(F.max("id"), seeds=older.filter("kind <> 'click'").withColumn("name", F.col("kind")), identity=older.filter("kind <> 'view'").withColumn("name", form))
    G.accept(first, path)
    now, was = measure(t.message.filter("kind <> 'signup'")), G.accepted(t.spark, path)
    marks = now.filter("part = 'meta'").join(was.filter("part = 'meta'").select("name", F.col("n").alias("was")), "name").select("part", "name", "n", "was", F.lit("none").alias("severity"))
    return G.against_baseline(now, was).unionByName(marks)
