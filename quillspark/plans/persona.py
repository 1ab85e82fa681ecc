"""Queries: persona material and the extension surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hooks as H
from ..operators import persona as P
from .core import Tables, query


def _items(t: Tables) -> DataFrame:
    return t.lines.select(F.col("speaker").alias("person"), (F.col("scene") * 1000 + F.col("seq")).alias("item"), "text", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))


@query("n01_material", "SELECT speaker AS person, count(*) AS items FROM (SELECT DISTINCT speaker, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) FROM lines) GROUP BY 1")
def n01(t: Tables) -> DataFrame:
    return P.words_once(_items(t), "person", "text", "item").groupBy("person").agg(F.count("*").alias("items"))


@query(
    "n02_budget",
    """WITH RECURSIVE i AS (SELECT scene AS person, seq, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY scene ORDER BY seq) AS rn FROM lines),
    f AS (SELECT DISTINCT person, 0::BIGINT AS rn, 300::BIGINT AS left_, NULL::BIGINT AS seq, false AS taken FROM i UNION ALL SELECT f.person, f.rn + 1, CASE WHEN i.tokens <= f.left_ THEN f.left_ - i.tokens ELSE f.left_ END, i.seq, i.tokens <= f.left_ FROM f JOIN i ON i.person = f.person AND i.rn = f.rn + 1)
    SELECT person, seq FROM f WHERE taken""",
)
def n02(t: Tables) -> DataFrame:
    items = t.lines.select(F.col("scene").alias("person"), "seq", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))
    return P.budget_fill(items, "person", ["seq"], "tokens", 300).select("person", "seq")


@query("n03_eligible", "SELECT p.person FROM persons p JOIN (SELECT person, count(*) AS n FROM attribution GROUP BY 1) a USING (person) WHERE n >= 60")
def n03(t: Tables) -> DataFrame:
    return P.eligible(t.persons, t.attribution, "person", 60).select("person")


@query("n04_gates", "SELECT scene, seq, concat_ws(',', CASE WHEN length(text) > 1600 THEN 'budget' END, CASE WHEN NOT contains(lower(text), lower(speaker)) THEN 'name' END) AS failed FROM lines WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")
def n04(t: Tables) -> DataFrame:
    made = t.lines.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("scene", "seq", P.gates(F.col("text"), F.col("speaker")).alias("f"))
    return made.select("scene", "seq", F.array_join("f", ",").alias("failed"))


@query("n05_stale", "WITH s AS (SELECT DISTINCT author AS person, kind AS item FROM message WHERE id < 400), n AS (SELECT DISTINCT author AS person, kind AS item FROM message WHERE id >= 300), g AS (SELECT person, count(*) AS gone FROM (SELECT * FROM s EXCEPT SELECT * FROM n) GROUP BY 1), w AS (SELECT person, count(*) AS grown FROM (SELECT * FROM n EXCEPT SELECT * FROM s) GROUP BY 1) SELECT person, coalesce(gone, 0) AS gone, coalesce(grown, 0) AS grown FROM g FULL OUTER JOIN w USING (person)")
def n05(t: Tables) -> DataFrame:
    made = t.message.select(F.col("author").alias("person"), F.col("kind").alias("item"), "id")
    return P.stale(made.filter("id < 400").select("person", "item").distinct(), made.filter("id >= 300").select("person", "item").distinct(), "person", "item")


@query("n06_rates", "SELECT quality AS status, count(*) AS n, round(avg(toxic), 6)::DOUBLE AS rate FROM labels GROUP BY quality")
def n06(t: Tables) -> DataFrame:
    return t.labels.groupBy(F.col("quality").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("rate"))


@query("o08_budget_sample")
def o08(t: Tables) -> DataFrame:
    items = t.lines.select(F.col("scene").alias("person"), "seq", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))
    return P.even_budget_sample(items, "person", "seq", "tokens", 200)


@query("o09_spread_pick")
def o09(t: Tables) -> DataFrame:
    items = t.message.select(F.col("author").alias("person"), "kind", "id")
    return P.spread_pick(items, "person", ["kind"], "id", 8)


@query("u01_page_parser", "SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages")
def u01(t: Tables) -> DataFrame:
    def parse(row: dict) -> list[dict]:
        return [{"page_id": row["page_id"], "paragraphs": row["html"].count("<p>")}]

    return H.parsed(t.pages.select("page_id", "html"), parse, "page_id long, paragraphs long")


@query("u03_followups", "WITH RECURSIVE f AS (SELECT c_custkey AS title FROM customer WHERE c_custkey < 3 UNION SELECT c.c_custkey FROM f JOIN customer c ON c.c_custkey = f.title * 2 OR c.c_custkey = f.title * 2 + 1) SELECT title FROM f")
def u03(t: Tables) -> DataFrame:
    start = t.customer.filter("c_custkey < 3").select(F.col("c_custkey").alias("title"))
    known = t.customer.select(F.col("c_custkey").alias("title"))
    return H.followed_up(start, lambda new: new.select(F.explode(F.array(F.col("title") * 2, F.col("title") * 2 + 1)).alias("title")), known)


@query("u07_figures", "SELECT 'attributed_units' AS figure, count(DISTINCT unit)::DOUBLE AS value, true AS ok FROM attribution UNION ALL SELECT 'spoken_lines', count(*)::DOUBLE, true FROM lines")
def u07(t: Tables) -> DataFrame:
    from .figures import figure_table

    return figure_table(t, {"attributed_units": ">= 0", "spoken_lines": ">= 0"})


@query("r03_tokeniser_fallback", "SELECT item_id, true AS fallback FROM benchmark")
def r03(t: Tables) -> DataFrame:
    """No dictionary segmenter is installed: its name is refused, and the bigram tokeniser stands in."""
    try:
        cut = H.tokeniser("dictionary+n1")
        fallback = False
    except ValueError:
        cut, fallback = H.tokeniser("bigram+n1"), True
    return t.benchmark.select("item_id", (F.lit(fallback) & (F.size(cut(F.col("text"))) > 0)).alias("fallback"))


@query("r26_refused_modes", "SELECT unnest(['dense', 'hybrid']) AS mode, true AS refused")
def r26(t: Tables) -> DataFrame:
    from ..operators import retrieval as R

    rows = []
    for mode in ("dense", "hybrid"):
        try:
            R.search(None, t.units, t.benchmark, mode=mode)
            rows.append((mode, False))
        except ValueError:
            rows.append((mode, True))
    return t.spark.createDataFrame(rows, "mode string, refused boolean")


# Two rows under a head; the brand spans both rows, the type two columns; a table within a cell, and a second one that isn't closed.
@query(
    "c03_table_grid",
    """WITH g AS (SELECT p_partkey AS id, unnest([{'t': 0, 'w': NULL, 'h': 1, 'g': [['make', 'kind', 'kind'], [p_brand, p_type, p_type], [p_brand, p_name, p_size::VARCHAR]]},
      {'t': 1, 'w': 0, 'h': 0, 'g': [['in ' || p_brand, p_type]]}, {'t': 2, 'w': NULL, 'h': 2, 'g': [[p_name], ['last']]}]) AS x FROM part),
    r AS (SELECT id, x, unnest(x.g) AS cells, generate_subscripts(x.g, 1) - 1 AS r FROM g)
    SELECT id, x.t AS tab, x.w AS within, x.h AS header_rows, r::INTEGER AS r, (generate_subscripts(cells, 1) - 1)::INTEGER AS c, unnest(cells) AS cell FROM r UNION ALL SELECT -page_id, 0, NULL, 0, 0, 0, 'no table' FROM pages""",
)
def c03(t: Tables) -> DataFrame:
    from ..operators import corpus as C

    def parse(row: dict) -> list[dict]:
        found = C.tables_of(row["html"]) or [C.Table(None, [[("no table", False)]])]
        return [
            {"id": row["id"], "tab": n, "within": x.within, "header_rows": x.header_rows(), "r": r, "c": c, "cell": cell}
            for n, x in enumerate(found) for r, cells in enumerate(x.grid) for c, (cell, _) in enumerate(cells)
        ]

    html = F.concat(
        F.lit("<p>before</p><table><tr><th>make</th><th colspan=2>kind</th></tr><tr><td rowspan='2'>"), "p_brand", F.lit("<table><td>in "), "p_brand", F.lit("<td>"), "p_type",
        F.lit('</table></td><td colspan="2"><b>'), "p_type", F.lit("</b></td></tr><TR><td>"), "p_name", F.lit("</td><td> "), "p_size", F.lit(" </td></TR></table><p>after</p><table><tr><th><!-- <td> -->"), "p_name",
        F.lit("<tr><th>last"),
    )
    every = t.part.select(F.col("p_partkey").alias("id"), html.alias("html")).unionByName(t.pages.select((-F.col("page_id")).alias("id"), "html"))
    return H.parsed(every, parse, "id long, tab int, within int, header_rows int, r int, c int, cell string")


@query("c06_definition_lists", "SELECT p_partkey, p_brand || ': ' || p_type || ', ' || p_name AS text FROM part")
def c06(t: Tables) -> DataFrame:
    from ..operators import corpus as C

    raw = F.concat(F.lit("<dl><dt>"), "p_brand", F.lit("</dt><dd>"), "p_type", F.lit("</dd><dd>"), "p_name", F.lit("</dd></dl>"))
    return t.part.select("p_partkey", C.definition_lists(raw).alias("text"))


@query("d07_seeded_pick", "SELECT channel, id FROM (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY md5('11|' || id), id) AS rn FROM message) WHERE rn <= 3")
def d07(t: Tables) -> DataFrame:
    from ..operators.relational import top_per_group

    return top_per_group(t.message, ["channel"], [F.md5(F.concat(F.lit("11|"), F.col("id").cast("string"))), "id"], 3).select("channel", "id")


@query("u02_pack_hooks", "SELECT p_partkey, upper(p_type) AS faction FROM part")
def u02(t: Tables) -> DataFrame:
    return H.Pack(faction=str.upper).apply(t.part, "faction", "p_type").select("p_partkey", "faction")


@query("u04_plugin_hooks", "SELECT p_partkey, p_name || '!' AS line FROM part")
def u04(t: Tables) -> DataFrame:
    def parse(row: dict) -> list[dict]:
        host = H.PluginHost()
        return [{"p_partkey": row["p_partkey"], "line": host.call("loud", lambda x: f"{x}!", host.call("broken", lambda x: x.no_such, row["p_name"]))}]

    return H.parsed(t.part.select("p_partkey", "p_name"), parse, "p_partkey long, line string")


@query("u05_plugin_manifest", "SELECT 'good' AS plugin, 50 AS timeout_ms UNION ALL SELECT 'Bad name', NULL")
def u05(t: Tables) -> DataFrame:
    rows = []
    for name in ("good", "Bad name"):
        try:
            rows.append((name, H.Plugin.parse({"name": name, "protocol": 1, "tools": ["a"], "timeout_ms": 3}).timeout_ms))
        except ValueError:
            rows.append((name, None))
    return t.spark.createDataFrame(rows, "plugin string, timeout_ms int")


@query("u06_tokeniser_dispatch", "SELECT p_partkey, lower(p_name) AS tokens FROM part")
def u06(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(H.tokeniser("latin+n1")(F.col("p_name")), " ").alias("tokens"))


@query("u08_topic_match", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')")
def u08(t: Tables) -> DataFrame:
    def match(name: str) -> str:
        return "yes" if "ring" in name else "no"

    return H.Pack(resolve=match).apply(t.part, "resolve", "p_name").filter("resolve = 'yes'").select("p_partkey")
