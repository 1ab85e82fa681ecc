"""Queries: retrieval, aliases, people. The benchmark's items are the queries, all in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.scratch import scratch, spread, stored, version
from .core import Tables, query
from .scalars import TOKENS

CTE = f"""tok AS (SELECT ord, unnest({TOKENS}) AS term FROM units), doclen AS (SELECT ord, len({TOKENS}) AS len FROM units),
postings AS (SELECT term, ord, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM doclen), qterm AS (SELECT item_id AS qid, unnest({TOKENS}) AS term FROM benchmark),
scored AS (SELECT qid, ord, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM qterm JOIN postings USING (term) JOIN df USING (term) JOIN doclen USING (ord), stats GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM scored) WHERE rank <= 50)"""


_INDEXES: dict[tuple, R.Index] = {}


def index_of(t: Tables) -> R.Index:
    """The stored index of the folder's documents: built once a session, and anew when the files change."""
    key = (t.spark.sparkContext.applicationId, t.folder, version(t.spark, f"{t.folder}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = R.build_index(spread(t.documents.select("doc_id", "text")), "doc_id", folder=scratch(t.spark, "index"))
    return _INDEXES[key]


def terms_of(t: Tables) -> DataFrame:
    return R.query_terms(t.benchmark, "item_id", "text")


def hits_of(t: Tables, k: int = 50) -> DataFrame:
    """The first k hits of every item, stored: what follows joins them by their size and reads them as often as it likes."""
    return stored(R.top_hits(R.bm25(index_of(t), terms_of(t)), k), "hits")


@query("r06_postings", f"WITH {CTE} SELECT term, ord, tf FROM postings")
def r06(t: Tables) -> DataFrame:
    return index_of(t).postings.select("term", "ord", "tf")


@query("r07_bm25", f"WITH {CTE} SELECT qid, ord, score, rank FROM hits WHERE rank <= 10")
def r07(t: Tables) -> DataFrame:
    return hits_of(t, 10)


@query("r08_document_frequency", f"WITH {CTE} SELECT term, df FROM df")
def r08(t: Tables) -> DataFrame:
    return index_of(t).df


@query("r09_corpus_stats", f"WITH {CTE} SELECT n, round(avg_len, 6)::DOUBLE AS avg_len FROM stats")
def r09(t: Tables) -> DataFrame:
    return index_of(t).stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(
    "r10_memories",
    f"""WITH {CTE}, mem AS (SELECT scene * 1000 + seq AS mid, {TOKENS} AS v FROM lines), mtf AS (SELECT mid, len, term, count(*) AS tf FROM (SELECT mid, len(v) AS len, unnest(v) AS term FROM mem) GROUP BY ALL),
    m AS (SELECT qid, mid, round(sum(greatest(ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM qterm LEFT JOIN df USING (term) JOIN mtf USING (term), stats GROUP BY 1, 2)
    SELECT qid, mid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) AS rn FROM m WHERE score > 0) WHERE rn <= 5""",
)
def r10(t: Tables) -> DataFrame:
    memories = t.lines.select((F.col("scene") * 1000 + F.col("seq")).alias("mid"), "text")
    found = R.score_memories(index_of(t), terms_of(t), memories, "mid", "text")
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "mid"))
    return found.withColumn("rn", rn).filter("rn <= 5").select("qid", "mid", "score")


def aliases_of(t: Tables) -> DataFrame:
    """Aliases: the first word of a part's name stands for its second words."""
    words = F.split("p_name", " ")
    return t.part.select(F.get(words, F.lit(0)).alias("alias"), F.get(words, F.lit(1)).alias("target")).distinct()


_ALIASES = "SELECT DISTINCT split_part(p_name, ' ', 1) AS alias, split_part(p_name, ' ', 2) AS target FROM part"


@query("r11_alias_targets", f"SELECT lower(alias) AS alias, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets, CASE WHEN count(DISTINCT target) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM ({_ALIASES}) GROUP BY 1")
def r11(t: Tables) -> DataFrame:
    return R.alias_targets(aliases_of(t)).select("alias", F.array_join("targets", ",").alias("targets"), "state")


@query("r12_alias_qualified", "SELECT p_partkey AS qid, split_part(p_name, ' ', 1) AS alias, split_part(p_name, ' ', 2) AS target FROM part WHERE split_part(p_name, ' ', 1) IN (SELECT alias FROM (" + _ALIASES + ") GROUP BY 1 HAVING count(DISTINCT target) > 1)")
def r12(t: Tables) -> DataFrame:
    return R.resolve_qualified(t.part.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text")), aliases_of(t))


# Every third text holds the alias glued to a letter, every third one two aliases: neither resolves.
@query("r13_alias_inside", "SELECT p_partkey AS qid, p_brand AS target FROM part WHERE p_partkey % 3 = 2")
def r13(t: Tables) -> DataFrame:
    exact = t.part.select(F.col("p_brand").alias("alias"), F.col("p_brand").alias("target")).distinct()
    exact = exact.unionByName(t.spark.createDataFrame([("second one", "other")], "alias string, target string"))
    kind = F.col("p_partkey") % 3
    before = F.when(kind == 0, "of x").when(kind == 1, "the second one of ").otherwise("of ")
    queries = spread(t.part.select("p_partkey", "p_brand", "p_name")).select(F.col("p_partkey").alias("qid"), F.concat(before, "p_brand", F.lit(", a "), "p_name").alias("text"))
    return R.resolve_inside(queries, exact)


@query("r14_expansion", "SELECT p_partkey AS qid, p_brand || CASE WHEN count(DISTINCT p_type) OVER (PARTITION BY p_brand) = 1 THEN ' ' || p_type ELSE '' END AS text FROM part")
def r14(t: Tables) -> DataFrame:
    aliases = t.part.select(F.col("p_brand").alias("alias"), F.col("p_type").alias("target")).distinct()
    queries = t.part.select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("text"))
    whole = R.resolve_whole(queries, aliases).filter("state = 'resolved'").select("qid", F.col("targets")[0].alias("target"))
    return R.expanded(queries, whole).select("qid", "text")


def person_queries(t: Tables) -> DataFrame:
    """Each item asked as a person."""
    n = t.persons.count()
    return t.benchmark.select(F.col("item_id").alias("qid"), "text", (F.col("item_id") % n).alias("person"))


def scope_rows(t: Tables) -> DataFrame:
    """Knowledge scope: lived through shared positions, known through the page's person."""
    lived = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("unit"), ((F.col("l_suppkey") + 1) % 7).alias("person"), F.lit("lived").alias("kind"))
    known = t.units.select(F.col("ord").alias("unit"), (F.col("ord") % 5).alias("person"), F.lit("self").alias("kind"))
    return lived.unionByName(known).distinct()


_SCOPE = """scope AS (SELECT DISTINCT * FROM (SELECT l_orderkey AS unit, (l_suppkey + 1) % 7 AS person, 'lived' AS kind FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT ord, ord % 5, 'self' FROM units)),
asked AS (SELECT item_id AS qid, item_id % (SELECT count(*) FROM persons) AS person FROM benchmark),
placed AS (SELECT h.*, a.person, u.template, CASE WHEN EXISTS (SELECT 1 FROM attribution o WHERE o.unit = h.ord AND o.person = a.person) THEN 'own'
  WHEN EXISTS (SELECT 1 FROM scope s WHERE s.unit = h.ord AND s.person = a.person AND s.kind = 'lived') THEN 'lived'
  WHEN EXISTS (SELECT 1 FROM scope s WHERE s.unit = h.ord AND s.person = a.person) THEN 'in_scope' ELSE 'out_of_scope' END AS source FROM hits h JOIN asked a USING (qid) JOIN units u USING (ord)),
weighed AS (SELECT *, score * CASE source WHEN 'own' THEN 1.5e0 WHEN 'lived' THEN 1.3e0 WHEN 'in_scope' THEN 1.2e0 ELSE 1e0 END * CASE template WHEN 'en' THEN 0.85e0 WHEN 'fr' THEN 1.1e0 ELSE 1e0 END AS weighted FROM placed),
cut AS (SELECT *, max(weighted) OVER (PARTITION BY qid) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, score DESC, ord) AS place FROM weighed) WHERE place <= 6),
ranked AS (SELECT * FROM cut WHERE weighted >= best * 0.55e0)"""

KINDS = {"en": 0.85, "fr": 1.1}


def _placed(t: Tables) -> DataFrame:
    hits = hits_of(t).join(person_queries(t).select("qid", "person"), "qid").join(t.units.select("ord", "template"), "ord")
    return R.scope_of(hits, F.col("person"), t.attribution, scope_rows(t))


@query("r15_scope", f"WITH {CTE}, {_SCOPE} SELECT qid, ord, person, source FROM placed")
def r15(t: Tables) -> DataFrame:
    return _placed(t).select("qid", "ord", "person", "source")


@query("r16_weights", f"WITH {CTE}, {_SCOPE} SELECT qid, ord, weighted FROM weighed")
def r16(t: Tables) -> DataFrame:
    return R.weighted(_placed(t), R.Weights(), KINDS).select("qid", "ord", "weighted")


@query("r17_shown", f"WITH {CTE}, {_SCOPE} SELECT qid, ord, score * CASE source WHEN 'own' THEN 1.5e0 WHEN 'lived' THEN 1.3e0 WHEN 'in_scope' THEN 1.2e0 ELSE 1e0 END * CASE WHEN ord % 3 = 0 THEN 0.5e0 ELSE 1e0 END AS weighted FROM placed")
def r17(t: Tables) -> DataFrame:
    return R.weighted(_placed(t), R.Weights(), {}, F.col("ord") % 3 == 0).select("qid", "ord", "weighted")


_CONFIDENCE = """e AS (SELECT qid, score, max(score) OVER (PARTITION BY qid) AS top1, count(*) OVER (PARTITION BY qid) AS n FROM hits WHERE rank <= 6 AND score > 0),
p AS (SELECT qid, top1, n, exp(score - top1) / sum(exp(score - top1)) OVER (PARTITION BY qid) AS p FROM e),
conf AS (SELECT qid, top1, round(CASE WHEN max(n) < 2 THEN 0 ELSE sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(max(n)) END, 6)::DOUBLE AS entropy FROM p GROUP BY 1, 2),
levels AS (SELECT *, CASE WHEN top1 < 11.068 OR entropy > 0.307 THEN 'low' WHEN top1 >= 11.068 AND entropy <= 0.184 THEN 'high' ELSE 'medium' END AS level FROM conf)"""


@query("r18_confidence", f"WITH {CTE}, {_CONFIDENCE} SELECT qid, top1, entropy, level FROM levels")
def r18(t: Tables) -> DataFrame:
    return R.confidence(hits_of(t), R.Bands(), 6)


@query("r19_excluded", f"WITH {CTE} SELECT qid, ord, ord % 3 = 0 AS excluded FROM hits WHERE rank <= 6")
def r19(t: Tables) -> DataFrame:
    return hits_of(t, 6).select("qid", "ord", (F.col("ord") % 3 == 0).alias("excluded"))


_POS = "pos AS (SELECT ord, page, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS pos FROM units)"
_NEAR = f"""{_POS}, strong AS (SELECT qid, ord FROM (SELECT *, max(weighted) OVER (PARTITION BY qid) AS top FROM ranked) WHERE weighted >= top * 0.85e0),
near AS (SELECT DISTINCT s.qid, b.ord FROM strong s JOIN pos a USING (ord) JOIN pos b ON b.page = a.page AND abs(b.pos - a.pos) <= 1 AND b.ord <> a.ord WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.qid = s.qid AND r.ord = b.ord))"""


def positions(t: Tables) -> DataFrame:
    return t.units.select("ord", "page").withColumn("pos", (F.row_number().over(Window.partitionBy("page").orderBy("ord")) - 1).cast("long"))


@query("r20_neighbours", f"WITH {CTE}, {_SCOPE}, {_NEAR} SELECT qid, ord FROM near")
def r20(t: Tables) -> DataFrame:
    w = R.Weights()
    return R.neighbour_units(R.ranked(R.weighted(_placed(t), w, KINDS), w), positions(t), w)


_PEOPLE = """shared AS (SELECT unit, count(*) AS attributed FROM attribution GROUP BY 1),
fits AS (SELECT qid, ord, person, attributed, score / (1 + 0.5e0 * (attributed - 1)) AS fit FROM hits JOIN attribution ON ord = unit JOIN shared USING (unit) {where}),
best AS (SELECT qid, person, ord, fit, count(*) OVER w AS matched, (sum((attributed <= 2)::INT) OVER w)::BIGINT AS specific, row_number() OVER (PARTITION BY qid, person ORDER BY fit DESC, ord) AS rn FROM fits WINDOW w AS (PARTITION BY qid, person)),
people AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fit DESC, ord, person) AS place FROM best WHERE rn = 1) WHERE place <= {limit})"""


@query("r21_find_people", f"WITH {CTE}, {_PEOPLE.format(where='', limit=8)} SELECT qid, person, ord, fit, matched, specific, place FROM people")
def r21(t: Tables) -> DataFrame:
    return R.people(hits_of(t), t.attribution, R.People())


@query("r22_crowd_discount", f"WITH {CTE}, {_PEOPLE.format(where='', limit=8)} SELECT qid, ord, person, fit FROM fits")
def r22(t: Tables) -> DataFrame:
    hits = hits_of(t)
    attribution = R.of_hits(t.attribution, hits)
    shared = attribution.groupBy("unit").agg(F.count("*").alias("attributed"))
    own = attribution.join(shared, "unit").withColumnRenamed("unit", "ord")
    return hits.join(own, "ord").select("qid", "ord", "person", (F.col("score") / (1 + 0.5 * (F.col("attributed") - 1))).alias("fit"))


_RECOMMEND = """held AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rn, lead(fit) OVER (PARTITION BY qid ORDER BY place) AS nx FROM people WHERE matched > 1 OR specific > 0),
falls AS (SELECT *, CASE WHEN rn < 6 AND nx IS NOT NULL AND fit > 0 THEN (fit - nx) / fit ELSE 0.0 END AS fall FROM held),
cuts AS (SELECT qid, max(fall) AS f, arg_max(rn, struct_pack(f := fall, r := -rn)) AS r, count(*) AS n FROM falls GROUP BY 1),
sized AS (SELECT qid, f < 0.12 AS flat, CASE WHEN f >= 0.12 THEN r WHEN n < 2 THEN n ELSE 3 END AS size FROM cuts)"""


@query("r23_recommend", f"WITH {CTE}, {_PEOPLE.format(where='', limit=8)}, {_RECOMMEND} SELECT qid, person, ord, fit, place, flat AND size > 1 AS plateau FROM falls JOIN sized USING (qid) WHERE rn <= size")
def r23(t: Tables) -> DataFrame:
    return R.recommended(R.people(hits_of(t), t.attribution, R.People()), R.People())


@query("r24_rank_participants", f"WITH {CTE}, {_PEOPLE.format(where='WHERE person IN (1, 2, 3, 5)', limit=4)} SELECT qid, person, fit, place FROM people")
def r24(t: Tables) -> DataFrame:
    group = t.spark.createDataFrame([(1,), (2,), (3,), (5,)], "person long")
    return R.people(hits_of(t), t.attribution, R.People(), scope=F.broadcast(group), limit=4).select("qid", "person", "fit", "place")


@query("r25_search", f"WITH {CTE}, {_SCOPE}, {_CONFIDENCE} SELECT qid, place, ord, source, score, weighted, levels.top1, levels.entropy, levels.level FROM ranked JOIN levels USING (qid)")
def r25(t: Tables) -> DataFrame:
    return R.search(index_of(t), t.units, person_queries(t), person=True, attribution=t.attribution, scope=scope_rows(t), kinds=KINDS)


@query("r27_get_with_neighbours", f"WITH {_POS} SELECT b.ord, b.page, b.pos FROM pos a JOIN pos b ON a.page = b.page AND abs(a.pos - b.pos) <= 2 WHERE a.ord = 40")
def r27(t: Tables) -> DataFrame:
    own = positions(t)
    at = own.filter("ord = 40").select("page", F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("pos"))
    return own.join(F.broadcast(at), ["page", "pos"]).select("ord", "page", "pos")


@query("r28_low_cut", f"WITH {CTE}, {_CONFIDENCE} SELECT qid, ord, rank FROM hits JOIN levels USING (qid) WHERE rank <= CASE WHEN level = 'low' THEN 2 ELSE 6 END")
def r28(t: Tables) -> DataFrame:
    hits = hits_of(t)
    level = R.confidence(hits, R.Bands(), 6)
    return hits.join(level, "qid").filter(F.col("rank") <= F.when(F.col("level") == "low", 2).otherwise(6)).select("qid", "ord", "rank")


@query("d17_library_window", f"WITH {CTE} SELECT qid, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rn FROM scored) WHERE rn <= 90")
def d17(t: Tables) -> DataFrame:
    return hits_of(t, 90).select("qid", "ord", "score")


@query("d14_topic_overlap", f"WITH {CTE} SELECT a.qid AS one, b.qid AS other, count(*) AS shared FROM hits a JOIN hits b ON a.ord = b.ord AND a.qid < b.qid WHERE a.rank <= 6 AND b.rank <= 6 GROUP BY 1, 2")
def d14(t: Tables) -> DataFrame:
    hits = hits_of(t, 6)
    a, b = hits.select("ord", F.col("qid").alias("one")), hits.select("ord", F.col("qid").alias("other"))
    return a.join(b, "ord").filter("one < other").groupBy("one", "other").agg(F.count("*").alias("shared"))


@query("d12_topic_people", f"WITH {CTE}, {_PEOPLE.format(where='WHERE person % 2 = 0 AND person NOT IN (4)', limit=8)} SELECT qid, person, fit, place FROM people")
def d12(t: Tables) -> DataFrame:
    scope = t.persons.filter("person % 2 = 0")
    return R.people(hits_of(t), t.attribution, R.People(), scope=scope, exclude=t.persons.filter("person = 4")).select("qid", "person", "fit", "place")


@query("d15_interject", f"WITH {CTE}, {_PEOPLE.format(where='', limit=8)} SELECT qid, person, fit FROM people WHERE place = 1 AND fit >= 11.068e0 * 0.8e0")
def d15(t: Tables) -> DataFrame:
    found = R.people(hits_of(t), t.attribution, R.People())
    return found.filter((F.col("place") == 1) & (F.col("fit") >= R.Bands().high_top1 * 0.8)).select("qid", "person", "fit")
