"""Queries: evaluation. Gold is the documents that hold a benchmark item whole; items without gold are not scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators.contain import contained_in
from ..sources.scratch import stored
from .core import Tables, query
from .retrieval import CTE, hits_of, index_of
from .scalars import TOKENS

GOLD = """gold0 AS (SELECT b.item_id AS qid, d.doc_id AS ord, d.lang, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gold AS (SELECT qid, ord, source, CASE WHEN lang = 'en' THEN 2 WHEN max((lang = 'en')::INT) OVER (PARTITION BY qid) = 0 AND row_number() OVER (PARTITION BY qid ORDER BY ord) <= 3 THEN 2 ELSE 1 END AS grade FROM gold0),
neg AS (SELECT qid, ord FROM (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY ord) AS rn FROM (SELECT DISTINCT g.qid, d.doc_id AS ord FROM gold g JOIN documents d ON d.source = g.source WHERE NOT EXISTS (SELECT 1 FROM gold x WHERE x.qid = g.qid AND x.ord = d.doc_id))) WHERE rn <= 64)"""
SCORES = """ideal AS (SELECT qid, sum(CASE WHEN i < 10 THEN (pow(2, grade) - 1) / log2(i + 2) ELSE 0 END) AS idcg, count(*) AS n_gold FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, ord) - 1 AS i FROM gold) GROUP BY 1),
per AS (SELECT h.qid, sum(CASE WHEN g.grade IS NOT NULL THEN (pow(2, g.grade) - 1) / log2(h.rank + 1) ELSE 0 END) AS dcg, count(g.grade) AS found, min(CASE WHEN g.grade IS NOT NULL THEN h.rank END) AS first_gold, min(CASE WHEN n.ord IS NOT NULL THEN h.rank END) AS first_negative
  FROM hits h LEFT JOIN gold g ON g.qid = h.qid AND g.ord = h.ord LEFT JOIN neg n ON n.qid = h.qid AND n.ord = h.ord WHERE h.rank <= 10 GROUP BY 1),
scores AS (SELECT qid, round(coalesce(dcg, 0) / idcg, 6)::DOUBLE AS ndcg, round(coalesce(found, 0) / 10.0, 6)::DOUBLE AS precision, round(coalesce(found, 0) / n_gold, 6)::DOUBLE AS recall, round(coalesce(1.0 / first_gold, 0), 6)::DOUBLE AS rr,
  dcg IS NULL AS empty, coalesce(first_negative < coalesce(first_gold, 1 << 30), false) AS negative_won, first_gold, first_negative, 'f' || qid % 3 AS family FROM ideal LEFT JOIN per USING (qid))"""
ALL = f"{CTE}, {GOLD}, {SCORES}"


def gold_of(t: Tables) -> DataFrame:
    held = contained_in(t.benchmark, "item_id", "text", t.dealt_documents, "doc_id", "text").toDF("qid", "ord")
    named = held.join(t.documents.select(F.col("doc_id").alias("ord"), "lang", "source"), "ord")
    return stored(E.graded(named, F.col("lang") == "en").select("qid", "ord", "source", "grade"), "gold")


def negatives_of(t: Tables, gold: DataFrame) -> DataFrame:
    siblings = E.sibling_units(gold, t.documents.select(F.col("doc_id").alias("ord"), "source"))
    return stored(E.hard_negatives(siblings, gold), "negatives")


def scores_of(t: Tables, hits: DataFrame | None = None) -> DataFrame:
    gold = gold_of(t)
    made = E.scores(hits_of(t, 10) if hits is None else hits, gold, negatives_of(t, gold), 10)
    return made.withColumn("family", F.concat(F.lit("f"), F.col("qid") % 3))


@query("e01_alias_suite", "SELECT p_brand AS text, 'f' || count(DISTINCT p_type) % 3 AS family, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS gold FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def e01(t: Tables) -> DataFrame:
    both = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"))
    made = both.groupBy(F.col("p_brand").alias("text")).agg(F.countDistinct("p_type").alias("n"), F.array_sort(F.collect_set("l_suppkey")).alias("g"))
    return made.select("text", F.concat(F.lit("f"), F.col("n") % 3).alias("family"), F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("gold"))


@query("e02_grades", f"WITH {GOLD} SELECT qid, ord, grade FROM gold")
def e02(t: Tables) -> DataFrame:
    return gold_of(t).select("qid", "ord", "grade")


@query(
    "e03_fallback",
    """WITH targets AS (SELECT DISTINCT c_custkey AS target FROM customer), a AS (SELECT o_custkey AS target, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS target, o_orderkey AS ord FROM orders)
    SELECT target, ord, 0 AS level FROM a UNION ALL SELECT target, ord, 1 FROM b WHERE target NOT IN (SELECT target FROM a) UNION ALL SELECT target, -target, 2 FROM targets WHERE target NOT IN (SELECT target FROM b)""",
)
def e03(t: Tables) -> DataFrame:
    targets = t.customer.select(F.col("c_custkey").alias("target"))
    every = t.orders.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return E.first_non_empty(targets, every.filter("o_orderstatus = 'F'"), every, targets.withColumn("ord", -F.col("target")))


@query("e04_hard_negatives", f"WITH {GOLD} SELECT qid, ord FROM neg")
def e04(t: Tables) -> DataFrame:
    return negatives_of(t, gold_of(t))


@query("e05_section_family", "SELECT source || ' > ' || lang AS path, count(*) AS gold, (SELECT count(*) FROM documents o WHERE o.source = d.source) - count(*) AS negatives FROM documents d GROUP BY source, lang")
def e05(t: Tables) -> DataFrame:
    sections = t.documents.groupBy("source", "lang").agg(F.count("*").alias("gold"))
    total = F.sum("gold").over(Window.partitionBy("source"))
    return sections.withColumn("negatives", total - F.col("gold")).select(F.concat_ws(" > ", "source", "lang").alias("path"), "gold", "negatives")


@query("e06_voice_family", "SELECT scene, seq, speaker || ' ' || seq AS text, count(*) OVER (PARTITION BY scene, speaker) - 1 AS negatives FROM lines")
def e06(t: Tables) -> DataFrame:
    others = F.count("*").over(Window.partitionBy("scene", "speaker")) - 1
    return t.lines.select("scene", "seq", F.concat_ws(" ", "speaker", "seq").alias("text"), others.alias("negatives"))


@query("e07_stratum", "SELECT item_id AS qid, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) THEN 'verbatim' ELSE 'paraphrase' END AS stratum FROM benchmark b")
def e07(t: Tables) -> DataFrame:
    held = contained_in(t.benchmark, "item_id", "text", t.dealt_documents, "doc_id", "text").select("item_id").distinct().withColumn("in", F.lit(1))
    return t.benchmark.join(held, "item_id", "left").select(F.col("item_id").alias("qid"), F.when(F.col("in") == 1, "verbatim").otherwise("paraphrase").alias("stratum"))


@query("e08_ndcg", f"WITH {ALL} SELECT qid, ndcg FROM scores")
def e08(t: Tables) -> DataFrame:
    return scores_of(t).select("qid", "ndcg")


@query("e09_precision_recall", f"WITH {ALL} SELECT qid, precision, recall, rr, empty FROM scores")
def e09(t: Tables) -> DataFrame:
    return scores_of(t).select("qid", "precision", "recall", "rr", "empty")


@query("e10_negative_won", f"WITH {ALL} SELECT qid, first_gold, first_negative, negative_won FROM scores")
def e10(t: Tables) -> DataFrame:
    return scores_of(t).select("qid", "first_gold", "first_negative", "negative_won")


@query("e11_by_family", f"WITH {ALL} SELECT family, qid % 2 AS stratum, count(*) AS n, round(avg(ndcg), 6)::DOUBLE AS ndcg, round(avg(rr), 6)::DOUBLE AS mrr FROM scores GROUP BY 1, 2")
def e11(t: Tables) -> DataFrame:
    return scores_of(t).groupBy("family", (F.col("qid") % 2).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("e12_macro", f"WITH {ALL} SELECT round(avg(m), 6)::DOUBLE AS macro FROM (SELECT family, avg(ndcg) AS m FROM scores GROUP BY 1)")
def e12(t: Tables) -> DataFrame:
    from ..operators.relational import macro_average

    return macro_average(scores_of(t), "family", "ndcg")


#: What the alias stage may do to a query: nothing, put the resolved target behind it, or also keep the person's units only.
ALIAS_MODES = ["off", "expand", "expand and filter"]

_WORDS = f"SELECT item_id AS qid, {TOKENS} AS w, item_id % (SELECT count(*) FROM persons) AS person FROM benchmark"
_MODES = f"""asks AS (SELECT qid, array_to_string(w[1:2], ' ') AS text, w[3] AS target, person FROM ({_WORDS})),
aliases AS (SELECT text AS alias, min(target) AS target FROM asks WHERE target IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target) = 1),
modes AS (SELECT qid, person, mode, CASE WHEN mode > 0 AND a.target IS NOT NULL THEN text || ' ' || a.target ELSE text END AS text, mode = 2 AND a.target IS NOT NULL AS strict FROM asks LEFT JOIN aliases a ON a.alias = asks.text, (SELECT unnest([0, 1, 2]) AS mode)),
mterm AS (SELECT qid, mode, unnest(regexp_split_to_array(text, ' ')) AS term FROM modes WHERE text <> ''),
mscored AS (SELECT qid, mode, ord, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM mterm JOIN postings USING (term) JOIN df USING (term) JOIN doclen USING (ord), stats GROUP BY ALL),
mhits AS (SELECT qid, mode, ord, row_number() OVER (PARTITION BY qid, mode ORDER BY score DESC, ord) AS rank FROM mscored JOIN modes m USING (qid, mode) WHERE NOT strict OR EXISTS (SELECT 1 FROM attribution o WHERE o.unit = ord AND o.person = m.person)),
mper AS (SELECT qid, mode, sum(CASE WHEN g.grade IS NOT NULL THEN (pow(2, g.grade) - 1) / log2(h.rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN g.grade IS NOT NULL THEN h.rank END) AS first_gold FROM mhits h LEFT JOIN gold g USING (qid, ord) WHERE h.rank <= 10 GROUP BY 1, 2),
mscores AS (SELECT qid, mode, round(coalesce(dcg, 0) / idcg, 6)::DOUBLE AS ndcg, round(coalesce(1.0 / mper.first_gold, 0), 6)::DOUBLE AS rr FROM ideal CROSS JOIN (SELECT unnest([0, 1, 2]) AS mode) LEFT JOIN mper USING (qid, mode))"""


def _mode_scores(t: Tables) -> DataFrame:
    """``qid, mode, ndcg, rr`` of the same queries under each alias mode, all in one plan (a mode is a query of its own)."""
    n = t.persons.count()
    w = tokens(F.col("text"))
    asks = t.benchmark.select(F.col("item_id").alias("qid"), F.array_join(F.slice(w, 1, 2), " ").alias("text"), F.get(w, F.lit(2)).alias("target"), (F.col("item_id") % n).alias("person"))
    aliases = asks.filter("target is not null").select(F.col("text").alias("alias"), "target").distinct()
    found = R.resolve_whole(asks.select("qid", "text"), aliases).filter("state = 'resolved'").select("qid", F.col("targets")[0].alias("target"))
    modes = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("mode")
    own = R.expanded(asks.drop("target"), found).join(asks.select("qid", F.col("text").alias("plain")), "qid").select("qid", "person", "plain", "text", "target", modes)
    own = own.select((F.col("qid") * 3 + F.col("mode")).alias("qid"), "person", F.when(F.col("mode") == 0, F.col("plain")).otherwise(F.col("text")).alias("text"), ((F.col("mode") == 2) & F.col("target").isNotNull()).alias("only"))
    scored = R.bm25(index_of(t), R.query_terms(own, "qid", "text"))
    mine = t.attribution.select(F.col("unit").alias("ord"), "person", F.lit(True).alias("mine"))
    kept = scored.join(own.select("qid", "person", "only"), "qid").join(mine, ["ord", "person"], "left").filter("not only or mine").select("qid", "ord", "score")
    gold = gold_of(t)
    for_modes = gold.select("qid", modes, "ord", "grade").select((F.col("qid") * 3 + F.col("mode")).alias("qid"), "ord", "grade")
    made = E.scores(R.top_hits(kept, 10), for_modes, for_modes.limit(0).select("qid", "ord"), 10)
    return made.select(F.expr("qid div 3").alias("qid"), (F.col("qid") % 3).cast("int").alias("mode"), "ndcg", "rr")


@query(
    "e13_bootstrap",
    f"""WITH {ALL}, {_MODES}, d AS (SELECT a.qid, b.ndcg - a.ndcg AS d, row_number() OVER (ORDER BY a.qid) - 1 AS place, count(*) OVER () AS n, avg(b.ndcg - a.ndcg) OVER () AS mean FROM mscores a JOIN mscores b USING (qid) WHERE a.mode = 0 AND b.mode = 2),
    draws AS (SELECT r, ('0x' || substr(md5('1.' || r || '.' || j), 1, 15))::BIGINT % n AS place FROM range(500) x(r), (SELECT unnest(range(n)) AS j, n FROM (SELECT DISTINCT n FROM d))),
    m AS (SELECT r, sum(d) / any_value(n) - any_value(mean) AS m, any_value(mean) AS mean FROM draws JOIN d USING (place) GROUP BY r)
    SELECT (SELECT count(*) FROM d) AS queries, round((sum((abs(round(m, 9)) >= abs(round(mean, 9)))::INT) + 1) / 501.0, 6)::DOUBLE AS p FROM m""",
)
def e13(t: Tables) -> DataFrame:
    scored = _mode_scores(t).filter("mode <> 1").groupBy("qid").agg(F.max(F.when(F.col("mode") == 0, F.col("ndcg"))).alias("before"), F.max(F.when(F.col("mode") == 2, F.col("ndcg"))).alias("after"))
    return E.paired_bootstrap(scored, 500)


def _samples(t: Tables) -> DataFrame:
    hits = hits_of(t)
    level = R.confidence(hits, R.Bands(), 6)
    made = scores_of(t, hits).join(level, "qid").select("qid", "family", "top1", "entropy", (F.col("first_gold") == 1).alias("answered"), "level")
    return stored(made.na.fill({"answered": False}), "samples")


@query("e14_calibration")
def e14(t: Tables) -> DataFrame:
    bands = E.calibrate(_samples(t)) or {}
    return t.spark.createDataFrame(sorted(bands.items()), "key string, value double")


_LEVELS = """e AS (SELECT qid, score, max(score) OVER (PARTITION BY qid) AS top1, count(*) OVER (PARTITION BY qid) AS n FROM hits WHERE rank <= 6 AND score > 0),
p AS (SELECT qid, top1, n, exp(score - top1) / sum(exp(score - top1)) OVER (PARTITION BY qid) AS p FROM e),
conf AS (SELECT qid, top1, round(CASE WHEN max(n) < 2 THEN 0 ELSE sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(max(n)) END, 6)::DOUBLE AS entropy FROM p GROUP BY 1, 2),
samples AS (SELECT scores.*, CASE WHEN top1 < 11.068 OR entropy > 0.307 THEN 'low' WHEN entropy <= 0.184 THEN 'high' ELSE 'medium' END AS level, coalesce(first_gold = 1, false) AS answered FROM scores JOIN conf USING (qid))"""


@query(
    "e15_assess",
    f"WITH {ALL}, {_LEVELS}, w AS (SELECT *, 1e0 / (count(*) OVER (PARTITION BY family) * (SELECT count(DISTINCT family) FROM samples)) AS weight FROM samples) SELECT level, round(sum(weight), 6)::DOUBLE AS share, round(sum(CASE WHEN answered THEN weight ELSE 0 END) / sum(weight), 6)::DOUBLE AS answered FROM w GROUP BY 1",
)
def e15(t: Tables) -> DataFrame:
    return E.assess(_samples(t))


@query("e16_failures", f"WITH {ALL} SELECT s.qid, s.first_negative, s.first_gold, (SELECT string_agg(h.ord::VARCHAR, ',' ORDER BY h.rank) FROM hits h WHERE h.qid = s.qid AND h.rank <= 10) AS ranked FROM (SELECT * FROM scores WHERE negative_won ORDER BY qid LIMIT 20) s")
def e16(t: Tables) -> DataFrame:
    hits = hits_of(t, 10)
    return E.failures(scores_of(t, hits), hits, 20)


@query(
    "e17_ablation",
    f"WITH {ALL}, {_MODES} SELECT CASE mode WHEN 0 THEN 'off' WHEN 1 THEN 'expand' ELSE 'expand and filter' END AS alias_mode, 'f' || qid % 3 AS family, count(*) AS n, round(avg(ndcg), 6)::DOUBLE AS ndcg, round(avg(rr), 6)::DOUBLE AS mrr FROM mscores GROUP BY 1, 2",
)
def e17(t: Tables) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(m) for m in ALIAS_MODES]), F.col("mode") + 1).alias("alias_mode")
    per = _mode_scores(t).groupBy(named, F.concat(F.lit("f"), F.col("qid") % 3).alias("family"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(
    "e18_report_keys",
    f"WITH {ALL}, f AS (SELECT family, count(*)::DOUBLE AS questions, round(avg(ndcg), 6)::DOUBLE AS ndcg, round(avg(negative_won::INT), 6)::DOUBLE AS negwin FROM scores GROUP BY 1) SELECT 'eval.family.' || family || '.' || k AS key, CASE k WHEN 'questions' THEN questions WHEN 'ndcg' THEN ndcg ELSE negwin END AS value FROM f, (SELECT unnest(['questions', 'ndcg', 'negwin']) AS k) UNION ALL SELECT 'eval.questions', count(*)::DOUBLE FROM scores",
)
def e18(t: Tables) -> DataFrame:
    scored = stored(scores_of(t), "scores")
    per = scored.groupBy("family").agg(F.count("*").cast("double").alias("questions"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(F.col("negative_won").cast("int")), 6).alias("negwin"))
    long = per.unpivot(["family"], ["questions", "ndcg", "negwin"], "k", "value").select(F.concat(F.lit("eval.family."), "family", F.lit("."), "k").alias("key"), "value")
    return long.unionByName(scored.agg(F.count("*").cast("double").alias("value")).select(F.lit("eval.questions").alias("key"), "value"))
