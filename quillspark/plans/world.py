"""Queries: visibility, quota, sessions, digests, pacing and the selections that a chat makes from a corpus.

Facts stand for events: purchases for the world, errors for the author alone, the others for their channel;
clicks with an even id are retracted. A person takes part in the channels that it wrote in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import rewind
from ..operators import world as W
from ..operators.openings import opening_plan
from ..operators.trust import trust_ledger, trust_now
from ..operators.wrapup import wrap_up
from ..sources import ladder, paged
from ..sources.scratch import scratch
from ..sources.store import read_corpus
from .core import Tables, query
from .sources import FEED, feed_of

NOW = 1_705_622_400_000  # an instant within the driver's month of events

FACTS = """facts AS (SELECT id, CASE kind WHEN 'purchase' THEN 'world' WHEN 'error' THEN 'self' ELSE 'channel' END AS audience, CASE kind WHEN 'error' THEN author ELSE channel END AS ref,
  kind = 'click' AND id % 2 = 0 AS retracted, CASE WHEN id % 3 = 0 THEN ms + 86400000 END AS due, CASE WHEN id % 7 = 0 THEN ms + 604800000 END AS expires, id % 5 = 0 AS delivered, author, kind, ms FROM message),
members AS (SELECT DISTINCT channel, author AS person FROM message)"""


def facts_of(t: Tables) -> DataFrame:
    return t.message.select(
        "id",
        F.when(F.col("kind") == "purchase", "world").when(F.col("kind") == "error", "self").otherwise("channel").alias("audience"),
        F.when(F.col("kind") == "error", F.col("author")).otherwise(F.col("channel")).alias("ref"),
        ((F.col("kind") == "click") & (F.col("id") % 2 == 0)).alias("retracted"),
        F.when(F.col("id") % 3 == 0, F.col("ms") + 86_400_000).alias("due"),
        F.when(F.col("id") % 7 == 0, F.col("ms") + 604_800_000).alias("expires"),
        (F.col("id") % 5 == 0).alias("delivered"),
        "author",
        "kind",
        "ms",
    )


def members_of(t: Tables) -> DataFrame:
    return t.message.select("channel", F.col("author").alias("person")).distinct()


_SEES = "SELECT id, ref AS person FROM facts WHERE NOT retracted AND audience = 'self' UNION SELECT f.id, m.person FROM facts f JOIN members m ON m.channel = f.ref WHERE NOT retracted AND audience = 'channel'"


@query("v01_visible_to", f"WITH {FACTS} SELECT id FROM facts WHERE NOT retracted AND (audience = 'world' OR (audience = 'self' AND ref = 8) OR (audience = 'channel' AND ref IN (SELECT channel FROM members WHERE person = 8)))")
def v01(t: Tables) -> DataFrame:
    return W.visible_to(facts_of(t), members_of(t), 8).select("id")


@query("v02_shared_visible", f"WITH {FACTS}, sees AS ({_SEES}), grp AS (SELECT person FROM members WHERE channel = 4) SELECT id FROM facts WHERE NOT retracted AND audience = 'world' UNION ALL SELECT id FROM sees WHERE person IN (SELECT person FROM grp) GROUP BY id HAVING count(DISTINCT person) = (SELECT count(*) FROM grp)")
def v02(t: Tables) -> DataFrame:
    return W.shared_visible(facts_of(t), members_of(t), 4)


@query("v03_candidates", f"WITH {FACTS}, sees AS ({_SEES}) SELECT person, count(*) AS facts FROM sees GROUP BY person")
def v03(t: Tables) -> DataFrame:
    return W.seen_counts(facts_of(t), members_of(t))


# Memories stand for sentences: a turn is a wrap-up of its conversation, each fourth sentence a commitment (due unless
# its length is a multiple of three); those of system turns are held already, every other one retracted.
HELD_IDS = -(1 << 62)

_SENTENCES = r"""sentences AS (SELECT conv_id AS world, turn AS ms, role AS author, role = 'system' AS held, i - 1 AS i, part AS text, (conv_id * 10000 + turn) * 100000 + i - 1 AS place
  FROM (SELECT conv_id, turn, role, unnest(string_split_regex(text, '[.\n]+')) AS part, generate_subscripts(string_split_regex(text, '[.\n]+'), 1) AS i FROM conversations)),
memories AS (SELECT world, ms, author, held, held AND i % 2 = 1 AS retracted, CASE WHEN held THEN place - 4611686018427387904 ELSE place END AS id, CASE WHEN i % 4 = 3 THEN 'commitment' ELSE 'fact' END AS kind,
  i % 4 = 3 AND length(text) % 3 <> 0 AS has_due, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS plain FROM sentences),
sets AS (SELECT *, list_distinct(list_transform(range(1, length(plain)), lambda j: substr(plain, j, 2))) AS pairs FROM memories),
near AS (SELECT b.id, list(a.id ORDER BY a.id) AS near FROM sets a JOIN sets b ON a.world = b.world AND a.author = b.author AND a.id < b.id
  WHERE a.kind = 'fact' AND b.kind = 'fact' AND NOT a.retracted AND len(list_intersect(a.pairs, b.pairs)) * 100 >= 45 * (len(a.pairs) + len(b.pairs) - len(list_intersect(a.pairs, b.pairs))) AND len(a.pairs) > 0 GROUP BY b.id),
same AS (SELECT b.id, list(a.id ORDER BY a.id) AS same FROM memories a JOIN memories b ON a.world = b.world AND a.kind = b.kind AND a.plain = b.plain AND a.id < b.id WHERE a.plain <> '' GROUP BY b.id),
steps AS (SELECT m.*, coalesce(near, []::BIGINT[]) AS near, coalesce(same, []::BIGINT[]) AS same, row_number() OVER (PARTITION BY world ORDER BY m.id) AS rn FROM memories m LEFT JOIN near USING (id) LEFT JOIN same USING (id) WHERE NOT held),
fold AS (SELECT w.world, 0::BIGINT AS rn, coalesce(h.ids, []::BIGINT[]) AS there, -1::BIGINT AS wrap, 0 AS n, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::BIGINT AS existing
    FROM (SELECT DISTINCT world FROM steps) w LEFT JOIN (SELECT world, list(id) AS ids FROM memories WHERE held GROUP BY world) h USING (world)
  UNION ALL SELECT world, rn, CASE WHEN outcome = 'written' THEN list_append(there, id) ELSE there END, ms, n + (outcome = 'written')::INT, id, outcome,
    CASE outcome WHEN 'similar' THEN close WHEN 'duplicate' THEN equal END
  FROM (SELECT *, CASE WHEN plain = '' THEN 'empty' WHEN n >= 2 THEN 'over_limit' WHEN kind = 'commitment' AND NOT has_due THEN 'no_due' WHEN kind = 'fact' AND close IS NOT NULL THEN 'similar' WHEN equal IS NOT NULL THEN 'duplicate' ELSE 'written' END AS outcome
    FROM (SELECT s.world, s.rn, s.ms, s.id, s.plain, s.kind, s.has_due, f.there, CASE WHEN f.wrap = s.ms THEN f.n ELSE 0 END AS n,
        list_min(list_intersect(s.near, f.there)) AS close, list_min(list_intersect(s.same, f.there)) AS equal FROM fold f JOIN steps s ON s.world = f.world AND s.rn = f.rn + 1)))"""


def memories_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(held, proposed): the sentences of all turns, as memories."""
    parts = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]+")).alias("i", "text"))
    kind = F.when(F.col("i") % 4 == 3, "commitment").otherwise("fact")
    due = F.when((F.col("i") % 4 == 3) & (F.length("text") % 3 != 0), F.col("turn") + 86_400_000)
    place = (F.col("conv_id") * 10_000 + F.col("turn")) * 100_000 + F.col("i")
    rows = parts.select(
        F.col("conv_id").alias("world"), F.col("turn").alias("ms"), F.when(F.col("role") == "system", place + HELD_IDS).otherwise(place).alias("id"), F.col("role").alias("author"),
        kind.alias("kind"), F.lit("participants").alias("audience"), F.when(kind == "fact", "user").alias("about"), due.alias("due"), "text", "i", F.col("turn").alias("wrap"),
    )
    return rows.filter("author = 'system'").withColumn("retracted", F.col("i") % 2 == 1).drop("i", "wrap"), rows.filter("author <> 'system'").drop("i")


@query("v06_wrap_up", f"WITH RECURSIVE {_SENTENCES} SELECT world, id, outcome, existing FROM fold WHERE rn > 0")
def v06(t: Tables) -> DataFrame:
    return wrap_up(*memories_of(t))


@query(
    "v07_addressing",
    "SELECT m.id, coalesce(CASE WHEN m.kind = 'signup' THEN m.author END, CASE WHEN m.id % 4 = 0 THEN m.channel END, lag(m.author) OVER (PARTITION BY m.channel ORDER BY m.ms, m.id)) AS addressed FROM message m",
)
def v07(t: Tables) -> DataFrame:
    before = F.lag("author").over(Window.partitionBy("channel").orderBy("ms", "id"))
    named, best = F.when(F.col("kind") == "signup", F.col("author")), F.when(F.col("id") % 4 == 0, F.col("channel"))
    return t.message.select("id", F.coalesce(named, best, before).alias("addressed"))


@query("v08_interjector", "SELECT channel, arg_max(author, struct_pack(n := n, a := -author)) AS author FROM (SELECT channel, author, count(*) AS n FROM message WHERE kind <> 'error' GROUP BY 1, 2) WHERE n >= 2 GROUP BY channel")
def v08(t: Tables) -> DataFrame:
    counts = t.message.filter("kind <> 'error'").groupBy("channel", "author").agg(F.count("*").alias("n")).filter("n >= 2")
    return counts.groupBy("channel").agg(F.max_by("author", F.struct("n", (-F.col("author")).alias("a"))).alias("author"))


# Members of a channel: its authors, and those of the next one, who haven't spoken here unless they are both.
@query("v09_round_order", "SELECT channel, person, row_number() OVER (PARTITION BY channel ORDER BY last ASC NULLS FIRST, person) AS place FROM (SELECT c.channel, c.person, max(m.id) AS last FROM (SELECT channel, author AS person FROM message UNION SELECT (channel + 1) % 10, author FROM message WHERE kind = 'purchase') c LEFT JOIN message m ON m.channel = c.channel AND m.author = c.person GROUP BY 1, 2)")
def v09(t: Tables) -> DataFrame:
    guests = t.message.filter("kind = 'purchase'").select(((F.col("channel") + 1) % 10).alias("channel"), F.col("author").alias("person"))
    group = t.message.select("channel", F.col("author").alias("person")).unionByName(guests).distinct()
    spoken = t.message.groupBy("channel", F.col("author").alias("person")).agg(F.max("id").alias("last"))
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.asc_nulls_first("last"), "person"))
    return group.join(spoken, ["channel", "person"], "left").select("channel", "person", place.cast("long").alias("place"))


@query("v10_leak_checks", f"WITH {FACTS}, sees AS ({_SEES}) SELECT 'alone' AS point, count(*) AS leaks FROM sees s JOIN facts f USING (id) WHERE f.audience = 'self' AND s.person <> f.ref UNION ALL SELECT 'retracted', count(*) FROM sees s JOIN facts f USING (id) WHERE f.retracted UNION ALL SELECT 'outsider', count(*) FROM sees s JOIN facts f USING (id) WHERE f.audience = 'channel' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.channel = f.ref AND m.person = s.person)")
def v10(t: Tables) -> DataFrame:
    return W.leak_counts(facts_of(t), members_of(t))


@query("v11_bonds", "SELECT author AS person, min(ms) AS first_seen, max(ms) AS last_seen, count(*) AS words FROM message GROUP BY 1")
def v11(t: Tables) -> DataFrame:
    return W.bonds(t.message)


@query("v12_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT json_extract_string(props, '$.k')::BIGINT FROM message)")
def v12(t: Tables) -> DataFrame:
    named = t.message.select(F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    return R.drop_matching(t.part, named, "p_partkey").select("p_partkey")


@query("v13_usage_report", "SELECT 'mean.' || shape AS key, round(avg(points), 6)::DOUBLE AS value FROM meter GROUP BY shape UNION ALL SELECT 'cache_hit', round(sum(cached) / sum(cached + uncached), 6)::DOUBLE FROM meter")
def v13(t: Tables) -> DataFrame:
    mean = t.meter.groupBy("shape").agg(F.round(F.avg("points"), 6).alias("value")).select(F.concat(F.lit("mean."), "shape").alias("key"), "value")
    hit = t.meter.agg(F.round(F.try_divide(F.sum("cached"), F.sum(F.col("cached") + F.col("uncached"))), 6).alias("value")).withColumn("key", F.lit("cache_hit"))
    return mean.unionByName(hit)


# Layout 1 holds messages, settings by key (the kinds and three more), a log and a table that layout 4 no longer has.
_STEPS = [
    ladder.Step(2, "authors are text", lambda t: {**t, "message": t["message"].withColumn("author", F.col("author").cast("string"))}),
    ladder.Step(3, "errors are failures", lambda t: {**t, "message": t["message"].withColumn("kind", F.when(F.col("kind") == "error", "failure").otherwise(F.col("kind")))}),
    ladder.Step(4, "settings by kind count their messages", lambda t: {**t, "settings": t["settings"].join(t["message"].groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("uses")), "key", "left")}),
]
_LAYOUT = ladder.Layout(
    tables={
        "message": {"id": ("long", 0), "author": ("string", ""), "kind": ("string", "view"), "mode": ("string", "lexical")},
        "settings": {"key": ("string", ""), "uses": ("long", 0)},
        "log": {"id": ("long", 0)},
        "bond": {"person": ("string", ""), "trust": ("double", 0.0)},
    },
    keys={"settings": ("view", "click", "signup", "failure", "tier")},
    emptied=("log",),
)
_CLIMBED = """m AS (SELECT id, author::VARCHAR AS author, CASE kind WHEN 'error' THEN 'failure' ELSE kind END AS kind FROM message), known AS (SELECT unnest(['view', 'click', 'signup', 'failure', 'tier']) AS key),
s AS (SELECT DISTINCT kind AS key FROM message UNION ALL SELECT unnest(['tier', 'theme', 'theme'])), s4 AS (SELECT s.key, u.n FROM s LEFT JOIN (SELECT kind AS key, count(*) AS n FROM m GROUP BY kind) u USING (key))"""


def _climbed(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    path = scratch(t.spark, "ladder")
    m = t.message
    more = t.spark.createDataFrame([("tier",), ("theme",), ("theme",)], "key string")
    old = {"message": m.select("id", "author", "kind", "channel"), "settings": m.select(F.col("kind").alias("key")).distinct().unionByName(more), "log": m.select("id"), "cache": m.filter("id % 3 = 0").select("id")}
    ladder.write_world(old, path, 1)
    ladder.climb(t.spark, path, _STEPS)
    return ladder.keep(ladder.read_world(t.spark, path)[0], _LAYOUT)


@query("v14_migration", f"WITH {_CLIMBED} SELECT id, author, kind, 'lexical' AS mode FROM m")
def v14(t: Tables) -> DataFrame:
    return _climbed(t)[0]["message"]


@query(
    "v14_policy",
    f"""WITH {_CLIMBED} SELECT 'settings key' AS part, key AS name, count(*) AS n FROM s4 WHERE key NOT IN (SELECT key FROM known) GROUP BY key UNION ALL SELECT 'table', 'cache', (SELECT count(*) FROM message WHERE id % 3 = 0)
    UNION ALL SELECT 'emptied', 'log', (SELECT count(*) FROM message) UNION ALL SELECT 'kept', key, coalesce(n, 0) FROM s4 WHERE key IN (SELECT key FROM known)""",
)
def v14_policy(t: Tables) -> DataFrame:
    tables, gone = _climbed(t)
    return gone.unionByName(tables["settings"].select(F.lit("kept").alias("part"), F.col("key").alias("name"), F.col("uses").alias("n")))


@query("v15_user_words", "SELECT person, id FROM (SELECT m.person, e.id, row_number() OVER (PARTITION BY m.person ORDER BY e.id DESC) AS rn FROM (SELECT DISTINCT channel, author AS person FROM message) m JOIN message e USING (channel) WHERE e.kind = 'view') WHERE rn <= 5")
def v15(t: Tables) -> DataFrame:
    # Each channel's newest five are enough for any of its members: the cut comes before the join.
    newest = R.top_per_group(t.message.filter("kind = 'view'"), ["channel"], [F.desc("id")], 5)
    return R.top_per_group(members_of(t).join(newest.select("channel", "id"), "channel"), ["person"], [F.desc("id")], 5).select("person", "id")


# ---- T: incremental and stateful, in batch ----------------------------------------------------------


@query(
    "t01_watermark_sync",
    "WITH " + FEED.format(watermark=400, limit=5000).replace("SELECT title, rcid", "SELECT 'reached' AS run, title, rcid") + " UNION ALL (WITH " + FEED.format(watermark=400, limit=20).replace("SELECT title, rcid", "SELECT 'beyond' AS run, title, rcid") + ")",
)
def t01(t: Tables) -> DataFrame:
    # Once within the limit, and once with a limit that the feed passes before it is back at the watermark.
    path = feed_of(t)
    runs = [paged.changes(t.spark, path, 400, limit).withColumn("run", F.lit(run)) for run, limit in (("reached", paged.FEED_LIMIT), ("beyond", 20))]
    return runs[0].unionByName(runs[1])


_HELD = "held AS (SELECT author, max(id) AS rev FROM message WHERE ms <= 1704900000000 GROUP BY 1), live AS (SELECT author, max(id) AS rev FROM message GROUP BY 1), feed AS (SELECT DISTINCT author FROM message WHERE ms > 1705900000000)"


def _held(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    newest = lambda df: df.groupBy("author").agg(F.max("id").alias("rev"))
    return newest(t.message.filter("ms <= 1704900000000")), newest(t.message), t.message.filter("ms > 1705900000000").select("author").distinct()


@query("t02_stale", f"WITH {_HELD} SELECT author FROM held JOIN live USING (author) WHERE held.rev <> live.rev AND author NOT IN (SELECT author FROM feed)")
def t02(t: Tables) -> DataFrame:
    held, live, feed = _held(t)
    changed = held.join(live.withColumnRenamed("rev", "now"), "author").filter("rev <> now").select("author")
    return R.drop_matching(changed, feed, "author")


@query("t03_fetch_plan", f"WITH {_HELD} SELECT author, CASE WHEN author NOT IN (SELECT author FROM held) THEN 'added' ELSE 'changed' END AS why FROM live WHERE author NOT IN (SELECT author FROM held) OR author IN (SELECT author FROM feed)")
def t03(t: Tables) -> DataFrame:
    held, live, feed = _held(t)
    added = R.drop_matching(live, held, "author").select("author", F.lit("added").alias("why"))
    changed = R.keep_matching(R.keep_matching(live, held, "author"), feed, "author").select("author", F.lit("changed").alias("why"))
    return added.unionByName(changed)


@query(
    "t05_quota",
    f"WITH h AS (SELECT shape, ms, points / 3000e0 AS cost FROM meter WHERE ms > {NOW} - 86400000 AND ms <= {NOW}) SELECT shape, CASE WHEN sum(cost) >= 4 THEN 'exhausted' WHEN sum(cost) >= 3.2 THEN 'quiet' ELSE 'open' END AS band, round(sum(cost), 6)::DOUBLE AS calls FROM h GROUP BY shape",
)
def t05(t: Tables) -> DataFrame:
    # The hour before each instant is short in this data; a day of it is scaled into the window.
    day = t.meter.filter((F.col("ms") > NOW - 86_400_000) & (F.col("ms") <= NOW))
    calls = day.select("shape", (F.lit(NOW) - F.floor((NOW - F.col("ms")) / 24)).alias("ms"), (F.col("points") / 3000.0).alias("cost"))
    return W.quota_status(calls, NOW, 4.0, 0.8, ["shape"]).select("shape", "band", "calls")


@query(
    "t06_sessions",
    "SELECT author, session, min(ms) AS opened, max(ms) AS last, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY author ORDER BY ms, id)::BIGINT AS session FROM (SELECT *, coalesce((ms - lag(ms) OVER (PARTITION BY author ORDER BY ms, id) >= 1800000)::INT, 0) AS gap FROM message)) GROUP BY 1, 2",
)
def t06(t: Tables) -> DataFrame:
    return W.sessions(t.message, "author", 1_800_000)


@query("t07_in_conversation", f"SELECT author, {NOW} - max(ms) < 1800000 AS talking FROM message WHERE ms <= {NOW} GROUP BY author")
def t07(t: Tables) -> DataFrame:
    return t.message.filter(F.col("ms") <= NOW).groupBy("author").agg((NOW - F.max("ms") < 1_800_000).alias("talking"))


@query(
    "t09_slots",
    """SELECT day, sum((p * 240 + (((day * 31 + p + 1 + 7000)::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT) // 8589934592) % 240 <= since)::INT)::BIGINT AS due
    FROM (SELECT DISTINCT ms // 86400000 AS day, (ms // 3600000 % 24) * 60 AS since FROM message WHERE ms // 3600000 % 24 = 12), range(4) r(p) GROUP BY day""",
)
def t09(t: Tables) -> DataFrame:
    days = t.message.select(F.expr("ms div 86400000").alias("day"), (F.expr("ms div 3600000 % 24") * 60).alias("since")).distinct().filter("since = 720")
    return days.select("day", W.slots_due(F.col("day"), F.col("since"), 240, 4, 7).cast("long").alias("due"))


_SWEPT = f"CASE WHEN expires IS NOT NULL AND expires <= {NOW} THEN 'expired' WHEN due IS NOT NULL AND due <= {NOW} - 172800000 AND NOT delivered THEN 'lapsed' WHEN due IS NOT NULL AND due <= {NOW} AND NOT delivered THEN 'due' ELSE 'live' END"


@query("t12_sweep", f"WITH {FACTS} SELECT outcome, count(*) AS n FROM (SELECT {_SWEPT} AS outcome FROM facts) GROUP BY 1")
def t12(t: Tables) -> DataFrame:
    return W.swept(facts_of(t), NOW, 172_800_000).groupBy("outcome").agg(F.count("*").alias("n"))


@query("t13_due", f"WITH {FACTS} SELECT id, due FROM facts WHERE {_SWEPT} = 'due' AND NOT retracted")
def t13(t: Tables) -> DataFrame:
    return W.swept(facts_of(t), NOW, 172_800_000).filter("outcome = 'due' and not retracted").select("id", "due")


@query("t14_candidate_order", "SELECT id, row_number() OVER (PARTITION BY channel ORDER BY kind <> 'purchase', kind = 'view', id % 3 = 0, CASE WHEN id % 5 = 0 THEN NULL ELSE ms END ASC NULLS FIRST, author, kind, id) AS place FROM message")
def t14(t: Tables) -> DataFrame:
    seen = F.when(F.col("id") % 5 != 0, F.col("ms"))
    w = Window.partitionBy("channel").orderBy(F.col("kind") != "purchase", F.col("kind") == "view", F.col("id") % 3 == 0, seen.asc_nulls_first(), "author", "kind", "id")
    return t.message.select("id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "t16_digest",
    f"""WITH {FACTS} SELECT 'due' AS kind, author AS person, due AS at_ FROM facts WHERE {_SWEPT} = 'due' AND NOT retracted AND author NOT IN (3, 5)
    UNION ALL SELECT 'visit', author, max(ms) FROM message WHERE kind = 'view' AND author NOT IN (3, 5) GROUP BY author
    UNION ALL SELECT 'unread', author, max(ms) FROM message WHERE id > 300 AND author NOT IN (3, 5) GROUP BY author, channel""",
)
def t16(t: Tables) -> DataFrame:
    due = W.swept(facts_of(t), NOW, 172_800_000).filter("outcome = 'due' and not retracted").select(F.lit("due").alias("kind"), F.col("author").alias("person"), F.col("due").alias("at_"))
    newest = lambda df, kind, *by: df.groupBy("author", *by).agg(F.max("ms").alias("at_")).select(F.lit(kind).alias("kind"), F.col("author").alias("person"), "at_")
    visits, late = newest(t.message.filter("kind = 'view'"), "visit"), newest(t.message.filter("id > 300"), "unread", "channel")
    disabled = t.spark.createDataFrame([(3,), (5,)], "person long")
    return R.drop_matching(due.unionByName(visits).unionByName(late), disabled, "person").select("kind", "person", "at_")


@query("t17_unread", "SELECT c.channel, count(m.id) AS unread FROM (SELECT channel, max(id) - 40 AS mark FROM message GROUP BY 1) c LEFT JOIN message m ON m.channel = c.channel AND m.id > c.mark AND m.author <> 8 GROUP BY 1")
def t17(t: Tables) -> DataFrame:
    marks = t.message.groupBy("channel").agg((F.max("id") - 40).alias("read_up_to"))
    return W.unread(t.message, marks, 8)


@query("t18_announce_once", "SELECT author, kind, min(id) AS id FROM message WHERE kind <> 'view' AND id > 100 AND NOT EXISTS (SELECT 1 FROM message o WHERE o.author = message.author AND o.kind = message.kind AND o.id <= 100) GROUP BY 1, 2")
def t18(t: Tables) -> DataFrame:
    items, told = t.message.filter("kind <> 'view' and id > 100"), t.message.filter("id <= 100")
    return R.drop_matching(items, told, ["author", "kind"]).groupBy("author", "kind").agg(F.min("id").alias("id"))


# A world from the driver's tables: channels are those of the messages, the user writes the clicks; purchases and errors
# are memories (errors hurt their channel's person), views queue seeds, signups open segments and sessions.
_WORLD = """w_message AS (SELECT id, channel, CASE kind WHEN 'click' THEN 'user' ELSE author::VARCHAR END AS author, ms, CASE WHEN id % 11 = 0 THEN id % 40 END AS picture FROM message),
w_fact AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'user' ELSE author::VARCHAR END AS author, CASE WHEN kind = 'error' THEN 'hurt' WHEN id % 2 = 0 THEN 'commitment' ELSE 'fact' END AS kind, channel, ms AS created, id % 3 = 0 AS delivered,
  id % 5 = 0 AS retracted, channel AS person, -(id % 7)::DOUBLE AS trust_delta FROM message WHERE kind IN ('purchase', 'error')),
w_seed AS (SELECT id, CASE id % 3 WHEN 0 THEN 'commitment' WHEN 1 THEN 'words' ELSE 'memory' END AS kind, (id - 1 - id % 3)::VARCHAR AS ref, channel, CASE WHEN id % 4 = 0 THEN id - 2 END AS message, CASE WHEN id % 2 = 0 THEN ms END AS delivered_at FROM message WHERE kind = 'view'),
w_segment AS (SELECT id, channel, ms AS opened, row_number() OVER (PARTITION BY channel ORDER BY id) AS seq FROM message WHERE kind = 'signup'),
w_entry AS (SELECT id, (SELECT max(s.id) FROM w_segment s WHERE s.channel = m.channel AND s.id <= m.id) AS segment, ms FROM message m),
asked AS (SELECT DISTINCT channel, max(id) OVER (PARTITION BY channel) - 400 AS after FROM message WHERE channel % 2 = 0),
cut AS (SELECT a.channel, min(m.id) AS first, min(m.ms) AS at_ FROM asked a JOIN w_message m ON m.channel = a.channel AND m.author = 'user' AND m.id >= a.after GROUP BY a.channel),
gone AS (SELECT m.* FROM w_message m JOIN cut USING (channel) WHERE m.id >= first),
kept AS (SELECT * FROM w_message WHERE id NOT IN (SELECT id FROM gone)),
gone_fact AS (SELECT f.* FROM w_fact f JOIN cut USING (channel) WHERE created >= at_ AND (author <> 'user' OR kind = 'hurt')),
left_seed AS (SELECT * FROM w_seed WHERE NOT (kind IN ('commitment', 'memory') AND ref IN (SELECT id::VARCHAR FROM gone_fact)) AND NOT (kind = 'words' AND ref IN (SELECT id::VARCHAR FROM gone)) AND coalesce(message NOT IN (SELECT id FROM gone), true)),
late_seed AS (SELECT s.* FROM left_seed s JOIN cut USING (channel) WHERE delivered_at >= at_),
left_segment AS (SELECT s.* FROM w_segment s LEFT JOIN cut USING (channel) WHERE at_ IS NULL OR opened < at_),
w_person AS (SELECT DISTINCT channel AS person FROM message)"""

_REWOUND = """SELECT 'message' AS part, channel AS key, count(*)::DOUBLE AS n, sum(id)::DOUBLE AS total FROM kept GROUP BY channel
UNION ALL SELECT 'fact', channel, count(*), sum(CASE WHEN delivered AND NOT (kind = 'commitment' AND id::VARCHAR IN (SELECT ref FROM late_seed WHERE kind = 'commitment')) THEN id ELSE 0 END) FROM w_fact WHERE id NOT IN (SELECT id FROM gone_fact) GROUP BY channel
UNION ALL SELECT 'seed', channel, count(*), sum(id) FROM left_seed WHERE id NOT IN (SELECT id FROM late_seed) GROUP BY channel
UNION ALL SELECT 'segment', channel, count(*), sum(id) FROM left_segment GROUP BY channel
UNION ALL SELECT 'entry', e.segment, count(*), sum(e.id) FROM w_entry e LEFT JOIN w_segment s ON s.id = e.segment LEFT JOIN cut c ON c.channel = s.channel WHERE at_ IS NULL OR (e.ms < at_ AND s.opened < at_) GROUP BY e.segment
UNION ALL SELECT 'session', s.channel, count(*), sum(s.id) FROM w_segment s LEFT JOIN cut USING (channel) WHERE at_ IS NULL OR opened < at_ GROUP BY s.channel
UNION ALL SELECT 'bond', person, 1, least(100 - coalesce((SELECT sum(trust_delta) FROM gone_fact g WHERE g.person = w_person.person AND g.kind = 'hurt' AND NOT retracted), 0), 200) FROM w_person
UNION ALL SELECT 'channel', m.channel, max(CASE WHEN c.first IS NOT NULL AND m.read >= c.first THEN (SELECT max(id) FROM kept k WHERE k.channel = m.channel) ELSE m.read END),
  max(CASE WHEN c.first IS NOT NULL THEN (SELECT max_by(id, seq) FROM left_segment s WHERE s.channel = m.channel) ELSE -1 END) FROM (SELECT channel, max(id) AS read FROM message GROUP BY channel) m LEFT JOIN cut c USING (channel) GROUP BY m.channel
UNION ALL SELECT 'picture', picture, 1, picture FROM (SELECT DISTINCT picture FROM kept WHERE picture IS NOT NULL)"""


def world_of(t: Tables) -> dict[str, DataFrame]:
    m = t.message
    segment = m.filter("kind = 'signup'").select("id", "channel", F.col("ms").alias("opened"))
    seq = F.row_number().over(Window.partitionBy("channel").orderBy("id"))
    at = Window.partitionBy("channel").orderBy("id")
    return {
        "message": m.select("id", "channel", F.when(F.col("kind") == "click", "user").otherwise(F.col("author").cast("string")).alias("author"), "ms", F.when(F.col("id") % 11 == 0, F.col("id") % 40).alias("picture")),
        "fact": m.filter("kind in ('purchase', 'error')").select(
            "id", F.when(F.col("id") % 4 == 0, "user").otherwise(F.col("author").cast("string")).alias("author"),
            F.when(F.col("kind") == "error", "hurt").when(F.col("id") % 2 == 0, "commitment").otherwise("fact").alias("kind"), "channel", F.col("ms").alias("created"),
            (F.col("id") % 3 == 0).alias("delivered"), (F.col("id") % 5 == 0).alias("retracted"), F.col("channel").alias("person"), (-(F.col("id") % 7)).cast("double").alias("trust_delta"),
        ),
        "seed": m.filter("kind = 'view'").select(
            "id", F.when(F.col("id") % 3 == 0, "commitment").when(F.col("id") % 3 == 1, "words").otherwise("memory").alias("kind"), (F.col("id") - 1 - F.col("id") % 3).cast("string").alias("ref"),
            "channel", F.when(F.col("id") % 4 == 0, F.col("id") - 2).alias("message"), F.when(F.col("id") % 2 == 0, F.col("ms")).alias("delivered_at"),
        ),
        "session": segment,
        "segment": segment.withColumn("seq", seq),
        "entry": m.select("id", F.max(F.when(F.col("kind") == "signup", F.col("id"))).over(at).alias("segment"), "ms"),
        "channel": m.groupBy(F.col("channel").alias("id")).agg(F.max("id").alias("read_up_to"), F.lit(-1).cast("long").alias("segment"), F.lit(None).cast("long").alias("deleted_at")),
        "picture": m.filter("id % 11 = 0").select((F.col("id") % 40).alias("hash")).distinct(),
        "bond": m.select(F.col("channel").alias("person")).distinct().withColumn("trust", F.lit(100.0)),
    }


@query("t19_rewind", f"WITH {_WORLD} {_REWOUND}")
def t19(t: Tables) -> DataFrame:
    # Each even channel goes back to its first message of the user's among its last ids; odd channels and refused rows stay.
    world = world_of(t)
    path = scratch(t.spark, "world")
    rewind.commit_world(world, path)
    newest = t.message.filter("channel % 2 = 0").groupBy("channel").agg((F.max("id") - 400).alias("after"))
    own = world["message"].filter("author = 'user'").join(newest, "channel").filter("id >= after")
    asked = own.groupBy("channel").agg(F.min("id").alias("message"))
    wrong = world["message"].filter("author <> 'user' and channel % 2 = 0").groupBy("channel").agg(F.min("id").alias("message"))
    rewind.rewind(t.spark, path, asked.unionByName(wrong))
    _, version = read_corpus(t.spark, path)
    left = {name: t.spark.read.parquet(f"{version}/{name}") for name in world}
    tally = lambda part, key, n, total: left[part].groupBy(F.col(key).cast("long").alias("key")).agg(n.cast("double").alias("n"), total.cast("double").alias("total")).select(F.lit(part).alias("part"), "key", "n", "total")
    rows, ids = F.count("*"), F.sum("id")
    told = F.sum(F.when(F.col("delivered"), F.col("id")).otherwise(0))
    made = [tally("message", "channel", rows, ids), tally("fact", "channel", rows, told), tally("seed", "channel", rows, ids), tally("segment", "channel", rows, ids), tally("entry", "segment", rows, ids), tally("session", "channel", rows, ids)]
    made += [tally("bond", "person", rows, F.max("trust")), tally("channel", "id", F.max("read_up_to"), F.max("segment")), tally("picture", "hash", F.lit(1), F.max("hash"))]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


# Errors hurt, purchases take the last hurt back, every tenth view puts it again; all other messages grow trust.
_LEDGER = """s AS (SELECT author, id, kind, CASE WHEN kind = 'error' THEN 'hurt' WHEN kind = 'purchase' THEN 'undo' WHEN kind = 'view' AND id % 10 = 0 THEN 'redo' ELSE 'grow' END AS step, row_number() OVER (PARTITION BY author ORDER BY ms, id) AS rn FROM message),
f AS (SELECT DISTINCT author, 0::BIGINT AS rn, 50e0 AS trust, NULL::DOUBLE AS delta, false AS undone, NULL::BIGINT AS id, NULL::VARCHAR AS step, NULL::DOUBLE AS before FROM s
  UNION ALL SELECT author, rn, after, CASE WHEN step = 'hurt' OR (step = 'redo' AND undone) THEN after - trust ELSE delta END, CASE step WHEN 'hurt' THEN false WHEN 'undo' THEN undone OR delta IS NOT NULL WHEN 'redo' THEN false ELSE undone END, id, step, trust
  FROM (SELECT f.author, s.rn, s.id, s.step, f.trust, f.delta, f.undone, CASE s.step WHEN 'hurt' THEN greatest(f.trust - 15e0 * (0.5e0 + f.trust / 200e0), 0e0)
      WHEN 'undo' THEN CASE WHEN f.delta IS NOT NULL AND NOT f.undone THEN least(f.trust - f.delta, 200e0) ELSE f.trust END
      WHEN 'redo' THEN CASE WHEN f.undone THEN greatest(f.trust + f.delta, 0e0) ELSE f.trust END
      ELSE least(greatest(f.trust + 0.5e0 * CASE WHEN f.trust <= 100 THEN 1e0 ELSE greatest(1 - ((f.trust - 100) / 100) * ((f.trust - 100) / 100), 0e0) END, 0e0), 200e0) END AS after
    FROM f JOIN s ON s.author = f.author AND s.rn = f.rn + 1))"""


def _ledger(t: Tables) -> DataFrame:
    step = F.when(F.col("kind") == "error", "hurt").when(F.col("kind") == "purchase", "undo").when((F.col("kind") == "view") & (F.col("id") % 10 == 0), "redo").otherwise("grow")
    last = F.last(F.when(F.col("kind") == "error", F.col("id")), ignorenulls=True).over(Window.partitionBy("author").orderBy("ms", "id"))
    return trust_ledger(t.message.select("author", "ms", "id", step.alias("step"), last.alias("ref")), "author")


@query("t20_trust", f"WITH RECURSIVE {_LEDGER} SELECT author, round(trust, 6)::DOUBLE AS trust FROM f WHERE rn = (SELECT max(rn) FROM s WHERE s.author = f.author)")
def t20(t: Tables) -> DataFrame:
    return trust_now(_ledger(t), "author")


@query("t20_trust_ledger", f"WITH RECURSIVE {_LEDGER} SELECT author, id, step, round(before, 6)::DOUBLE AS before, round(trust, 6)::DOUBLE AS trust FROM f WHERE rn > 0")
def t20_ledger(t: Tables) -> DataFrame:
    return _ledger(t).select("author", "id", "step", F.round("before", 6).alias("before"), F.round("trust", 6).alias("trust"))


# Occasions stand for views (presences) and clicks; a signup is the user's own word; after an error the user is away until
# the next event; purchases of the last six hours are the quota. Three parts of five hours from seven in the morning, each
# with a slot at a hashed minute; an occasion has up to three candidates.
_PLAN = """ordered AS (SELECT *, lag(kind) OVER w AS before, max(CASE WHEN kind = 'signup' THEN ms END) OVER w AS spoke,
    count(*) FILTER (kind = 'purchase') OVER (PARTITION BY author ORDER BY ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS spends, ms // 60000 % 1440 AS minute, ms // 86400000 AS day
  FROM message WINDOW w AS (PARTITION BY author ORDER BY ms, id)),
occasion AS (SELECT author, ms, id, day, kind = 'view' AS presence, coalesce(before = 'error', false) AS away, spends < 2 AS free, minute >= 1320 OR minute < 420 AS quiet, coalesce(ms - spoke < 1800000, false) AS talking,
    CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS spent, (minute - 420) // 300 AS part, (minute - 420) % 300 >= (day * 7 + (minute - 420) // 300 * 13) % 300 AS come,
    list_transform(range(id % 4), lambda j: {'person': (id * 7 + j) % 5, 'channel': id % 3, 'grp': (id + j) % 3 = 0}) AS candidates,
    row_number() OVER (PARTITION BY author ORDER BY ms, id) AS rn FROM ordered WHERE kind IN ('view', 'click')),
plan AS (SELECT DISTINCT author, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, [{'ms': 0::BIGINT, 'part': 0::BIGINT, 'person': 0::BIGINT, 'channel': 0::BIGINT, 'grp': false}][2:] AS opened, NULL::BIGINT AS person, NULL::BIGINT AS channel FROM occasion
  UNION ALL SELECT author, rn, id, outcome, CASE WHEN outcome = 'open' THEN list_append(opened, {'ms': ms, 'part': part, 'person': pick.person, 'channel': pick.channel, 'grp': pick.grp}) ELSE opened END,
    CASE WHEN outcome = 'open' THEN pick.person END, CASE WHEN outcome = 'open' THEN pick.channel END
  FROM (SELECT *, CASE WHEN away THEN 'away' WHEN len(candidates) = 0 THEN 'no_seed' WHEN NOT free THEN 'quota' WHEN quiet THEN 'quiet_hours' WHEN talking THEN 'in_conversation' WHEN len(today) + spent >= 3 THEN 'daily_total'
      WHEN presence AND ms - opened[-1].ms < 3600000 THEN 'too_soon' WHEN presence AND (NOT come OR (direct AND grouped)) THEN 'not_yet' WHEN pick IS NOT NULL THEN 'open' WHEN waits THEN 'not_yet' ELSE 'per_person' END AS outcome
    FROM (SELECT *, list_filter(candidates, lambda c: CASE WHEN c.grp THEN NOT grouped AND len(list_filter(today, lambda o: o.grp AND o.person = c.person AND o.channel = c.channel)) < 1
          ELSE NOT direct AND len(list_filter(today, lambda o: NOT o.grp AND o.person = c.person)) < 1 END)[1] AS pick,
        len(list_filter(candidates, lambda c: CASE WHEN c.grp THEN grouped ELSE direct AND len(list_filter(today, lambda o: NOT o.grp AND o.person = c.person)) < 1 END)) > 0 AS waits
      FROM (SELECT *, presence AND len(list_filter(today, lambda o: o.part = part AND NOT o.grp)) > 0 AS direct, presence AND len(list_filter(today, lambda o: o.part = part AND o.grp)) > 0 AS grouped
        FROM (SELECT s.*, p.opened, list_filter(p.opened, lambda o: o.ms // 86400000 = s.day) AS today FROM plan p JOIN occasion s ON s.author = p.author AND s.rn = p.rn + 1)))))"""


def occasions_of(t: Tables) -> DataFrame:
    own = Window.partitionBy("author").orderBy("ms", "id")
    hours = Window.partitionBy("author").orderBy("ms").rangeBetween(-21_600_000, 0)
    ms, minute, day = F.col("ms"), F.expr("ms div 60000 % 1440"), F.expr("ms div 86400000")
    part, inside = F.expr("(ms div 60000 % 1440 - 420) div 300"), (minute - 420) % 300
    candidate = lambda j: F.struct(((F.col("id") * 7 + j) % 5).alias("person"), (F.col("id") % 3).alias("channel"), ((F.col("id") + j) % 3 == 0).alias("grp"))
    places = F.slice(F.array(*[F.lit(j).cast("long") for j in range(3)]), F.lit(1), (F.col("id") % 4).cast("int"))
    every = t.message.select(
        "author", "ms", "id", "kind", (F.col("kind") == "view").alias("presence"), F.coalesce(F.lag("kind").over(own) == "error", F.lit(False)).alias("away"),
        (F.sum((F.col("kind") == "purchase").cast("int")).over(hours) < 2).alias("open"), ((minute >= 1320) | (minute < 420)).alias("quiet"),
        F.coalesce(ms - F.max(F.when(F.col("kind") == "signup", ms)).over(own) < 1_800_000, F.lit(False)).alias("talking"),
        F.when(F.col("id") % 97 == 0, 1).otherwise(0).alias("spent"), part.alias("part"), (inside >= (day * 7 + part * 13) % 300).alias("come"), F.transform(places, candidate).alias("candidates"),
    )
    return every.filter("kind in ('view', 'click')")


@query("t15_opening_plan", f"WITH RECURSIVE {_PLAN} SELECT author, id, outcome, person, channel FROM plan WHERE rn > 0")
def t15_plan(t: Tables) -> DataFrame:
    return opening_plan(occasions_of(t), "author")


# After an error its user is away until the next event; every third event is a commitment due a day later.
_SLOT = "p * 240 + ((({day} * 31 + p + 1 + 7000)::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT) // 8589934592) % 240"


@query(
    "t21_away",
    f"""WITH stays AS (SELECT author, ms AS since, later AS until FROM (SELECT *, lead(ms) OVER (PARTITION BY author ORDER BY ms, id) AS later FROM message) WHERE kind = 'error' AND later IS NOT NULL),
    due AS (SELECT author, ms + 86400000 AS due, id % 2 = 0 AS own FROM message WHERE id % 3 = 0)
    SELECT author, since, until, (SELECT count(*) FROM range(4) r(p) WHERE {_SLOT.format(day="(until // 86400000)")} <= until // 60000 % 1440
        AND (since // 86400000 <> until // 86400000 OR {_SLOT.format(day="(until // 86400000)")} > since // 60000 % 1440)) AS slots,
      (SELECT count(*) FROM due d WHERE d.author = s.author AND d.due > since AND d.due <= until AND own) AS kept, (SELECT count(*) FROM due d WHERE d.author = s.author AND d.due > since AND d.due <= until AND NOT own) AS lapsed
    FROM stays s""",
)
def t21(t: Tables) -> DataFrame:
    later = F.lead("ms").over(Window.partitionBy("author").orderBy("ms", "id"))
    stays = t.message.withColumn("until", later).filter("kind = 'error' and until is not null").select("author", F.col("ms").alias("since"), "until")
    due = t.message.filter("id % 3 = 0").select("author", (F.col("ms") + 86_400_000).alias("due"), (F.col("id") % 2 == 0).alias("own"))
    return W.away_settled(stays, due, "author", 240, 4, 7)


# ---- D: selections from the corpus -------------------------------------------------------------------

_SMALL = "small AS (SELECT unit FROM attribution GROUP BY unit HAVING count(*) <= 4)"
_BOND = f"{_SMALL}, shared AS (SELECT x.person AS a, y.person AS b, least(count(*), 30) AS n FROM attribution x JOIN attribution y ON x.unit = y.unit AND x.person <> y.person WHERE x.unit IN (SELECT unit FROM small) GROUP BY 1, 2)"


def _shared(t: Tables) -> DataFrame:
    small = R.keep_matching(t.attribution, t.attribution.groupBy("unit").count().filter("count <= 4"), "unit")
    pairs = R.both_directions(R.unordered_pairs(small, "unit", "person"), "a", "b")
    return pairs.select(F.col("one").alias("a"), F.col("other").alias("b"), F.least("n", F.lit(30)).alias("n"))


@query("d01_bond_count", f"WITH {_BOND} SELECT a, b, n FROM shared")
def d01(t: Tables) -> DataFrame:
    return _shared(t)


_NAMED = "named AS (SELECT author AS a, channel AS b, count(*) AS named FROM message GROUP BY 1, 2)"


def _bond_scores(t: Tables) -> DataFrame:
    named = t.message.groupBy(F.col("author").alias("a"), F.col("channel").alias("b")).agg(F.count("*").alias("named"))
    both = _shared(t).join(named, ["a", "b"], "full_outer")
    score = F.coalesce("n", F.lit(0)) + 8 * F.least(F.coalesce("named", F.lit(0)), F.lit(3))
    scored = both.select("a", "b", score.cast("long").alias("score")).filter("score >= 3")
    return R.top_per_group(scored, ["a"], [F.desc("score"), "b"], 6)


@query("d02_bond_score", f"WITH {_BOND}, {_NAMED} SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM (SELECT coalesce(s.a, m.a) AS a, coalesce(s.b, m.b) AS b, (coalesce(n, 0) + 8 * least(coalesce(named, 0), 3))::BIGINT AS score FROM shared s FULL OUTER JOIN named m ON m.a = s.a AND m.b = s.b) WHERE score >= 3) WHERE rn <= 6")
def d02(t: Tables) -> DataFrame:
    return _bond_scores(t).select("a", "b", "score")


@query("d03_shared_scene", f"WITH {_SMALL} SELECT x.unit FROM attribution x JOIN attribution y USING (unit) WHERE x.person = 1 AND y.person = 2 AND unit IN (SELECT unit FROM small) AND unit NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def d03(t: Tables) -> DataFrame:
    small = t.attribution.groupBy("unit").agg(F.count("*").alias("n"), F.max((F.col("person") == 1).cast("int")).alias("x"), F.max((F.col("person") == 2).cast("int")).alias("y")).filter("n <= 4 and x = 1 and y = 1")
    return R.drop_matching(small.select("unit"), t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit")), "unit")


@query("d04_partners", f"WITH {_SMALL}, pairs AS (SELECT x.person AS a, y.person AS b, count(*) AS n FROM attribution x JOIN attribution y ON x.unit = y.unit AND x.person < y.person GROUP BY 1, 2) SELECT CASE WHEN a = 5 THEN b ELSE a END AS partner, n FROM pairs WHERE a = 5 OR b = 5 ORDER BY n DESC, partner LIMIT 8")
def d04(t: Tables) -> DataFrame:
    pairs = R.unordered_pairs(t.attribution, "unit", "person").filter("a = 5 or b = 5")
    return pairs.select(F.when(F.col("a") == 5, F.col("b")).otherwise(F.col("a")).alias("partner"), "n").orderBy(F.desc("n"), "partner").limit(8)


@query("d05_own_units", "SELECT person, ord, CASE template WHEN 'en' THEN 0 ELSE 1 END AS place FROM attribution JOIN units ON ord = unit WHERE template IN ('en', 'fr') AND (contains(page, '1') OR contains(page, '2')) AND ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def d05(t: Tables) -> DataFrame:
    own = t.attribution.join(t.units.filter(F.col("template").isin("en", "fr") & R.has_any_part(F.col("page"), ["1", "2"])), F.col("ord") == F.col("unit"))
    free = R.drop_matching(own, t.labels.filter("toxic = 1").select(F.col("doc_id").alias("ord")), "ord")
    return free.select("person", "ord", F.when(F.col("template") == "en", 0).otherwise(1).alias("place"))


@query("d06_per_kind", "SELECT person, template, ord FROM (SELECT person, template, ord, row_number() OVER (PARTITION BY person, template ORDER BY md5('3|' || ord), ord) AS rn FROM attribution JOIN units ON ord = unit) WHERE rn = 1")
def d06(t: Tables) -> DataFrame:
    own = t.attribution.join(t.units.select("ord", "template"), F.col("ord") == F.col("unit"))
    return R.first_per_group(own, ["person", "template"], [F.md5(F.concat(F.lit("3|"), F.col("ord").cast("string"))), "ord"]).select("person", "template", "ord")


@query("d08_pair_planning", f"WITH {_BOND}, {_NAMED}, scored AS (SELECT coalesce(s.a, m.a) AS a, coalesce(s.b, m.b) AS b, (coalesce(n, 0) + 8 * least(coalesce(named, 0), 3))::BIGINT AS score FROM shared s FULL OUTER JOIN named m ON m.a = s.a AND m.b = s.b) SELECT p.person, (SELECT arg_max(b, struct_pack(s := score, b := -b)) FROM scored WHERE a = p.person AND score >= 3) AS partner FROM persons p WHERE p.person NOT IN (SELECT author FROM message WHERE ms > {NOW})")
def d08(t: Tables) -> DataFrame:
    free = R.drop_matching(t.persons, t.message.filter(F.col("ms") > NOW).select(F.col("author").alias("person")), "person")
    best = _bond_scores(t).filter("rank = 1").select(F.col("a").alias("person"), F.col("b").alias("partner"))
    return free.join(best, "person", "left").select("person", "partner")


_BANDS = "CASE WHEN b.words IS NULL THEN 'never talked' WHEN p.person % 11 = 0 THEN 'disabled' WHEN b.words >= 20 THEN 'close' ELSE 'acquainted' END"


@query("d09_roster_bands", f"SELECT band, person, row_number() OVER (PARTITION BY band ORDER BY CASE band WHEN 'never talked' THEN 0 ELSE -coalesce(last_seen, 0) END, display) AS place FROM (SELECT p.person, p.display, b.last_seen, {_BANDS} AS band FROM persons p LEFT JOIN (SELECT author, max(ms) AS last_seen, count(*) AS words FROM message GROUP BY 1) b ON b.author = p.person)")
def d09(t: Tables) -> DataFrame:
    known = t.persons.join(W.bonds(t.message), "person", "left")
    band = F.when(F.col("words").isNull(), "never talked").when(F.col("person") % 11 == 0, "disabled").when(F.col("words") >= 20, "close").otherwise("acquainted")
    key = F.when(F.col("band") == "never talked", F.lit(0)).otherwise(-F.coalesce("last_seen", F.lit(0)))
    return known.withColumn("band", band).select("band", "person", F.row_number().over(Window.partitionBy("band").orderBy(key, "display")).cast("long").alias("place"))


_BOTH = "pairs AS (SELECT x.person AS a, y.person AS b, count(*) AS n FROM attribution x JOIN attribution y ON x.unit = y.unit AND x.person < y.person GROUP BY 1, 2), both_ AS (SELECT a AS one, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)"


@query("d10_companions", f"WITH {_BOTH} SELECT one, other FROM (SELECT *, row_number() OVER (PARTITION BY one ORDER BY n DESC, other) AS rn FROM both_) WHERE rn <= 8 AND other NOT IN (2, 7)")
def d10(t: Tables) -> DataFrame:
    both = R.both_directions(R.unordered_pairs(t.attribution, "unit", "person"), "a", "b")
    eight = R.top_per_group(both, ["one"], [F.desc("n"), "other"], 8)
    return R.drop_matching(eight, t.spark.createDataFrame([(2,), (7,)], "other long"), "other").select("one", "other")


@query("d11_cold_start", "SELECT person FROM persons WHERE region IN (1, 2) AND person IN (SELECT author FROM message) AND person NOT IN (3, 5) ORDER BY balance DESC, person LIMIT 3")
def d11(t: Tables) -> DataFrame:
    picks = R.keep_matching(t.persons.filter("region in (1, 2)"), t.message.select(F.col("author").alias("person")), "person")
    return R.drop_matching(picks, t.spark.createDataFrame([(3,), (5,)], "person long"), "person").orderBy(F.desc("balance"), "person").limit(3).select("person")


@query("d13_words_hit", f"SELECT person, id FROM (SELECT person, id, row_number() OVER (PARTITION BY person ORDER BY id DESC) AS rn FROM (SELECT m.person, e.id, e.kind, row_number() OVER (PARTITION BY m.person ORDER BY e.id DESC) AS r3 FROM (SELECT DISTINCT channel, author AS person FROM message) m JOIN message e USING (channel) WHERE e.ms <= {NOW}) WHERE r3 <= 3 AND kind = 'purchase') WHERE rn = 1")
def d13(t: Tables) -> DataFrame:
    newest = R.top_per_group(t.message.filter(F.col("ms") <= NOW), ["channel"], [F.desc("id")], 3).select("channel", "id", "kind")
    three = R.top_per_group(members_of(t).join(newest, "channel"), ["person"], [F.desc("id")], 3).filter("kind = 'purchase'")
    return three.groupBy("person").agg(F.max("id").alias("id"))


@query("d16_channel_summaries", "SELECT c.channel, max(m.ms) AS last, count(m.id) AS messages, (sum((m.id > 300 AND m.author <> 8)::INT))::BIGINT AS unread, CASE WHEN max(m.id) % 2 = 0 THEN 'open' ELSE 'quiet' END AS mode FROM range(12) c(channel) LEFT JOIN message m USING (channel) GROUP BY 1 HAVING count(m.id) > 0 OR c.channel = 10")
def d16(t: Tables) -> DataFrame:
    every = t.spark.range(12).withColumnRenamed("id", "channel").join(t.message, "channel", "left")
    late = F.when(F.col("id").isNotNull(), ((F.col("id") > 300) & (F.col("author") != 8)).cast("long"))
    made = every.groupBy("channel").agg(F.max("ms").alias("last"), F.count("id").alias("messages"), F.sum(late).alias("unread"), F.max("id").alias("m"))
    return made.filter("messages > 0 or channel = 10").select("channel", "last", "messages", "unread", F.when(F.col("m") % 2 == 0, "open").otherwise("quiet").alias("mode"))


@query("d18_read_around", "SELECT span_of, lo, hi, CASE WHEN lo < 3 THEN 'before' ELSE 'after' END AS side FROM ranges r WHERE EXISTS (SELECT 1 FROM ranges h WHERE h.span_of = r.span_of AND h.lo = 3) AND r.lo BETWEEN 1 AND 5 AND r.lo <> 3")
def d18(t: Tables) -> DataFrame:
    at = t.ranges.filter("lo = 3").select("span_of").distinct()
    return R.keep_matching(t.ranges.filter("lo between 1 and 5 and lo <> 3"), at, "span_of").withColumn("side", F.when(F.col("lo") < 3, "before").otherwise("after"))


@query("d19_subject", "SELECT asked, person FROM (SELECT asked, person, row_number() OVER (PARTITION BY asked ORDER BY prio, person) AS rn FROM (SELECT a.asked, p.person, CASE WHEN p.person::VARCHAR = a.asked OR p.display = a.asked THEN 0 ELSE 1 END AS prio FROM (SELECT unnest(['3', 'Supplier#000000005', 'FRANCE', 'nobody']) AS asked) a JOIN persons p ON p.person::VARCHAR = a.asked OR p.display = a.asked OR p.home = a.asked)) WHERE rn = 1")
def d19(t: Tables) -> DataFrame:
    asked = F.broadcast(t.spark.createDataFrame([("3",), ("Supplier#000000005",), ("FRANCE",), ("nobody",)], "asked string"))
    ways = [(F.col("person").cast("string"), 0), (F.col("display"), 0), (F.col("home"), 1)]
    found = None
    for key, prio in ways:
        hit = t.persons.withColumn("asked", key).join(asked, "asked").select("asked", "person", F.lit(prio).alias("prio"))
        found = hit if found is None else found.unionByName(hit)
    return R.first_per_group(found, ["asked"], ["prio", "person"]).select("asked", "person")


@query("d20_member_by_name", "SELECT home, min(person) AS person FROM persons GROUP BY home HAVING count(*) = 1")
def d20(t: Tables) -> DataFrame:
    return t.persons.groupBy("home").agg(F.count("*").alias("n"), F.min("person").alias("person")).filter("n = 1").select("home", "person")


@query("d21_personas", "SELECT author AS person FROM message GROUP BY author HAVING count(DISTINCT kind) FILTER (kind IN ('view', 'purchase', 'signup')) = 3")
def d21(t: Tables) -> DataFrame:
    slots = t.message.groupBy(F.col("author").alias("person")).agg(F.collect_set("kind").alias("k"))
    return slots.filter(F.size(F.array_intersect("k", F.array(*map(F.lit, ("view", "purchase", "signup"))))) == 3).select("person")


@query("v_decide", "SELECT id, CASE WHEN id % 3 = 0 THEN 'exhausted' WHEN id % 3 = 1 AND kind <> 'view' THEN 'quiet' ELSE 'allow' END AS decision FROM message")
def v_decide(t: Tables) -> DataFrame:
    band = F.when(F.col("id") % 3 == 0, "exhausted").when(F.col("id") % 3 == 1, "quiet").otherwise("open")
    return t.message.select("id", W.decide(band, F.col("kind") == "view").alias("decision"))
