"""Queries: streams drained over the events, against the same question asked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import world as W
from ..streaming import streams as S
from .core import Tables, query


def _stream(t: Tables) -> DataFrame:
    raw = S.tail(t.spark, f"{t.folder}/events.parquet", t.events.schema)
    at = F.col("ts").cast("timestamp")
    return raw.select(F.col("event_id").alias("id"), at.alias("at"), F.unix_millis(at).alias("ms"), F.col("user_id").alias("author"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 125).cast("long").alias("points"))


@query("t04_cursor_tail", "SELECT id, author, kind FROM message WHERE id > 100")
def t04(t: Tables) -> DataFrame:
    return S.drained(_stream(t).filter("id > 100").select("id", "author", "kind"), "tail")


# All events come in one batch, so none is late; windows that end within ten minutes of the newest event stay open.
@query(
    "t05_stream_windows",
    """WITH w AS (SELECT event_type AS kind, floor(value * 125)::BIGINT AS points, (epoch_us(ts) // 600000000 - k) * 600000000 AS start FROM events, range(6) r(k))
    SELECT start, kind, sum(points)::BIGINT AS total, count(*) AS n FROM w WHERE start + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 600000000 GROUP BY 1, 2""",
)
def t05s(t: Tables) -> DataFrame:
    made = S.drained(S.rolling(_stream(t), "points", "kind"), "windows")
    return made.select(F.unix_micros("start").alias("start"), "kind", "total", "n")


# Limits of 3 and 1.5 calls an hour, at 3,000 points a call; a purchase is billed by request and counts as one call.
_SPENDS = """spends AS (SELECT shape, ms, sum(CASE WHEN requests > 0 THEN 3000 ELSE points END)::BIGINT AS cost FROM meter GROUP BY 1, 2 HAVING sum(CASE WHEN requests > 0 THEN 3000 ELSE points END) > 0),
run AS (SELECT *, sum(cost) OVER (PARTITION BY shape ORDER BY ms) AS run, sum(cost) OVER (PARTITION BY shape ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)::BIGINT AS used FROM spends),
told AS (SELECT a.shape, a.ms, a.used, CASE WHEN used >= 9000 THEN 'exhausted' WHEN used >= 4500 THEN 'quiet' ELSE 'open' END AS band,
  (SELECT min(b.ms) + 3600000 FROM run b WHERE b.shape = a.shape AND b.ms > a.ms - 3600000 AND b.ms <= a.ms AND a.run - b.run < CASE WHEN a.used >= 9000 THEN 9000 ELSE 4500 END AND a.used >= 4500) AS release FROM run a)"""


@query("t05_quota_history", f"WITH {_SPENDS} SELECT shape, ms, used, band, release FROM told")
def t05h(t: Tables) -> DataFrame:
    cost = F.when(F.col("requests") > 0, 3000).otherwise(F.col("points"))
    return W.quota_history(t.meter.select("shape", "ms", cost.alias("cost")), ["shape"], 9000, 4500)


# The watermark ends ten minutes behind the newest event; instants beyond it still wait.
@query("t05_stream_quota", f"WITH {_SPENDS} SELECT shape, ms, used, band, release FROM told WHERE ms <= (SELECT max(ms) - 600000 FROM message)")
def t05q(t: Tables) -> DataFrame:
    cost = F.when(F.col("kind") == "purchase", 3000).otherwise(F.col("points"))
    stream = _stream(t).select("at", F.col("kind").alias("shape"), "ms", cost.alias("cost"))
    return S.drained(S.quota_history(stream, ["shape"], 9000, 4500), "quota")


@query(
    "t06_stream_sessions",
    """WITH s AS (SELECT author, session, min(us) AS opened, max(us) AS last, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY author ORDER BY us, id) AS session FROM (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY author ORDER BY us, id) >= 1800000000)::INT, 0) AS gap FROM (SELECT event_id AS id, user_id AS author, epoch_us(ts) AS us FROM events))) GROUP BY 1, 2)
    SELECT author, opened, last, n FROM s WHERE (last + 1800000000) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)""",
)
def t06s(t: Tables) -> DataFrame:
    made = S.drained(S.session_gaps(_stream(t), "author"), "sessions")
    return made.select("author", F.unix_micros("opened").alias("opened"), F.unix_micros("last").alias("last"), "n")


@query("t18_stream_once", "SELECT author, kind FROM message GROUP BY 1, 2")
def t18s(t: Tables) -> DataFrame:
    # The memory of a key outlives all events here: every key is announced once.
    made = S.announced_once(_stream(t).select("at", "author", "kind"), ["author", "kind"], "36500 days")
    return S.drained(made, "once").select("author", "kind")


_OPEN = """WITH RECURSIVE s AS (SELECT author, id, ms, row_number() OVER (PARTITION BY author ORDER BY ms, id) AS rn FROM message),
f AS (SELECT DISTINCT author, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BIGINT AS ms, -1000000000000000::BIGINT AS last, -1::BIGINT AS day, 0 AS n, false AS taken FROM s
  UNION ALL SELECT f.author, f.rn + 1, s.id, s.ms, CASE WHEN ok THEN s.ms ELSE f.last END, CASE WHEN ok THEN s.ms // 86400000 ELSE f.day END, CASE WHEN ok THEN used + 1 ELSE f.n END, ok
  FROM (SELECT f.*, s.id AS sid, s.ms AS sms, CASE WHEN f.day = s.ms // 86400000 THEN f.n ELSE 0 END AS used, s.ms - f.last >= 3600000 AND (CASE WHEN f.day = s.ms // 86400000 THEN f.n ELSE 0 END) < 2 AS ok FROM f JOIN s ON s.author = f.author AND s.rn = f.rn + 1) f JOIN s ON s.author = f.author AND s.rn = f.rn + 1)
SELECT author, id, ms FROM f WHERE taken"""


@query("t15_openings", _OPEN)
def t15(t: Tables) -> DataFrame:
    return W.openings(t.message, "author", 3_600_000, 2)


@query("t15_stream_openings", _OPEN)
def t15s(t: Tables) -> DataFrame:
    return S.drained(S.openings(_stream(t), "author", 3_600_000, 2), "openings")
