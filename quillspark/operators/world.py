"""Messages, memories and pacing: visibility, quotas, sessions, digests, trust, as set queries over event rows.

Instants are milliseconds. Every operator keys its windows by channel, person or time cell, never by nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R

HOUR_MS = 3_600_000

# Calls an hour by tier.
QUOTA_TIERS = {"low": 40, "middle": 80, "high": 160, "extra_high": 320, "max": 640}


def visible_to(facts: DataFrame, members: DataFrame, person: int) -> DataFrame:
    """Facts for the world, for the person alone, or for a channel that the person takes part in; not retracted.

    facts: ``id, audience, ref, retracted``; members: ``channel, person``."""
    own = members.filter(F.col("person") == person).select(F.col("channel").alias("ref")).distinct()
    live = facts.filter(~F.col("retracted"))
    direct = live.filter((F.col("audience") == "world") | ((F.col("audience") == "self") & (F.col("ref") == person)))
    group = live.filter("audience = 'channel'").join(own, "ref", "left_semi")
    return direct.unionByName(group.select(*direct.columns))


def visibility(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``id, person`` for all persons at once; world facts are left to the caller, as everyone sees them."""
    live = facts.filter(~F.col("retracted"))
    alone = live.filter("audience = 'self'").select("id", F.col("ref").alias("person"))
    group = live.filter("audience = 'channel'").join(members, F.col("ref") == F.col("channel")).select("id", "person")
    return alone.unionByName(group).distinct()


def visibility_classes(facts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, class``, ``class, person``): ``visibility`` without a row for each fact and person.

    A fact's class is the set of persons and channels that it is told to, so facts told alike share one row a person."""
    told = facts.filter(~F.col("retracted") & F.col("audience").isin("self", "channel")).select("id", F.struct("audience", "ref").alias("_to"))
    classes = told.groupBy("id").agg(F.array_sort(F.collect_set("_to")).alias("class"))
    to = classes.select("class").distinct().select("class", F.explode("class").alias("_to")).select("class", "_to.*")
    alone = to.filter("audience = 'self'").select("class", F.col("ref").alias("person"))
    group = to.filter("audience = 'channel'").join(members, F.col("ref") == F.col("channel")).select("class", "person")
    return classes, alone.unionByName(group).distinct()


def seen_counts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``person, facts``: how many facts each person sees, the world's left out as in ``visibility``."""
    classes, viewers = visibility_classes(facts, members)
    sizes = classes.groupBy("class").agg(F.count("*").alias("_n"))
    return viewers.join(sizes, "class").groupBy("person").agg(F.sum("_n").alias("facts"))


def leak_counts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``point, leaks``: pairs of a fact and a person that sees its id, though the fact is another's alone (alone), is
    retracted, or is for a channel that the person takes no part in (outsider)."""
    classes, viewers = visibility_classes(facts, members)
    # Facts are counted by class and audience first; persons come to the counts, not to the facts.
    kinds = facts.join(classes, "id").groupBy("class", "audience", "ref", "retracted").agg(F.count("*").alias("_n"))
    told = lambda where: kinds.filter(where).groupBy("class", "ref").agg(F.sum("_n").alias("_n")).join(viewers, "class")
    sizes = viewers.groupBy("class").agg(F.count("*").alias("_seen"))
    found = {
        "alone": told("audience = 'self'").filter("person <> ref"),
        "retracted": kinds.filter("retracted").join(sizes, "class").withColumn("_n", F.col("_n") * F.col("_seen")),
        "outsider": told("audience = 'channel'").join(members.select(F.col("channel").alias("ref"), "person"), ["ref", "person"], "left_anti"),
    }
    sums = [df.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("leaks")).withColumn("point", F.lit(point)) for point, df in found.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


def shared_visible(facts: DataFrame, members: DataFrame, channel: int) -> DataFrame:
    """Facts that every participant sees; a channel without participants sees the world's only."""
    group = members.filter(F.col("channel") == channel).select("person").distinct()
    classes, viewers = visibility_classes(facts, members)
    all_see = classes.join(R.seen_by_all(viewers, "class", "person", group), "class", "left_semi").select("id")
    world = facts.filter(~F.col("retracted") & (F.col("audience") == "world")).select("id")
    return world.unionByName(all_see)


def quota_status(calls: DataFrame, now: Column | int, limit: float, quiet_at: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """Use of the hour before ``now``: band and the earliest release. calls: ``ms, cost``.

    Costs add up within each millisecond first, so without ``by`` a window holds an hour of them at most."""
    by = by or []
    at = F.lit(now) if isinstance(now, int) else now
    held = calls.filter((F.col("ms") > at - HOUR_MS) & (F.col("ms") <= at))
    held = held.groupBy(*by, "ms").agg(F.sum("cost").alias("cost"))
    w = Window.partitionBy(*by)
    used = held.withColumn("_all", F.sum("cost").over(w)).withColumn("_run", F.sum("cost").over(w.orderBy("ms").rangeBetween(Window.unboundedPreceding, 0)))
    band = F.when(F.col("_all") >= limit, "exhausted").when(F.col("_all") >= limit * quiet_at, "quiet").otherwise("open")
    target = F.when(F.col("_all") >= limit, F.lit(float(limit))).when(F.col("_all") >= limit * quiet_at, F.lit(float(limit * quiet_at)))
    marked = used.withColumn("band", band).withColumn("_free", F.when(F.col("_all") - F.col("_run") < target, F.col("ms") + HOUR_MS))
    return marked.groupBy(*by, "band").agg(F.round(F.max("_all"), 6).alias("calls"), F.min("_free").alias("release"))


def quota_history(spends: DataFrame, by: list[str], limit: int, quiet: int) -> DataFrame:
    """``by, ms, used, band, release`` at every instant with spends, over the hour up to it. spends: ``by, ms, cost``.

    Costs, ``limit`` and ``quiet`` (where the quiet band begins) are whole numbers of one unit; rows without a cost don't
    count. Release is when the hour's sum falls below the band's mark again; null in the open band. An hour's rows are
    read with the hour before it, so no window holds more than two hours of a key, and no frame more rows than a mark."""
    if not 0 < quiet <= limit:
        raise ValueError("the marks must be above zero, and the quiet one not above the limit")
    at = spends.filter(F.col("cost") > 0).groupBy(*by, "ms").agg(F.sum("cost").cast("long").alias("cost"))
    cell = F.expr(f"ms div {HOUR_MS}")
    own = Window.partitionBy(*by, "_cell")
    run = R.rolling_sum(at, "ms", "cost", HOUR_MS, by).withColumnRenamed("rolling", "used")
    run = run.select("*", F.explode(F.array(cell, cell + 1)).alias("_cell")).withColumn("_run", F.sum("cost").over(own.orderBy("ms")))
    # The sum falls below a mark once it has lost the first row whose running sum is less than the mark behind.
    first = {mark: F.min("ms").over(own.orderBy("_run").rangeBetween(1 - mark, 0)) + HOUR_MS for mark in (limit, quiet)}
    band = F.when(F.col("used") >= limit, "exhausted").when(F.col("used") >= quiet, "quiet").otherwise("open")
    release = F.when(F.col("used") >= limit, first[limit]).when(F.col("used") >= quiet, first[quiet])
    return run.withColumn("band", band).withColumn("release", release).filter(F.col("_cell") == cell).select(*by, "ms", "used", "band", "release")


def decide(band: Column, user_initiated: Column) -> Column:
    return F.when(band == "exhausted", "exhausted").when((band == "quiet") & ~user_initiated, "quiet").otherwise("allow")


def sessions(messages: DataFrame, key: str, idle_ms: int) -> DataFrame:
    """``key, session, opened, last, n``: a gap of ``idle_ms`` or more starts the next session."""
    w = Window.partitionBy(key).orderBy("ms", "id")
    gap = F.coalesce((F.col("ms") - F.lag("ms").over(w) >= idle_ms).cast("long"), F.lit(0).cast("long"))
    numbered = messages.withColumn("_new", gap).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min("ms").alias("opened"), F.max("ms").alias("last"), F.count("*").alias("n"))


def unread(messages: DataFrame, channels: DataFrame, user: int) -> DataFrame:
    """``channel, unread``: messages of others past the channel's read mark. channels: ``channel, read_up_to``."""
    late = messages.join(channels, "channel").filter((F.col("author") != user) & (F.col("id") > F.coalesce("read_up_to", F.lit(-1))))
    return R.counts_for_all(late, "channel", channels).withColumnRenamed("n", "unread")


def swept(facts: DataFrame, now: int, grace_ms: int) -> DataFrame:
    """``outcome`` of each fact: expired, lapsed (due too long ago), due, or live."""
    expired = F.col("expires").isNotNull() & (F.col("expires") <= now)
    lapsed = F.col("due").isNotNull() & (F.col("due") <= now - grace_ms) & ~F.col("delivered")
    due = F.col("due").isNotNull() & (F.col("due") <= now) & ~F.col("delivered")
    return facts.withColumn("outcome", F.when(expired, "expired").when(lapsed, "lapsed").when(due, "due").otherwise("live"))


def newest_per_pair(messages: DataFrame, channel: str = "channel", author: str = "author") -> DataFrame:
    return messages.groupBy(channel, author).agg(F.max("id").alias("id"), F.max("ms").alias("ms"))


def slots_due(day: Column, since: Column, part: int, total: int, salt: int) -> Column:
    """How many of a day's slots have come: slot i lies at part * i + hash(i) mod part minutes of the waking window."""
    # The multiplier of the hash; products are taken modulo 2**64 in exact decimals.
    multiplier, wrap = "11400714819323198485", "18446744073709551616"
    every = [
        F.expr(f"cast((cast((({day_sql(day)}) * 31 + {i + 1} + {salt * 1000}) as decimal(16,0)) * cast('{multiplier}' as decimal(20,0))) % cast('{wrap}' as decimal(20,0)) as decimal(20,0)) div cast(8589934592 as decimal(20,0))")
        for i in range(total)
    ]
    out = F.lit(0)
    for i, mixed in enumerate(every):
        out = out + F.when(F.lit(part * i) + F.pmod(mixed.cast("long"), F.lit(part)) <= since, 1).otherwise(0)
    return out


def away_settled(stays: DataFrame, commitments: DataFrame, user: str, part: int, total: int, salt: int, first_minute: int = 0) -> DataFrame:
    """``user, since, until, slots, kept, lapsed``: what each time away used up. stays: ``user, since, until``.

    Slots of the day of the return that came while away count as spent. Of the commitments (``user, due, own``) that fell
    due meanwhile the user's own are told on return and kept, those of others lapse. Slots are counted in UTC days from
    ``first_minute`` on, ``total`` parts of ``part`` minutes."""
    minute = lambda ms: F.expr(f"{ms} div 60000 % 1440") - first_minute
    days = stays.select(user, "since", "until", F.expr("until div 86400000").alias("_day"), minute("until").alias("_now"), F.when(F.expr("since div 86400000 = until div 86400000"), minute("since")).otherwise(-1440).alias("_left"))
    slots = slots_due(F.col("_day"), F.col("_now"), part, total, salt) - slots_due(F.col("_day"), F.col("_left"), part, total, salt)
    spent = days.select(user, "since", "until", slots.cast("long").alias("slots"))
    due = commitments.select(F.col(user).alias("_user"), "due", "own")
    fell = spent.join(due, (F.col(user) == F.col("_user")) & (F.col("due") > F.col("since")) & (F.col("due") <= F.col("until")), "left")
    count = lambda own: F.sum((F.col("own") == F.lit(own)).cast("long"))
    return fell.groupBy(user, "since", "until", "slots").agg(F.coalesce(count(True), F.lit(0)).alias("kept"), F.coalesce(count(False), F.lit(0)).alias("lapsed"))


def day_sql(day: Column) -> str:
    """The name of the day column, for exact decimal expressions."""
    return day._jc.toString() if hasattr(day, "_jc") else str(day)


def bonds(messages: DataFrame, min_known: int = 1) -> DataFrame:
    """Upsert of bonds: one row a person, first and monotone last seen."""
    return messages.groupBy(F.col("author").alias("person")).agg(F.min("ms").alias("first_seen"), F.max("ms").alias("last_seen"), F.count("*").alias("words"))


def openings(occasions: DataFrame, person: str, gap_ms: int, daily: int) -> DataFrame:
    """Occasions that may open a conversation, in order: at least ``gap_ms`` after the last one taken, at most ``daily`` a day.

    What is taken depends on what was, so each person's occasions fold in one expression."""
    ordered = occasions.groupBy(person).agg(F.array_sort(F.collect_list(F.struct("ms", "id"))).alias("_s"))
    start = F.struct(F.lit(-(1 << 60)).alias("last"), F.lit(-1).cast("long").alias("day"), F.lit(0).alias("n"), F.array().cast("array<struct<ms:bigint,id:bigint>>").alias("taken"))

    def step(a: Column, s: Column) -> Column:
        today = F.floor(s["ms"] / 86_400_000).cast("long")
        used = F.when(a["day"] == today, a["n"]).otherwise(0)
        ok = (s["ms"] - a["last"] >= gap_ms) & (used < daily)
        return F.when(ok, F.struct(s["ms"].alias("last"), today.alias("day"), (used + 1).alias("n"), F.concat(a["taken"], F.array(F.struct(s["ms"].alias("ms"), s["id"].alias("id")))).alias("taken"))).otherwise(a)

    return ordered.select(person, F.explode(F.aggregate("_s", start, step)["taken"]).alias("_t")).select(person, "_t.id", "_t.ms")
