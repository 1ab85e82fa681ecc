"""Rewind: channels go back to before one of the user's own messages, with all that came of what is taken back.

The tables form a graph: messages give seeds and carry pictures, memories give seeds and hold what a hurt took,
segments hold log entries. Each table's rows to drop are found from those of the tables before it, by joins on keys,
for any number of channels at once. The cut of a channel is the instant of its message; several of one channel are
the earliest of them. What stays: metered calls, trust earned by shared turns, sessions opened before.

All tables of the world are committed as one version: a failure between tables leaves the version before.

Tables and the columns that are read (others are carried):
``channel``: id, read_up_to, segment, deleted_at; ``message``: id, channel, author, ms, picture; ``fact``: id, author, kind,
channel (of its audience; null for others), created, delivered, retracted, person, trust_delta; ``seed``: id, kind, ref,
channel, message, delivered_at; ``session``, ``segment`` (also seq): id, channel, opened; ``entry``: segment, ms; ``summary``:
channel, ms; ``picture``: hash; ``bond``: person, trust.

Cases: a message that isn't there, isn't the user's, or lies in another or a deleted channel is refused and changes nothing;
rows with a null channel stay; a table that is absent is passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from ..sources.scratch import scratch

USER = "user"


def cuts(tables: dict[str, DataFrame], asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``channel, first, at``: what each channel goes back to; refused rows with their reason). asked: ``channel, message``."""
    m = tables["message"].select(F.col("id").alias("message"), F.col("channel").alias("_in"), "author", "ms")
    c = tables["channel"].select(F.col("id").alias("channel"), F.lit(True).alias("_held"), "deleted_at")
    known = asked.select("channel", "message").distinct().join(m, "message", "left").join(c, "channel", "left")
    why = F.when(F.col("_held").isNull() | F.col("deleted_at").isNotNull(), "the channel is closed").when(F.col("_in").isNull() | (F.col("_in") != F.col("channel")), "not in the channel").when(F.col("author") != USER, "not the user's own")
    known = known.withColumn("why", why)
    good = known.filter("why is null").groupBy("channel").agg(F.min("message").alias("first"), F.min_by("ms", "message").alias("at"))
    return good, known.filter("why is not null").select("channel", "message", "why")


def rewound(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """All tables after the rewinds."""
    cut = cuts(tables, asked)[0]
    # Few rows, read by every table: written once.
    path = scratch(cut.sparkSession, "cuts")
    cut.write.parquet(path)
    cut = cut.sparkSession.read.schema(cut.schema).parquet(path)
    out = dict(tables)

    def since(name: str, column: str, bound: str = "at") -> tuple[DataFrame, DataFrame]:
        """(kept, gone) rows of a table: gone are those of a cut channel from its cut on."""
        df = tables[name].join(cut.select(F.col("channel"), F.col(bound).alias("_cut")), "channel", "left").select(*tables[name].columns, "_cut")
        late = F.coalesce(F.col(column) >= F.col("_cut"), F.lit(False))
        return df.filter(~late).drop("_cut"), df.filter(late).drop("_cut")

    out["message"], gone = since("message", "id", "first")
    gone_ids = gone.select(F.col("id").cast("string").alias("ref"))
    if "segment" in tables:
        out["segment"], dropped = since("segment", "opened")
        if "entry" in tables:
            of = tables["segment"].select(F.col("id").alias("segment"), "channel").join(cut, "channel").select("segment", "at")
            held = tables["entry"].join(of, "segment", "left").filter("at is null or ms < at").select(*tables["entry"].columns)
            out["entry"] = held.join(dropped.select(F.col("id").alias("segment")), "segment", "left_anti").select(*tables["entry"].columns)
    for name, column in (("session", "opened"), ("summary", "ms")):
        if name in tables:
            out[name] = since(name, column)[0]
    if "fact" in tables:
        fact = tables["fact"]
        placed = fact.join(cut, "channel", "left").withColumn("_gone", F.coalesce((F.col("created") >= F.col("at")) & ((F.col("author") != USER) | (F.col("kind") == "hurt")), F.lit(False)))
        gone_facts = placed.filter("_gone").select(*fact.columns)
        out["fact"] = placed.filter("not _gone").select(*fact.columns)
        if "seed" in tables:
            refs = lambda df, *kinds: [df.withColumn("kind", F.lit(k)) for k in kinds]
            named = refs(gone_facts.select(F.col("id").cast("string").alias("ref")), "commitment", "memory") + refs(gone_ids, "words")
            dead = named[0].unionByName(named[1]).unionByName(named[2])
            left = tables["seed"].join(dead, ["kind", "ref"], "left_anti").join(gone.select(F.col("id").alias("message")), "message", "left_anti")
            opened = left.join(cut.select("channel", "at"), "channel", "left").withColumn("_late", F.coalesce(F.col("delivered_at") >= F.col("at"), F.lit(False)))
            out["seed"] = opened.filter("not _late").select(*tables["seed"].columns)
            # A commitment that was brought up since may be brought up again.
            again = opened.filter("_late and kind = 'commitment'").select(F.col("ref").alias("_ref")).distinct()
            kept = out["fact"].join(again, F.col("id").cast("string") == F.col("_ref"), "left")
            restored = F.when((F.col("kind") == "commitment") & F.col("_ref").isNotNull(), F.lit(False)).otherwise(F.col("delivered"))
            out["fact"] = kept.withColumn("delivered", restored).select(*fact.columns)
        if "bond" in tables:
            back = gone_facts.filter("kind = 'hurt' and not retracted").groupBy("person").agg(F.sum("trust_delta").alias("_back"))
            trust = F.least(F.col("trust") - F.coalesce("_back", F.lit(0.0)), F.lit(200.0)).alias("trust")
            out["bond"] = tables["bond"].join(back, "person", "left").select(*[trust if c == "trust" else F.col(c) for c in tables["bond"].columns])
    newest = out["message"].groupBy(F.col("channel").alias("id")).agg(F.max("id").alias("_newest"))
    channel = tables["channel"].join(cut.withColumnRenamed("channel", "id"), "id", "left").join(newest, "id", "left")
    columns = {"read_up_to": F.when(F.col("read_up_to") >= F.col("first"), F.col("_newest")).otherwise(F.col("read_up_to"))}
    if "segment" in tables:
        last = out["segment"].groupBy(F.col("channel").alias("id")).agg(F.max_by("id", "seq").alias("_segment"))
        channel = channel.join(last, "id", "left")
        columns["segment"] = F.when(F.col("first").isNotNull(), F.col("_segment")).otherwise(F.col("segment"))
    out["channel"] = channel.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in tables["channel"].columns])
    if "picture" in tables:
        used = out["message"].filter("picture is not null").select(F.col("picture").alias("hash"))
        out["picture"] = tables["picture"].join(used, "hash", "left_semi")
    return out


def rewind(spark, path: str, asked: DataFrame) -> DataFrame:
    """Rewind the newest version of the world at a path and commit all its tables as the next one; gives the refused rows.

    Without anything to take back no version is made."""
    manifest, version = store.read_corpus(spark, path)
    tables = {name: spark.read.parquet(f"{version}/{name}") for name in manifest["tables"]}
    good, refused = cuts(tables, asked)
    if not good.isEmpty():
        store.write_corpus(rewound(tables, asked), path, manifest)
    return refused


def commit_world(tables: dict[str, DataFrame], path: str) -> str:
    """The first or next version of a world."""
    return store.write_corpus(tables, path, {"format_version": 1, "tables": sorted(tables)})
