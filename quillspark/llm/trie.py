"""Conversation prefix trie: nodes, subtree leaves and savings by the Euler-tour technique.

Trie: a node is a distinct sequence of first turns (role and text). Turns are digested once; running digests of
a conversation's turns (chunks of ``CHUNK`` turns, then the chunks) name its prefixes, and equal names meet in one
aggregation. A node is called by its smallest member and its depth, which no other node shares.

Tour: each node has an enter and an exit arc. Enter leads to the first child's enter (children by smallest member),
or to the own exit; exit leads to the next sibling's enter, or to the parent's exit. Runs of nodes without a branch
are one pair of arcs, weighted by their number. The list is ranked by contraction: of each round's arcs those go
whose hash is below that of both neighbours (a third of them), and what is left, at most ``LIST_ARCS`` arcs, is
walked in one task; then the rounds come back in reverse, each arc next to the neighbour that outlived it. Running
sums of leaves and savings at the arcs' positions, taken at exit less before enter, are those of the subtree.

No step gathers a group: turns of one conversation and children of one node are ordered by range partitions whose
counts are summed, not in one task; digests of member lists are fed piece by piece.

Cases: turns are ordered with null first, ties by the digest of role and text (so equal rows are interchangeable,
each a turn of its own); null role or text is empty; rows with a null id are no conversation; an empty table has no
nodes, not even a root; only the four named columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored

FAMILY = 5
MOST_SHARED = 8
CHUNK = 4096
LIST_ARCS = 1 << 15
SUM_ARCS = 1 << 16
PIECE_IDS = 1024

_ARC = "struct<c:long,d:long,s:int>"


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, turn, dig, bytes``: each row's digest of role and text, and the text's size."""
    role, text = (F.coalesce(rows[x].cast("string"), F.lit("")) for x in (role_col, text_col))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.filter(rows[id_col].isNotNull()).select(
        rows[id_col].cast("long").alias("c"), rows[turn_col].alias("turn"), F.unhex(F.sha2(framed, 256)).alias("dig"), F.octet_length(text).cast("long").alias("bytes")
    )


def sliced(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows dealt by range of (group, order) and written, so that a group of any size lies in several slices (``slice``)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *group, *order).withColumn("slice", F.spark_partition_id()), name)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``pos`` from 1 within each group, by the order: places in a slice, after the counts of earlier slices."""
    cut = sliced(rows, group, order, name)
    counts = cut.groupBy(*group, "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("slice")) - F.col("n")
    offsets = counts.select(*group, "slice", before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*group, "slice").orderBy(*order))
    return cut.withColumn("place", place).join(offsets, [*group, "slice"]).withColumn("pos", F.col("before") + F.col("place")).drop("slice", "place", "before")


def _shared(c: Column) -> Column:
    """How many turns of its family's first conversation a conversation starts with."""
    return F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``c``) and their rebuilt turns (``c, d, dig, bytes``): h turns of c - c % 5, then the own ones after h."""
    own = stored(numbered(turns, ["c"], ["turn", "dig"], "turn-slices").select("c", "pos", "dig", "bytes"), "turns")
    lengths = own.groupBy("c").agg(F.max("pos").alias("length"))
    base = lengths.select(F.col("c").alias("base"), F.col("length").alias("base_length"))
    all_ = lengths.select("c", _shared(F.col("c")).alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base"))
    all_ = stored(all_.join(base, "base", "left").select("c", "h", "base", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken")), "conversations")
    first = own.filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("c", "base").join(all_.select("c", "base", "taken"), "base").filter("pos <= taken")
    rest = own.filter(F.col("pos") > _shared(F.col("c"))).join(all_.select("c", "h", "taken"), "c")
    return all_.select("c"), first.select("c", F.col("pos").alias("d"), "dig", "bytes").unionByName(rest.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "dig", "bytes"))


def _running(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The digest over each group's values up to each row (``name``) and before it (``before``; null at first), in one stream a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for batch in batches:
            names, befores = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(group))), strict=True)
            for key, digest in zip(keys, batch.column(len(group) + 1).to_pylist(), strict=True):
                if key != held:
                    held, name = key, None
                befores.append(name)
                name = hashlib.sha256((name or b"") + digest).digest()
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary()), pa.array(befores, pa.binary())], names=[*batch.schema.names, "name", "before"])

    kept = rows.select(*group, order, value, *[c for c in rows.columns if c not in {*group, order, value}])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", name binary, before binary"
    return kept.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, schema)


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``c, d, key, above, bytes``: the name of each prefix, of the prefix before it (null: the root), the last text's size."""
    within = _running(turns.withColumn("part", F.expr(f"(d - 1) div {chunk}")), ["c", "part"], "d", "dig").select("c", "part", "d", "bytes", "name", "before")
    within = stored(within, "running")
    full = _running(within.filter(F.col("d") % chunk == 0).select("c", "part", "name").withColumnRenamed("name", "whole"), ["c"], "part", "whole")
    earlier = full.select("c", (F.col("part") + 1).alias("part"), F.col("name").alias("outer"))
    joined = within.join(earlier, ["c", "part"], "left")
    outer = F.coalesce("outer", F.lit(b""))
    whole = lambda x: F.unhex(F.sha2(F.concat(outer, x), 256))
    # Before the first turn of a chunk stands all of the chunks before it.
    above = F.when(F.col("before").isNull(), F.col("outer")).otherwise(whole("before"))
    return joined.select("c", "d", whole("name").alias("key"), above.alias("above"), "bytes")


def member_digests(ends: DataFrame, piece: int = PIECE_IDS) -> DataFrame:
    """``key, digest``: SHA-256 of the ids of each key in order, joined by commas. ends: ``key, c``.

    Ids are joined to pieces where they lie; one stream per key then takes the pieces."""
    cut = sliced(ends, ["key"], ["c"], "members")
    place = F.row_number().over(Window.partitionBy("key", "slice").orderBy("c")) - 1
    pieces = cut.withColumn("part", F.floor(place / piece)).groupBy("key", "slice", "part").agg(F.array_sort(F.collect_list("c")).alias("ids"))
    pieces = pieces.select("key", F.element_at("ids", 1).alias("first"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key == held:
                    digest.update(b",")
                else:
                    if held is not None:
                        keys.append(held)
                        digests.append(digest.hexdigest())
                    held, digest = key, hashlib.sha256()
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "digest"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "digest"])

    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(run, "key binary, digest string")


def nodes_of(conversations: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, depth, parent, siblings, n_convs, n_children, child, bytes, ends_sha256`` for every node.

    parent: the parent's conv_id; siblings: the parent's number of children; child: the first child's conv_id."""
    root = F.lit(b"").cast("binary")
    steps = prefixes(turns, chunk).select("c", "d", "key", F.coalesce("above", root).alias("above"), "bytes")
    tops = conversations.select("c", F.lit(0).cast("long").alias("d"), root.alias("key"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("bytes"))
    steps = stored(steps.unionByName(tops), "prefixes")
    named = steps.groupBy("key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("d").alias("depth"), F.first("above").alias("above"), F.first("bytes").alias("bytes"))
    named = stored(named, "nodes")
    ends = steps.groupBy("c").agg(F.max_by("key", "d").alias("key"))
    below = named.filter("above is not null").groupBy("above").agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child")).withColumnRenamed("above", "key")
    full = stored(named.join(below, "key", "left").join(member_digests(ends), "key", "left"), "full-nodes")
    released(steps, named)
    parents = full.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"), F.col("n_children").alias("siblings"))
    return full.join(parents, "above", "left").select(
        "conv_id", "depth", "parent", F.coalesce("siblings", F.lit(0)).alias("siblings"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "child", "bytes", F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _arc(c: str, d: Column | str, side: int) -> Column:
    return F.struct(F.col(c).alias("c"), (F.col(d) if isinstance(d, str) else d).alias("d"), F.lit(side).alias("s")).cast(_ARC)


def tour(nodes: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Nodes with the top of their run (``top``), and the arcs of the runs: ``at, next, w``.

    A run is a chain of only children under one conversation's name; enter is named by its top, exit by its bottom."""
    breaks = (F.col("siblings") != 1) | (F.col("parent") != F.col("conv_id")) | (F.col("depth") % chunk == 0)
    path = Window.partitionBy("conv_id", F.expr(f"depth div {chunk}")).orderBy("depth")
    nodes = stored(nodes.withColumn("top", F.max(F.when(breaks, F.col("depth"))).over(path)), "runs")
    # Next siblings: of each slice's children in order, and of a slice's last the first of the next slice.
    brothers = sliced(nodes.filter("siblings > 1").select("parent", "depth", "conv_id"), ["parent", "depth"], ["conv_id"], "siblings")
    firsts = brothers.groupBy("parent", "depth", "slice").agg(F.min("conv_id").alias("first"))
    firsts = firsts.select("parent", "depth", "slice", F.lead("first").over(Window.partitionBy("parent", "depth").orderBy("slice")).alias("after"))
    following = F.lead("conv_id").over(Window.partitionBy("parent", "depth", "slice").orderBy("conv_id"))
    following = brothers.withColumn("following", following).join(firsts, ["parent", "depth", "slice"]).select("conv_id", F.col("depth").alias("top"), F.coalesce("following", "after").alias("sibling"))
    runs = nodes.groupBy("conv_id", "top").agg(F.max("depth").alias("bottom"), F.max_by("child", "depth").alias("child"), F.min_by("parent", "depth").alias("parent"))
    runs = stored(runs.join(following, ["conv_id", "top"], "left"), "tour-runs")
    w = F.col("bottom") - F.col("top") + 1
    exit_ = _arc("conv_id", "bottom", 1)
    enters = runs.select(_arc("conv_id", "top", 0).alias("at"), F.when(F.col("child").isNotNull(), _arc("child", F.col("bottom") + 1, 0)).otherwise(exit_).alias("next"), w.alias("w"))
    up = F.when(F.col("parent").isNotNull(), _arc("parent", F.col("top") - 1, 1))
    exits = runs.select(exit_.alias("at"), F.when(F.col("sibling").isNotNull(), _arc("sibling", "top", 0)).otherwise(up).alias("next"), w.alias("w"))
    return nodes, enters.unionByName(exits)


def ranked(arcs: DataFrame, most: int = LIST_ARCS) -> DataFrame:
    """``at, pos``: the weight of all arcs before each one. arcs: one list of ``at, next, w`` (the last one's next is null)."""
    now, rounds = stored(arcs, "arcs"), []
    while now.count() > max(most, 8):  # both ends always stay
        lot = lambda x: F.xxhash64(F.lit(len(rounds)), x)  # noqa: B023, E731
        before = now.filter("next is not null").select(F.col("next").alias("at"), F.col("at").alias("prev"), F.col("w").alias("prev_w"))
        out = F.col("prev").isNotNull() & F.col("next").isNotNull() & (lot("at") < lot("prev")) & (lot("at") < lot("next"))
        both = stored(now.join(before, "at", "left").withColumn("out", F.coalesce(out, F.lit(False))), "contraction")
        gone = both.filter("out").select(F.col("prev").alias("at"), F.col("next").alias("new_next"), F.col("w").alias("more"))
        left = both.filter("not out").select("at", "next", "w").join(gone, "at", "left")
        released(now)
        now = stored(left.select("at", F.when(F.col("more").isNotNull(), F.col("new_next")).otherwise(F.col("next")).alias("next"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")), "arcs")
        rounds.append(both)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow: dict = {}
        for batch in batches:
            at, after = ([tuple(x.values()) if x else None for x in batch.column(i).to_pylist()] for i in (0, 1))
            follow |= zip(at, zip(after, batch.column(2).to_pylist(), strict=True), strict=True)
        if not follow:
            return
        arc, pos, found, places = (follow.keys() - {x for x, _ in follow.values()}).pop(), 0, [], []
        while arc is not None:
            found.append(dict(zip("cds", arc, strict=True)))
            places.append(pos)
            arc, w = follow[arc]
            pos += w
        kind = pa.struct([("c", pa.int64()), ("d", pa.int64()), ("s", pa.int32())])
        yield pa.RecordBatch.from_arrays([pa.array(found, kind), pa.array(places, pa.int64())], names=["at", "pos"])

    places = stored(now.repartition(1).mapInArrow(walk, f"at {_ARC}, pos long"), "positions")
    for both in reversed(rounds):
        again = both.filter("out").select(F.col("at").alias("arc"), F.col("prev").alias("at"), "prev_w").join(places, "at")
        grown = stored(places.unionByName(again.select(F.col("arc").alias("at"), (F.col("pos") + F.col("prev_w")).alias("pos"))), "positions")
        released(places, both)
        places = grown
    return places


def subtrees(nodes: DataFrame, places: DataFrame, block: int = SUM_ARCS) -> DataFrame:
    """Nodes with ``n_leaves`` and ``saved_tokens`` of their subtrees, from running sums at the arcs' positions."""
    enter = places.filter("at.s = 0").select(F.col("at.c").alias("conv_id"), F.col("at.d").alias("top"), F.col("pos").alias("enter"))
    leave = places.filter("at.s = 1").select(F.col("at.c").alias("conv_id"), F.col("at.d").alias("bottom"), F.col("pos").alias("leave"))
    bottoms = nodes.groupBy("conv_id", "top").agg(F.max("depth").alias("bottom"))
    runs = bottoms.join(enter, ["conv_id", "top"]).join(leave, ["conv_id", "bottom"])
    placed = nodes.join(runs, ["conv_id", "top"])
    own = F.struct("parent", "n_convs", "n_children", "ends_sha256")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    zero = F.lit(0).cast("long")
    ins = placed.select((F.col("enter") + F.col("depth") - F.col("top")).alias("pos"), "conv_id", "depth", own.alias("own"), leaf.alias("leaf"), saved.alias("saved"))
    outs = placed.select((F.col("leave") + F.col("bottom") - F.col("depth")).alias("pos"), "conv_id", "depth", F.lit(None).cast(ins.schema["own"].dataType).alias("own"), zero.alias("leaf"), zero.alias("saved"))
    arcs = stored(ins.unionByName(outs).withColumn("block", F.expr(f"pos div {block}")), "weighted-arcs")
    sums = arcs.groupBy("block").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("savings"))
    # One row for each block of positions.
    earlier = Window.partitionBy(F.lit(1)).orderBy("block")
    sums = sums.select("block", *[(F.sum(x).over(earlier) - F.col(x)).alias(x) for x in ("leaves", "savings")])
    inner = Window.partitionBy("block").orderBy("pos")
    run = arcs.select("*", F.sum("leaf").over(inner).alias("leaf_sum"), F.sum("saved").over(inner).alias("saved_sum")).join(sums, "block")
    entering = F.col("own").isNotNull()
    # Up to and with the exit arc, less what is before the enter arc.
    part = lambda a, b, c: F.sum(F.when(entering, F.col(c) - F.col(a) - F.col(b)).otherwise(F.col(a) + F.col(b)))
    out = run.groupBy("conv_id", "depth").agg(F.max("own").alias("own"), part("leaf_sum", "leaves", "leaf").alias("n_leaves"), part("saved_sum", "savings", "saved").alias("saved_tokens"))
    return out.select("conv_id", "depth", F.col("own.parent").alias("parent_conv_id"), "own.n_convs", "own.n_children", "n_leaves", "saved_tokens", "own.ends_sha256")


def prefix_trie(rows: DataFrame, chunk: int = CHUNK, most: int = LIST_ARCS, block: int = SUM_ARCS, **columns: str) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    bounded_batches(rows.sparkSession)
    turns = stored(turns_of(rows, **columns), "turn-digests")
    conversations, own = rebuilt(turns)
    nodes, arcs = tour(nodes_of(conversations, own, chunk), chunk)
    return subtrees(nodes, ranked(arcs, most), block)


#: The same in DuckDB: members of every prefix, and of every node all prefixes of its smallest member.
ORACLE = f"""
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
base AS (
  SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS pos FROM base),
lengths AS (SELECT c, max(pos) AS n FROM own GROUP BY c),
convs AS (
  SELECT l.c, l.h, least(l.h, coalesce(b.n, 0)) AS taken FROM (
    SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
             lambda acc, b: xor(acc // 256, t[xor(acc, b) % 256 + 1])), 4294967295) % {MOST_SHARED + 1} AS h
    FROM lengths, tab) l LEFT JOIN lengths b ON b.c = l.c - l.c % {FAMILY}),
turns AS (
  SELECT v.c, o.pos AS d, o.dig, o.bytes FROM convs v JOIN own o ON o.c = v.c - v.c % {FAMILY} AND o.pos <= v.taken
  UNION ALL
  SELECT v.c, o.pos - v.h + v.taken, o.dig, o.bytes FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h),
steps AS (
  SELECT c, d, string_agg(dig, '') OVER (PARTITION BY c ORDER BY d) AS key, bytes FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs),
chained AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above, max(d) OVER (PARTITION BY c) AS last FROM steps),
nodes AS (
  SELECT key, any_value(above) AS above, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM chained GROUP BY key),
kids AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
below AS (
  SELECT s.key, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_ f JOIN steps s ON s.c = f.conv_id AND s.d <= f.depth GROUP BY s.key)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below b USING (key) LEFT JOIN full_ p ON p.key = f.above
"""
