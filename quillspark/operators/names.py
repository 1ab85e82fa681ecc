"""Which lines hold a name of their own speaker: an Aho-Corasick automaton over all names and aliases.

Names of up to ``piece_bytes`` together go to every task, which builds one automaton and reads each line once,
however many names there are. Larger tables are cut into pieces by speaker (a speaker with more names than a piece
into several), and a line meets only its own speaker's pieces; lines of one piece are dealt into parts of about
``part_bytes``, so a speaker with a third of all lines is many tasks.

Cases: null lines hold nothing; null or short names, and those without a speaker, are no names; a name of several
speakers counts for each; names match anywhere in a line, with case."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 2
PIECE_BYTES = 4 << 20
PART_BYTES = 32 << 20


def automaton(pairs: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """Finds all names; each carries the speakers who have it."""
    owners: dict[str, set] = {}
    for speaker, name in pairs:
        owners.setdefault(name, set()).add(speaker)
    out = ahocorasick.Automaton()
    for name, own in owners.items():
        out.add_word(name, frozenset(own))
    if owners:
        out.make_automaton()
    return out


def _holds(machine: ahocorasick.Automaton, speaker: object, line: str | None) -> bool:
    return bool(line) and len(machine) > 0 and any(speaker in own for _, own in machine.iter(line))


def own_name_lines(lines: DataFrame, names: DataFrame, speaker: str, name: str, key: str, text: str, min_chars: int = MIN_CHARS, piece_bytes: int = PIECE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``speaker, key`` of the lines that hold a name of their speaker. names: ``speaker, name``."""
    said = lines.select(F.col(speaker).alias("speaker"), F.col(key).alias("key"), F.col(text).alias("line")).filter("speaker is not null and line is not null")
    known = names.select(F.col(speaker).alias("speaker"), F.col(name).alias("name")).filter((F.length("name") >= min_chars) & F.col("speaker").isNotNull()).distinct()
    size = F.sum(F.octet_length("name") + 16)
    total = known.agg(size).first()[0] or 0
    schema = f"speaker {said.schema['speaker'].dataType.simpleString()}, key {said.schema['key'].dataType.simpleString()}"
    if total <= piece_bytes:
        pairs = [(r["speaker"], r["name"]) for r in known.collect()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(pairs)
            for batch in batches:
                speakers = batch.column(0).to_pylist()
                keep = pa.array([_holds(machine, s, line.as_py()) for s, line in zip(speakers, batch.column(2), strict=True)], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

        return said.mapInArrow(scan, schema).withColumnsRenamed({"speaker": speaker, "key": key})
    piece = F.pmod(F.xxhash64("speaker"), F.lit(-(-total // piece_bytes))).alias("piece")
    sizes = known.groupBy(piece).agg(F.ceil(size / piece_bytes).alias("slices"))
    volume = said.groupBy(piece).agg(F.ceil((F.sum(F.octet_length("line")) + 1) / part_bytes).alias("parts"))
    both = sizes.join(volume, "piece")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = said.withColumn("piece", piece).join(both, "piece").select("piece", each("slices").alias("slice"), F.pmod(F.xxhash64("key"), "parts").alias("part"), "speaker", "key", "line")
    right = known.withColumn("piece", piece).join(both, "piece").select("piece", F.pmod(F.xxhash64("name"), "slices").alias("slice"), each("parts").alias("part"), "speaker", "name")

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        machine = automaton(list(zip(two["speaker"], two["name"], strict=True)))
        keep = [_holds(machine, s, line) for s, line in zip(one["speaker"], one["line"], strict=True)]
        return one.loc[keep, ["speaker", "key"]]

    by = ["piece", "slice", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, schema)
    return found.distinct().withColumnsRenamed({"speaker": speaker, "key": key})


def name_leaks(lines: DataFrame, names: DataFrame, speaker: str, name: str, key: str, text: str, min_lines: int = 1, **sizes: int) -> DataFrame:
    """``speaker, leaks, n`` for speakers with at least ``min_lines`` lines: how many of them hold their own name or an alias."""
    spoken = lines.filter(F.col(speaker).isNotNull() & F.col(text).isNotNull()).groupBy(speaker).agg(F.count("*").alias("n")).filter(F.col("n") >= min_lines)
    leaked = own_name_lines(lines, names, speaker, name, key, text, **sizes).groupBy(speaker).agg(F.count("*").alias("leaks"))
    return spoken.join(leaked, speaker, "left").select(speaker, F.coalesce("leaks", F.lit(0)).alias("leaks"), "n")


def leak_share(leaks: DataFrame) -> DataFrame:
    """One row: the share of all counted lines; null without any."""
    return leaks.agg(F.round(F.try_divide(F.sum("leaks"), F.sum("n")), 6).alias("share"))
