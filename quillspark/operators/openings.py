"""Opening plans: who may open a conversation at an occasion, or why nobody does.

The conditions that don't depend on earlier openings come as columns, made for all occasions in set queries. Those that
do, the day's total, the gap, the slot of the day's part, and each person's share, are folded: one stream a user over
sorted rows, which keeps the openings of the day and the last instant only.

The first that holds of: away; no seed; the quota isn't open; quiet hours; in a conversation; the day's total is
reached (slots that passed while away count); and for a presence, too soon after the last opening; the slot of this
part of the day hasn't come, or both its places, one direct and one in a group, are taken. Then candidates in order:
one whose place in this part is taken waits, one who had his share of the day is passed over (in a group: of that
group). If none is left it is not yet for those who wait, else every share is used.

Cases: null conditions don't hold; null or empty candidates are no seed; ties in time go by id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

DAY_MS = 86_400_000

_CONDITIONS = ["presence", "away", "open", "quiet", "talking", "spent", "part", "come", "candidates"]


@dataclass
class Limits:
    """Openings a day, minutes between them, openings a person and day."""

    daily_total: int = 3
    gap_min: int = 60
    per_person: int = 1


def planned(row: dict, opened: list[tuple], last: int | None, limits: Limits) -> tuple[str, dict | None]:
    """(outcome, candidate that opens). opened: (part, person, channel, whether a group) of the day's openings."""
    if row["away"]:
        return "away", None
    if not row["candidates"]:
        return "no_seed", None
    if not row["open"]:
        return "quota", None
    if row["quiet"]:
        return "quiet_hours", None
    if row["talking"]:
        return "in_conversation", None
    if len(opened) + (row["spent"] or 0) >= limits.daily_total:
        return "daily_total", None
    direct = group = False
    if row["presence"]:
        if last is not None and row["ms"] - last < limits.gap_min * 60_000:
            return "too_soon", None
        direct = any(part == row["part"] and not g for part, _, _, g in opened)
        group = any(part == row["part"] and g for part, _, _, g in opened)
        if not row["come"] or (direct and group):
            return "not_yet", None
    waits = False
    for c in row["candidates"]:
        if c["grp"]:
            if group:
                waits = True
            elif sum(g and p == c["person"] and x == c["channel"] for _, p, x, g in opened) < limits.per_person:
                return "open", c
        elif sum(not g and p == c["person"] for _, p, _, g in opened) < limits.per_person:
            if not direct:
                return "open", c
            waits = True
    return ("not_yet" if waits else "per_person"), None


def opening_plan(occasions: DataFrame, user: str, limits: Limits | None = None) -> DataFrame:
    """``user, id, outcome, person, channel`` for every occasion.

    occasions: ``user, ms, id``, the conditions ``presence, away, open, quiet, talking`` (booleans), ``spent`` (slots used
    while away), ``part`` and ``come`` (the day's part, and whether its slot has come), and ``candidates``, structs of
    ``person, channel, grp`` in order."""
    limits = limits or Limits()
    rows = occasions.select(user, "ms", "id", *_CONDITIONS)
    kind = rows.schema[user].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, day, opened, last = False, None, None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[user] != at:
                    begun, at, day, opened, last = True, row[user], None, [], None
                if row["ms"] // DAY_MS != day:
                    day, opened = row["ms"] // DAY_MS, []
                outcome, c = planned(row, opened, last, limits)
                if c:
                    last = row["ms"]
                    opened.append((row["part"], c["person"], c["channel"], c["grp"]))
                out.append((outcome, c and c["person"], c and c["channel"]))
            own = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], names=[user, "id", "outcome", "person", "channel"])

    return rows.repartition(user).sortWithinPartitions(user, "ms", "id").mapInArrow(run, f"{user} {kind}, id long, outcome string, person long, channel long")
