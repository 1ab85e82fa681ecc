"""A ledger of trust: what each step changed, exactly, so that a hurt can be taken back and put again.

Growth depends on the trust there is, so a person's steps go in order; they stream over sorted rows, a ledger row for
each, and only the hurts' deltas are kept. Steps: ``grow`` adds g * f(trust); ``hurt`` takes h * (0.5 + trust / 200), at
most what there is; ``undo`` of a hurt gives back what it took; ``redo`` of one that was undone takes as much again, at most
what there is then, and remembers that. Trust stays within 0..200.

Cases: a person starts at ``start``; an undo of a hurt that isn't there or is undone already, a redo of one that isn't
undone, and other steps change nothing; ties in time go by id; a null person is one person."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
START, GAIN, HURT = 50.0, 0.5, 15.0


def growth(trust: float) -> float:
    """Full up to 100, then less and less, nothing at 200."""
    return 1.0 if trust <= 100.0 else max(0.0, 1.0 - ((trust - 100.0) / 100.0) ** 2)


def stepped(trust: float, step: str, ref: object, at: object, deltas: dict, undone: set, gain: float, hurt: float) -> float:
    """Trust after a step; deltas and undone are kept up to date."""
    if step == "grow":
        return min(max(trust + gain * growth(trust), 0.0), 200.0)
    if step == "hurt":
        after = max(trust - hurt * (0.5 + trust / 200.0), 0.0)
        deltas[at] = after - trust
        return after
    if step == "undo" and ref in deltas and ref not in undone:
        undone.add(ref)
        return min(trust - deltas[ref], 200.0)
    if step == "redo" and ref in undone:
        undone.discard(ref)
        after = max(trust + deltas[ref], 0.0)
        deltas[ref] = after - trust
        return after
    return trust


def trust_ledger(steps: DataFrame, key: str, start: float = START, gain: float = GAIN, hurt: float = HURT) -> DataFrame:
    """``key, ms, id, step, before, trust`` for every step. steps: ``key, ms, id, step, ref``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, person, trust, deltas, undone = False, None, start, {}, set()
        for batch in batches:
            before, after = [], []
            for own, at, step, ref in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not begun or own != person:
                    begun, person, trust, deltas, undone = True, own, start, {}, set()
                before.append(trust)
                trust = stepped(trust, step, ref, at, deltas, undone, gain, hurt)
                after.append(trust)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(before, pa.float64()), pa.array(after, pa.float64())], names=[*batch.schema.names[:4], "before", "trust"])

    ordered = steps.select(key, "ms", "id", "step", "ref").repartition(key).sortWithinPartitions(key, "ms", "id")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields[:4])
    return ordered.mapInArrow(run, f"{kind}, before double, trust double")


def trust_now(ledger: DataFrame, key: str) -> DataFrame:
    """``key, trust``: after each person's last step."""
    last: Column = F.max_by("trust", F.struct("ms", "id"))
    return ledger.groupBy(key).agg(F.round(last, 6).alias("trust"))
