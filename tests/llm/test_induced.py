import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import induced


def _brute(text, window):
    n = Counter(tuple(text[i : i + window]) for i in range(len(text) - window + 1))
    return [i + window <= len(text) and n[tuple(text[i : i + window])] > 1 for i in range(len(text))]


@pytest.mark.parametrize("memory,core", [(1 << 24, 1 << 24), (50, 1 << 24), (50, 20), (7, 3)])
def test_against_brute_force(memory, core, monkeypatch):
    """With a small memory queues spill; with a small core the reduced strings do too, level below level."""
    monkeypatch.setattr(induced, "PIECE", 37 if memory <= 50 else 1 << 20)
    rng = random.Random(memory)
    for case in range(150 if core > 50 else 40):
        size = rng.choice([1, 2, 3, 26])
        text = [rng.randint(1, size) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(len(text))
            text += text[a : a + rng.randint(1, 150)]
        window = rng.choice([1, 2, 3, 7, 20, 60])
        got = induced.repeated_starts(np.array(text), window, memory, core)
        want = _brute(text, window)
        assert got.tolist() == want, (case, text, window)
    assert induced.repeated_starts(np.array([], int), 5).tolist() == []


@pytest.mark.parametrize("core", [1 << 24, 10])
def test_order_and_common_prefixes(tmp_path, core):
    rng = random.Random(3)
    for _ in range(60):
        text = [rng.randint(1, 3) for _ in range(rng.randint(2, 120))]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        place = {p: n for n, p in enumerate(order)}
        seen = set()
        for position, prefix in induced.sorted_buckets(np.append(text, 0).astype(np.int32), str(tmp_path), 1 << 20, core):
            position = position.tolist()
            seen.update(position)
            for k in range(1, len(position)):
                a, b = position[k - 1], position[k]
                if len(text) in (a, b):
                    continue
                assert abs(place[a] - place[b]) == 1
                common = 0
                while a + common < len(text) and b + common < len(text) and text[a + common] == text[b + common]:
                    common += 1
                assert prefix[k] == common
        assert seen >= set(range(len(text)))


def test_whole_order_by_recursion(tmp_path):
    rng = random.Random(4)
    for n in (2, 5, 60, 400):
        for size in (1, 2, 4, 30):
            text = [rng.randint(1, size) for _ in range(n)] + [0]
            order, common = induced._order(np.array(text), induced.Room(str(tmp_path), 30, 5))
            assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
            for k in range(1, n + 1):
                a, b = text[order[k] :], text[order[k - 1] :]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y))
                assert common[k] == min(same, induced.CAP)


def test_spills_at_production_parameters(monkeypatch):
    spills = []
    spill = induced.BucketQueue._spill
    monkeypatch.setattr(induced.BucketQueue, "_spill", lambda self: (spills.append(self.name), spill(self))[1])
    rng = np.random.default_rng(5)
    text = rng.integers(1, 27, 3 << 20)
    text[2_000_000:2_000_500] = text[1_000_000:1_000_500]
    again = induced.repeated_starts(text, 200)
    assert np.flatnonzero(again).tolist() == [*range(1_000_000, 1_000_301), *range(2_000_000, 2_000_301)]
    assert spills
    # The same with a recursion: a text of four times what is ranked in memory.
    small = text[1_940_000:2_000_000].copy()
    small[40_000:40_500] = small[10_000:10_500]
    assert np.flatnonzero(induced.repeated_starts(small, 200, 1 << 12, 15_000)).tolist() == [*range(10_000, 10_301), *range(40_000, 40_301)]
