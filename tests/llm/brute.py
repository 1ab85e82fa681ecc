"""Brute-force versions of the operators, over plain Python lists."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring(rows, window=50):
    """rows: (doc_id, text); {row number: (n_words, n_removed, sha)}"""
    last = 2**63 - 1
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        i = last if i is None else i
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (last if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def near(rows, size=5, over=75, under=100):
    """rows: (doc_id, text); (doc_id, n_shingles, component_id, kept) of each."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if under * both >= over * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(i), top(j)))
                    up[y] = x
    return [(i, len(s), top(i) if i is not None and s else i, True if i is None else (top(i) if s else i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def byte_repeats(rows, window=200):
    """rows: (doc_id, text); (doc_id, n_bytes, n_removed, n_spans, sha) of each."""
    texts = [(t or "").encode() for _, t in rows]
    times = {}
    for t in texts:
        for p in range(len(t) - window + 1):
            times[t[p : p + window]] = times.get(t[p : p + window], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if times[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        out.append((i, len(t), sum(gone), sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])), sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out
