"""External induced suffix sorting: disk-backed queues, recursive reduction, common prefixes carried along.

Suffixes are of type S (smaller than the next one) or L; the leftmost S suffixes (S*) are sorted first. L suffixes
are induced from the sorted S* in one ascending pass, S suffixes from the sorted L in one descending pass. A
priority queue by first character, arrival order within, hands out suffixes; beyond ``memory`` entries it spills
runs to files, which are read back in pieces. Every entry carries the common prefix with the entry before it in the
same bucket: one more than the least common prefix between their sources, read off as the pass goes.

The S* suffixes are sorted by recursion: two passes over S* in text order sort their substrings, equal substrings
get one name, and the string of names (a half of the text at most) is sorted in the same way; common prefixes in
names become common prefixes in characters. Texts of up to ``core`` characters end the recursion: their S* are
ranked in memory by doubling. Beyond that all arrays as long as the text are files.

Common prefixes are capped at ``CAP``; suffixes that agree further may stand in any order."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CAP = 255
PIECE = 1 << 20

#: Entries of a queue in memory, and characters of a text whose S* suffixes are ranked in memory.
MEMORY = 1 << 20
CORE = 1 << 23

Piece = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Room:
    """Where arrays and queues lie, and how much of them may be in memory."""

    folder: str
    memory: int = MEMORY
    core: int = CORE
    level: int = 0

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{self.level}-{name}")

    def array(self, name: str, n: int, dtype: type, value: int = 0) -> np.ndarray:
        """An array of n equal values; beyond ``core`` items it is a file."""
        if n <= self.core:
            return np.full(n, value, dtype)
        out = np.memmap(self.path(name), dtype, "w+", shape=(n,))
        if value:
            out[:] = value
        return out

    def below(self) -> Room:
        return Room(self.folder, self.memory, self.core, self.level + 1)


class BucketQueue:
    """Queues of (position, common prefix), one for each character; spilled in runs sorted by character."""

    def __init__(self, room: Room, name: str):
        self.room, self.name = room, name
        self.held: dict[int, list[Piece]] = {}
        self.count = 0
        #: Characters, bounds of their entries, and path of each run.
        self.runs: list[tuple[np.ndarray, np.ndarray, str]] = []
        self.at, self.read = -1, 0

    def put(self, c: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position):
            self.held.setdefault(c, []).append((position, prefix))
            self.count += len(position)
            if self.count > self.room.memory:
                self._spill()

    def _spill(self) -> None:
        path = self.room.path(f"{self.name}-{len(self.runs)}")
        chars, sizes = sorted(self.held), []
        with open(f"{path}-position", "wb") as a, open(f"{path}-prefix", "wb") as b:
            for c in chars:
                for position, prefix in self.held[c]:
                    position.astype(np.int64).tofile(a)
                    prefix.astype(np.uint8).tofile(b)
                sizes.append(sum(len(x) for x, _ in self.held[c]))
        index = [np.array(chars, np.int64), np.append(0, np.cumsum(sizes)).astype(np.int64)]
        if len(chars) > 4096:
            for k, x in enumerate(index):
                np.save(f"{path}-{k}.npy", x)
                index[k] = np.load(f"{path}-{k}.npy", mmap_mode="r")
        self.runs.append((index[0], index[1], path))
        self.held, self.count = {}, 0

    def pieces(self, c: int, backwards: bool = False) -> Iterator[Piece]:
        """The bucket's entries in order (or from the end), piece by piece; the bucket is empty from the start,
        and entries put meanwhile wait for the next call. Characters are asked for one after the other."""
        if c != self.at:
            self.at, self.read = c, 0
        fresh = self.runs[self.read :]
        self.read = len(self.runs)
        held = self.held.pop(c, [])
        self.count -= sum(len(p) for p, _ in held)
        memory = [(np.concatenate([p for p, _ in held]), np.concatenate([x for _, x in held]))] if held else []
        spans = []
        for chars, bounds, path in fresh:
            k = int(np.searchsorted(chars, c))
            if k < len(chars) and chars[k] == c:
                a, b = int(bounds[k]), int(bounds[k + 1])
                spans += [(path, i, min(PIECE, b - i)) for i in range(a, b, PIECE)]
        if backwards:
            yield from memory
            spans.reverse()
        for path, i, n in spans:
            yield np.fromfile(f"{path}-position", np.int64, n, offset=8 * i), np.fromfile(f"{path}-prefix", np.uint8, n, offset=i)
        if not backwards:
            yield from memory


def _types(text: np.ndarray, room: Room) -> np.ndarray:
    """Which suffixes are of type S: read from the end, piece by piece."""
    b = len(text) - 1
    out = room.array("types", b + 1, bool)
    out[b] = s = True
    while b > 0:
        a = max(0, b - PIECE)
        piece = np.asarray(text[a : b + 1])
        at = np.where(piece[:-1] != piece[1:], np.arange(b - a), b - a)
        following = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.append(piece[:-1] < piece[1:], s)[following]
        s, b = bool(out[a]), a
    return out


def _stars(s_type: np.ndarray, room: Room) -> np.ndarray:
    """Places of the leftmost S suffixes, in text order."""
    path, n = room.path("stars"), 0
    with open(path, "wb") as file:
        for a in range(1, len(s_type), PIECE):
            b = min(len(s_type), a + PIECE)
            found = a + np.flatnonzero(s_type[a:b] & ~s_type[a - 1 : b - 1])
            found.astype(np.int64).tofile(file)
            n += len(found)
    return np.fromfile(path, np.int64) if n <= room.core else np.memmap(path, np.int64, "r", shape=(n,))


def _run(text: np.ndarray, p: int) -> int:
    """Length of the run of equal characters at p, up to ``CAP``."""
    piece = text[p : p + CAP]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _counts(text: np.ndarray, alphabet: int, room: Room, name: str, at: np.ndarray | None = None) -> np.ndarray:
    """Where each character's items begin (and, last, where all end): of the text, or of its places ``at``."""
    out = room.array(name, alphabet + 1, np.int64)
    n = len(text) if at is None else len(at)
    for a in range(0, n, PIECE):
        c, k = np.unique(text[a : a + PIECE] if at is None else text[at[a : a + PIECE]], return_counts=True)
        out[c + 1] += k
    np.cumsum(out, out=out)
    return out


def _sorted_stars(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray) -> Piece:
    """S* suffixes in order, and each one's common prefix with the one before: ranked in memory."""
    m = len(stars)
    length = np.append(np.diff(stars), 0) + 1  # to the next S*, inclusive
    symbol = text.astype(np.int64) * 2 + s_type + 1
    bits = int(symbol.max()).bit_length()
    wide = 62 // bits
    symbol = np.append(symbol, np.zeros(wide, np.int64))
    rank = np.zeros(m, np.int64)
    groups = 1
    at = 0
    most = int(length.max())
    while at < most:
        # As many more symbols of each substring as one number holds; past its end zeros.
        key = np.zeros(m, np.int64)
        for k in range(wide):
            here = at + k
            key = (key << bits) | np.where(here < length, symbol[np.minimum(stars + here, len(text))], 0)
        order = np.lexsort((key, rank)) if groups > 1 else np.argsort(key, kind="stable")
        new = np.ones(m, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (rank[order][1:] != rank[order][:-1])
        ranked = np.empty(m, np.int64)
        ranked[order] = np.cumsum(new) - 1
        rank, groups = ranked, int(new.sum())
        at += wide
        if groups == m:
            break
    levels = [rank]
    span = 1
    while groups < m and 2 * span <= CAP:  # an S* substring advances two characters at least
        follow = np.full(m, -1, np.int64)
        follow[: m - span] = rank[span:]
        key = rank * (m + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(m, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        ranked = np.empty(m, np.int64)
        ranked[order] = np.cumsum(new) - 1
        rank, groups = ranked, int(new.sum())
        levels.append(rank)
        span *= 2
    order = np.argsort(rank, kind="stable")
    # Common prefixes: whole names first, by the ranks of each level from the widest, then characters.
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        for _ in range(2 if level == len(levels) - 1 else 1):
            fits = (a + step <= m) & (b + step <= m)
            fits[fits] = levels[level][a[fits]] == levels[level][b[fits]]
            a, b = a + step * fits, b + step * fits
    end = len(text) - 1
    i = np.where(a < m, stars[np.minimum(a, m - 1)], end)
    j = np.where(b < m, stars[np.minimum(b, m - 1)], end)
    common = np.minimum(i - stars[order[1:]], CAP)
    live = np.flatnonzero(common < CAP)
    i, j = i[live], j[live]
    while len(live):
        same = (i < end) & (j < end)
        same[same] = text[i[same]] == text[j[same]]
        live, i, j = live[same], i[same] + 1, j[same] + 1
        common[live] += 1
        more = common[live] < CAP
        live, i, j = live[more], i[more], j[more]
    return stars[order], np.concatenate([[0], common]).astype(np.uint8)


class _Pass:
    """One inducing pass: pushes the predecessors of scanned suffixes, with their common prefixes."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, wanted: bool, queue: BucketQueue, alphabet: int, room: Room):
        self.text, self.s_type, self.wanted, self.queue = text, s_type, wanted, queue
        # Scanned entries are numbered. pushed: the last one that pushed each character; latest: for each value
        # the last one with a common prefix of that value or less. So the least since then is a search.
        self.pushed = room.array(f"pushed-{wanted}", alphabet, np.int64, -1)
        self.latest = np.full(CAP + 1, -1, np.int64)
        self.seen = 0

    def push(self, scanned: np.ndarray, prefix: np.ndarray) -> None:
        n = len(scanned)
        if not n:
            return
        rows = np.flatnonzero(scanned > 0)
        rows = rows[self.s_type[scanned[rows] - 1] == self.wanted]
        if len(rows):
            position = scanned[rows] - 1
            first = np.asarray(self.text[position])
            order = np.argsort(first, kind="stable")
            rows, position, first = rows[order], position[order], first[order]
            head = np.ones(len(rows), bool)
            head[1:] = first[1:] != first[:-1]
            heads = np.flatnonzero(head)
            chars = first[heads].astype(np.int64)
            low = np.minimum.accumulate(prefix)
            before = self.pushed[chars]
            common = np.empty(len(rows), np.int16)
            common[heads] = np.where(before < 0, -1, np.minimum(np.searchsorted(self.latest, before, "right"), low[rows[heads]]))
            inner = np.flatnonzero(~head)
            common[inner] = _range_min(prefix, rows[inner - 1] + 1, rows[inner])
            common = np.minimum(common + 1, CAP).astype(np.uint8)
            ends = [*heads[1:].tolist(), len(rows)]
            self.pushed[chars] = self.seen + rows[np.array(ends) - 1]
            for c, a, b in zip(chars.tolist(), heads.tolist(), ends, strict=True):
                self.queue.put(c, position[a:b], common[a:b])
        last = np.full(CAP + 1, -1, np.int64)
        last[prefix] = np.arange(n)
        last = np.maximum.accumulate(last)
        self.latest = np.where(last >= 0, self.seen + last, self.latest)
        self.seen += n


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range low..high (inclusive), from a sparse table."""
    width = high - low + 1
    out = np.empty(len(low), np.uint8)
    level = (np.log2(width) + 1e-12).astype(np.int64) if len(low) else width
    table = values
    for k in range(int(level.max()) + 1 if len(low) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[low[pick]], table[high[pick] - (1 << k) + 1])
    return out


def _induced(text: np.ndarray, s_type: np.ndarray, sources: Callable[[int], Iterator[Piece]], room: Room) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Pieces (kind, character, positions, common prefixes with the one before) of each bucket: ``L`` ascending, then
    ``S`` descending, and ``seam``: the least S and the greatest L of a bucket. sources: the S* suffixes by character."""
    alphabet = int(text.max()) + 1
    rising, l_sorted = BucketQueue(room, "l"), BucketQueue(room, "sorted")
    last_l = room.array("last-l", alphabet, np.int64, -1)
    step = _Pass(text, s_type, False, rising, alphabet, room)
    for c in range(alphabet):
        before = -1
        while True:  # rounds: those of this bucket that this bucket induces come after it
            any_ = False
            for position, prefix in rising.pieces(c):
                any_ = True
                if before < 0:
                    prefix = prefix.copy()
                    prefix[0] = 0
                yield "L", c, position, prefix
                before = int(position[-1])
                l_sorted.put(c, position, prefix)
                step.push(position, prefix)
            if not any_:
                break
        last_l[c] = before
        first = True
        for own, prefix in sources(c):
            if first:
                prefix = prefix.copy()
                prefix[0] = min(_run(text, before), _run(text, int(own[0])), CAP) if before >= 0 else 0
                first = False
            step.push(own, prefix)
    falling = BucketQueue(room, "s")
    step = _Pass(text, s_type, True, falling, alphabet, room)
    for c in range(alphabet - 1, -1, -1):
        before = -1
        while True:
            any_ = False
            for position, prefix in falling.pieces(c):
                any_ = True
                if before < 0:
                    prefix = prefix.copy()
                    prefix[0] = 0
                yield "S", c, position, prefix
                before = int(position[-1])
                step.push(position, prefix)
            if not any_:
                break
        if last_l[c] >= 0:
            seam = 0
            if before >= 0:
                seam = min(_run(text, before), _run(text, int(last_l[c])), CAP)
                yield "seam", c, np.array([before, last_l[c]]), np.array([0, seam], np.uint8)
            carried = seam
            for position, prefix in l_sorted.pieces(c, backwards=True):
                # Read from the end, an entry's common prefix is with the one after it.
                step.push(position[::-1], np.append(np.uint8(carried), prefix[:0:-1]))
                carried = int(prefix[0])


def _names(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray, room: Room) -> tuple[np.ndarray, int]:
    """The rank of each S* substring (up to and with the next S*), equal ones alike, and how many differ.

    Induced from S* in text order, S suffixes come out ordered by their substrings."""
    m = len(stars)
    seeds = BucketQueue(room, "seeds")
    for a in range(0, m, PIECE):
        own = np.asarray(stars[a : a + PIECE])
        first = text[own]
        order = np.argsort(first, kind="stable")
        own, first = own[order], first[order]
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1])).tolist()
        for x, y in zip(heads, [*heads[1:], len(own)], strict=True):
            seeds.put(int(first[x]), own[x:y], np.zeros(y - x, np.uint8))
    names = room.array("names", m, np.int64)
    last, count = -1, 0
    for kind, _, position, _ in _induced(text, s_type, seeds.pieces, room):
        if kind != "S":
            continue
        position = position[position > 0]
        position = position[~s_type[position - 1]]
        if not len(position):
            continue
        index = np.searchsorted(stars, position)
        before = np.append(last, index[:-1])
        same = np.zeros(len(index), bool)
        live = np.flatnonzero(before >= 0)
        size = lambda k: stars[np.minimum(k + 1, m - 1)] - stars[k]
        live = live[size(index[live]) == size(before[live])]
        left = size(index[live])
        i, j = stars[index[live]], stars[before[live]]
        while len(live):
            alike = text[i] == text[j]
            same[live[alike & (left == 0)]] = True
            go = alike & (left > 0)
            live, left, i, j = live[go], left[go] - 1, i[go] + 1, j[go] + 1
        rank = count + np.cumsum(~same)  # from 1, descending
        names[index] = rank
        last, count = int(index[-1]), int(rank[-1])
    # The end of the text is the least S* suffix; it is induced by none.
    for a in range(0, m - 1, PIECE):
        b = min(m - 1, a + PIECE)
        names[a:b] = count + 1 - names[a:b]
    names[m - 1] = 0
    return names, count + 1


def _order(text: np.ndarray, room: Room) -> Piece:
    """All suffixes in order, and each one's common prefix with the one before."""
    n = len(text)
    s_type = _types(text, room)
    sources = _sources(text, s_type, room)
    alphabet = int(text.max()) + 1
    order, common = room.array("order", n, np.int64), room.array("common", n, np.uint8)
    bounds = _counts(text, alphabet, room, "characters")
    at, c_at = 0, -1
    order[0] = n - 1
    for kind, c, position, prefix in _induced(text, s_type, sources, room):
        k = len(position)
        if (kind, c) != c_at:
            at, c_at = int(bounds[c]) if kind == "L" else int(bounds[c + 1]), (kind, c)
        if kind == "L":
            order[at : at + k], common[at : at + k] = position, prefix
            at += k
        elif kind == "S":
            # Descending: an entry's common prefix is with the one after it.
            order[at - k : at] = position[::-1]
            common[at - k + 1 : at] = prefix[:0:-1]
            if at < bounds[c + 1]:
                common[at] = prefix[0]
            at -= k
        else:
            common[_first_s(s_type, order, int(bounds[c]), int(bounds[c + 1]))] = prefix[1]
    return order, common


def _first_s(s_type: np.ndarray, order: np.ndarray, low: int, high: int) -> int:
    """The first place of a bucket whose suffix is of type S: L suffixes stand before them."""
    while low < high:
        middle = (low + high) // 2
        if s_type[order[middle]]:
            high = middle
        else:
            low = middle + 1
    return low


def _sorted_far(text: np.ndarray, s_type: np.ndarray, stars: np.ndarray, room: Room) -> Piece:
    """S* suffixes in order, by recursion on their names."""
    m = len(stars)
    names, distinct = _names(text, s_type, stars, room)
    if distinct == m:
        order, shared = room.array("inverse", m, np.int64), room.array("none", m, np.uint8)
        for a in range(0, m, PIECE):
            order[names[a : a + PIECE]] = np.arange(a, min(m, a + PIECE))
    else:
        order, shared = _order(names, room.below())
    places, common = room.array("star-order", m, np.int64), room.array("star-common", m, np.uint8)
    end = len(text) - 1
    for s in range(0, m, PIECE):
        own = np.asarray(order[s : s + PIECE])
        before = np.append(order[s - 1] if s else own[0], own[:-1])
        skip = shared[s : s + PIECE].astype(np.int64)
        i, j = (np.where(x + skip < m, stars[np.minimum(x + skip, m - 1)], end) for x in (own, before))
        start = stars[own]
        length = np.where(skip == CAP, CAP, np.minimum(i - start, CAP))
        live = np.flatnonzero(length < CAP)
        i, j = i[live], j[live]
        while len(live):
            same = (i < end) & (j < end)
            same[same] = text[i[same]] == text[j[same]]
            live, i, j = live[same], i[same] + 1, j[same] + 1
            length[live] += 1
            more = length[live] < CAP
            live, i, j = live[more], i[more], j[more]
        if not s:
            length[0] = 0
        places[s : s + len(own)], common[s : s + len(own)] = start, length
    return places, common


def _sources(text: np.ndarray, s_type: np.ndarray, room: Room) -> Callable[[int], Iterator[Piece]]:
    """The sorted S* suffixes by first character."""
    stars = _stars(s_type, room)
    common = np.zeros(0, np.uint8)
    if len(stars):
        stars, common = _sorted_stars(text, s_type, stars) if len(text) <= room.core else _sorted_far(text, s_type, stars, room)
    bounds = _counts(text, int(text.max()) + 1, room, "star-bounds", stars)

    def of(c: int) -> Iterator[Piece]:
        a, b = int(bounds[c]), int(bounds[c + 1])
        for s in range(a, b, PIECE):
            yield np.asarray(stars[s : min(b, s + PIECE)]), np.asarray(common[s : min(b, s + PIECE)])

    return of


def sorted_buckets(text: np.ndarray, folder: str, memory: int = MEMORY, core: int = CORE) -> Iterator[Piece]:
    """Runs of suffixes next to each other in order, with each one's common prefix with the one before in the run.

    Runs come bucket by bucket: L suffixes ascending, S suffixes descending, and the seam between the two.
    text: non-negative integers ending with the only 0."""
    room = Room(folder, memory, core)
    s_type = _types(text, room)
    bucket, before = None, -1
    for kind, c, position, prefix in _induced(text, s_type, _sources(text, s_type, room), room):
        if kind != "seam" and bucket == (kind, c):
            yield np.append(before, position), np.append(np.uint8(0), prefix)
        else:
            yield position, prefix
        if kind != "seam":
            bucket, before = (kind, c), int(position[-1])


def repeated_starts(text: np.ndarray, window: int, memory: int = MEMORY, core: int = CORE) -> np.ndarray:
    """Which suffixes share their first ``window`` symbols with another one. text: without 0."""
    if window > CAP:
        raise ValueError(f"windows longer than {CAP} need wider common prefixes")
    out = np.zeros(len(text) + 1, bool)
    if len(text):
        with tempfile.TemporaryDirectory(prefix="quillspark-sort-") as folder:
            for position, prefix in sorted_buckets(np.append(text, 0).astype(np.int32), folder, memory, core):
                same = np.flatnonzero(prefix >= window)
                out[position[same]] = True
                out[position[same - 1]] = True
    return out[:-1]
