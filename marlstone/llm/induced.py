"""Suffix sorting by induction, in rounds over whole queues.

The types of suffixes (smaller or larger than the next one) split the text into
pieces that begin at its local minima.  Sorting the pieces, naming them, and
sorting the suffixes of the shorter text of names orders the minima; all other
suffixes are *induced*: queues, one for each first byte, hand out suffixes in
order, and each suffix that comes out puts the one before it into the queue of
its own first byte.  A queue is a list of arrays, and a round handles all that
it holds, so the walk is a few array operations for each byte value and length
of a run of equal bytes.

Common prefixes of neighbours are told as far as ``depth``: order beyond it is
not settled where nothing asks for it.
"""

from __future__ import annotations

import numpy as np


def types(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is larger."""
    if not len(data):
        return np.zeros(0, bool)
    last = np.flatnonzero(data[1:] != data[:-1])  # ends of runs of equal bytes, less the last run
    rises = np.append(data[last] < data[last + 1], False)
    return np.repeat(rises, np.diff(last, prepend=-1, append=len(data) - 1))


def minima(small: np.ndarray) -> np.ndarray:
    """Places of smaller suffixes that follow a larger one, in four bytes each where they fit."""
    place = np.int32 if len(small) < 1 << 31 else np.int64
    return (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(place) if len(small) else np.zeros(0, place)


class _Queues:
    """One queue for each byte value; entries come out in the order they went in."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(self, places: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part, k in zip(np.split(places, cuts), keys[np.concatenate([[0], cuts])].tolist() if len(keys) else (), strict=False):
            self.held[k].append(part)

    def take(self, key: int) -> np.ndarray:
        got, self.held[key] = self.held[key], []
        return np.concatenate(got) if got else np.zeros(0, np.int32)


def induce(data: np.ndarray, small: np.ndarray, sorted_minima: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the order of the minima."""
    by_byte = np.split(sorted_minima, np.searchsorted(data[sorted_minima], np.arange(1, 256)))
    large, queues = [sorted_minima[:0]] * 256, _Queues()
    # The last suffix is larger than the empty one and comes first among its equals.
    queues.put(np.array([len(data) - 1], sorted_minima.dtype), data[-1:])
    for c in range(256):
        done, now = [], queues.take(c)
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            key = data[before]
            ahead = key > c
            queues.put(before[ahead], key[ahead])
            now = before[key == c]
        large[c] = np.concatenate(done) if done else large[c]
        before = by_byte[c] - 1
        queues.put(before, data[before])
    lesser, queues = [sorted_minima[:0]] * 256, _Queues()
    for c in range(255, -1, -1):
        done, now = [], queues.take(c)
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            key = data[before]
            behind = key < c
            queues.put(before[behind], key[behind])
            now = before[key == c]
        lesser[c] = np.concatenate(done)[::-1] if done else lesser[c]
        before = large[c][::-1]
        before = before[before > 0] - 1
        use = data[before] < c
        queues.put(before[use], data[before[use]])
    return np.concatenate([x for c in range(256) for x in (large[c], lesser[c])])


def _order_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a text of names, settled to ``depth`` names: by halves, doubling."""
    rank, step = names, 1
    while True:
        after = np.append(rank[step:], np.full(min(step, len(rank)), -1))
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(len(order), np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == len(order) - 1 or step >= depth:
            return order


def suffix_array(data: np.ndarray, digest, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes at least.

    ``digest(starts, ends)`` names substrings: equal ones have equal digests.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    small = types(data)
    low = minima(small)
    if not len(low):
        return induce(data, small, low)
    # Pieces in order: one induction from the minima by their first byte alone.
    rough = induce(data, small, low[np.argsort(data[low], kind="stable")])
    is_low = np.zeros(n, bool)
    is_low[low] = True
    pieces = rough[is_low[rough]]
    end = np.full(n, n, low.dtype)
    end[low] = np.append(low[1:] + 1, n)
    size = end[pieces] - pieces
    names_of = digest(pieces, end[pieces])
    fresh = (names_of[1:] != names_of[:-1]) | (size[1:] != size[:-1])
    name = np.empty(n, low.dtype)
    name[pieces] = np.concatenate([[0], np.cumsum(fresh)])
    if fresh.all():
        return induce(data, small, pieces)
    return induce(data, small, low[_order_names(name[low], depth)])


def same_prefix(suffixes: np.ndarray, digest, length: int, n: int) -> np.ndarray:
    """Whether each suffix shares its first ``length`` bytes with the one before it; the first doesn't."""
    full = suffixes + length <= n
    key = digest(np.minimum(suffixes, n - length), np.minimum(suffixes, n - length) + length) if n >= length else np.zeros(len(suffixes), np.uint64)
    same = np.zeros(len(suffixes), bool)
    same[1:] = full[1:] & full[:-1] & (key[1:] == key[:-1])
    return same
