"""Periodic runs of words by the tandem repeats of a text, found in linear steps.

A *square* is a string of words that stands twice in a row.  A run is a maximal
stretch in which words a period apart are identical; its squares of that period
start at consecutive words.

1. Each text's words that can lie in a run at all are told first: every string of
   ``GRAM`` words inside a run of the asked exponent and length recurs in it, so runs lie
   within stretches of recurring strings, and each stretch is a string of its own.
2. Suffixes of the stretches are sorted by doubling.  The sorted suffixes with the names of
   all power-of-two strings stand in for the suffix tree: a node is an interval of
   suffixes, the depth of two leaves' meeting is read from the names.
3. The Lempel-Ziv blocks, from nearest smaller neighbours in that order, have borders by
   which every square's leftmost occurrence passes: extensions around them give a set of
   squares that covers all leftmost ones.
4. From each of them suffix links are walked: the next rotation stands right there, or is
   looked for among the suffixes below the linked node.  A walk ends where no rotation
   is left, or where another one passed.  Powers are left out, as their roots stand for them;
   the squares passed are the whole vocabulary of the others.
5. The suffixes below each square are its occurrences; consecutive ones merge into runs.

All steps are arrays over many stretches at once, in bundles of ``BUNDLE_WORDS`` (or one
stretch that is longer, at some 250 bytes a word).  No row leaves its task: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers
from marlstone.llm.common import give_back_memory
from marlstone.llm.wordcodes import coded_words, portions, text_bytes

#: What counts as a run: words at least, and periods at least.
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Text whose words are looked at at once, and words of stretches whose suffixes are sorted at once.
PACK_BYTES, BUNDLE_WORDS = 4 << 20, 1 << 19

_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """The sorted suffixes of a string of numbers, and names for its strings of 1, 2, 4, ... numbers."""

    def __init__(self, string: np.ndarray):
        n = len(string)
        self.n, (_, first) = n, np.unique(string, return_inverse=True)
        order = np.argsort(first, kind="stable")
        ordered = first[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int32)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        self.letter, names, step = rank, [rank], 1
        open_ = self._shared(rank[order])
        while len(open_):
            at = order[open_]
            after = np.full(len(at), -1, np.int64)
            inside = at + step < n
            after[inside] = rank[at[inside] + step]
            key = rank[at].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[open_] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            names.append(rank)
            open_ = open_[self._shared(rank[at])]
            step *= 2
        self.order, self.rank = order.astype(np.int64), rank
        self.names = np.stack(names)

    @staticmethod
    def _shared(rank: np.ndarray) -> np.ndarray:
        same = rank[1:] == rank[:-1]
        return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(rank) else np.zeros(0, np.int64)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree from ``i`` and from ``j`` on; the places differ."""
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(np.maximum(i, j) < self.n)
        live = live[self.letter[i[live]] == self.letter[j[live]]]
        a, b = i[live], j[live]
        for level in range(len(self.names) - 1, -1, -1):
            step, name = 1 << level, self.names[level]
            fits = np.maximum(a, b) + step <= self.n
            last = self.n - 1
            same = fits & (name[np.minimum(a, last)] == name[np.minimum(b, last)])
            a, b = a + step * same, b + step * same
        out[live] = a - i[live]
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers agree before ``i`` and before ``j``."""
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(np.minimum(i, j) > 0)
        live = live[self.letter[i[live] - 1] == self.letter[j[live] - 1]]
        a, b = i[live], j[live]
        for level in range(len(self.names) - 1, -1, -1):
            step, name = 1 << level, self.names[level]
            same = (np.minimum(a, b) >= step) & (name[np.maximum(a - step, 0)] == name[np.maximum(b - step, 0)])
            a, b = a - step * same, b - step * same
        out[live] = i[live] - a
        return out

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the strings of some length (1 at least) from ``i`` and ``j`` are one."""
        level = np.frexp(length)[1] - 1
        known = level < len(self.names)
        level = np.where(known, level, 0)
        fits = np.maximum(i, j) + length <= self.n
        shift = np.where(fits, length - (1 << level), 0)
        a, b = np.minimum(i, self.n - 1), np.minimum(j, self.n - 1)
        equal = known & fits & (self.names[level, a] == self.names[level, b]) & (self.names[level, np.minimum(a + shift, self.n - 1)] == self.names[level, np.minimum(b + shift, self.n - 1)])
        return equal | (i == j)

    def below(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the sorted suffixes that begin with the string of some length from ``i``."""
        found = []
        for end in (0, self.n - 1):
            good, bad = self.rank[i].astype(np.int64), np.full(len(i), -1 if end == 0 else self.n)
            while True:
                open_ = np.flatnonzero(np.abs(good - bad) > 1)
                if not len(open_):
                    break
                middle = (good[open_] + bad[open_]) // 2
                ok = self.same(self.order[middle], i[open_], length[open_])
                good[open_[ok]], bad[open_[~ok]] = middle[ok], middle[~ok]
            found.append(good)
        return found[0], found[1]

    def child(self, first: np.ndarray, last: np.ndarray, depth: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Below nodes of some depth, the first suffix that goes on with a letter; -1 if none does."""
        low, high = first.copy(), last + 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less = self._at(self.order[middle] + depth[open_]) < letter[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
        place = self.order[np.minimum(low, self.n - 1)]
        return np.where((low <= last) & (self._at(place + depth) == letter), place, -1)

    def _at(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.n, self.letter[np.minimum(place, self.n - 1)], -1)


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each; -1 if there is none."""
    to = np.arange(len(values)) - 1
    live = np.flatnonzero(to >= 0)
    while len(live):
        live = live[values[to[live]] > values[live]]
        to[live] = to[to[live]]
        live = live[to[live] >= 0]
    return to


def blocks(suffixes: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest string that also starts earlier, or one new letter."""
    n, order = suffixes.n, suffixes.order
    longest = np.zeros(n, np.int64)
    for earlier in (_nearest_smaller(order), n - 1 - _nearest_smaller(order[::-1])[::-1]):
        has = np.flatnonzero((earlier >= 0) & (earlier < n))
        place = order[has]
        longest[place] = np.maximum(longest[place], suffixes.ahead(order[earlier[has]], place))
    out, at, step = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number, its index as often as it says, and 1 to the number."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering_squares(suffixes: Suffixes, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of squares whose rotations to the right hold every square's leftmost occurrence.

    ``longest`` bounds the period at each place.
    """
    begin = blocks(suffixes)
    size = np.diff(np.append(begin, suffixes.n))
    most, out = longest[begin], []
    # Squares that begin in a block and end in the next one.
    which, k = _counted(np.minimum(size, most))
    border = begin[which] + size[which]
    left = border - k
    fore, back = suffixes.ahead(border, left), suffixes.behind(border, left)
    hit = (fore + back >= k) & (fore > 0)
    out.append((np.maximum(left - back, left - k + 1)[hit], k[hit]))
    # Squares that begin before a block and have their middle in it.
    which, k = _counted(np.minimum(size + np.append(size[1:], 0), most))
    border = begin[which]
    fore, back = suffixes.ahead(border, border + k), suffixes.behind(border, border + k)
    start = np.maximum(border - back, border - k + 1)
    hit = (fore + back >= k) & (fore > 0) & (back > 0) & (start + k <= border + size[which])
    out.append((start[hit], k[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def vocabulary(suffixes: Suffixes, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` with every square once, from a covering set of primitive ones, by walks along suffix links."""
    passed, found = np.zeros(0, np.int64), []
    left = period.copy()  # rotations that the walk may still pass
    while len(start):
        follow = np.minimum(suffixes.ahead(start, start + period) - period, left - 1)  # rotations that stand right there
        which, nth = _counted(follow + 1)
        found.append((start[which] + nth - 1, period[which]))
        last, left = start + follow, left - follow - 1
        on = np.flatnonzero(left > 0)
        last, period, left = last[on], period[on], left[on]
        node, _ = suffixes.below(last, 2 * period)
        seen = node * (suffixes.n + 1) + period  # one key a square
        _, once = np.unique(seen, return_index=True)
        on = once[~np.isin(seen[once], passed)]
        passed = np.union1d(passed, seen[on])
        last, period, left = last[on], period[on], left[on]
        has = np.flatnonzero(last + 2 * period <= suffixes.n)
        last, period, left = last[has], period[has], left[has]
        first, end = suffixes.below(last + 1, 2 * period - 1)
        start = suffixes.child(first, end, 2 * period - 1, suffixes.letter[last].astype(np.int64))
        on = np.flatnonzero(start >= 0)
        start, period, left = start[on], period[on], left[on]
    if not found:
        return start, period
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    node, _ = suffixes.below(start, 2 * period)
    _, once = np.unique(node * (suffixes.n + 1) + period, return_index=True)
    return start[once], period[once]


def primitive(suffixes: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's half isn't itself a power."""
    good, rest, prime = np.ones(len(start), bool), period.copy(), 2
    while len(rest) and prime <= rest.max():
        if prime * prime > rest.max():  # what is left of each is 1 or a prime
            primes = rest
        else:
            primes = np.where(rest % prime == 0, prime, 1)
        by = np.flatnonzero((primes > 1) & good)
        if len(by):
            part = period[by] // primes[by]
            good[by[suffixes.same(start[by], start[by] + part, period[by] - part)]] = False
        if primes is rest:
            break
        while (hit := rest % prime == 0).any():
            rest[hit] //= prime
        prime += 1
    return good


def runs_of(string: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all maximal runs of two periods or more, periods up to ``longest`` at each place."""
    if not len(string):
        return (np.zeros(0, np.int64),) * 3
    suffixes = Suffixes(string)
    start, period = covering_squares(suffixes, longest)
    own = primitive(suffixes, start, period)  # a power's rotations repeat, and its runs are those of its root
    start, period = vocabulary(suffixes, start[own], period[own])
    first, last = suffixes.below(start, 2 * period)
    which, nth = _counted(last - first + 1)
    place, period = suffixes.order[first[which] + nth - 1], period[which]
    if not len(place):
        return place, place, period
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])]))
    end = np.append(new[1:], len(place)) - 1
    return place[new], place[end] - place[new] + 2 * period[new], period[new]


def gram_of(least_length: int, least_exponent: int) -> int:
    """A number of words such that every string of so many inside a run recurs inside it.

    A string of g words in a run of length L and period q has its like a period on or back if
    L >= 2q + g - 1, which L >= max(least_length, least_exponent * q) gives for the g returned.
    """
    return max(1, min(max(least_length, least_exponent * q) - 2 * q + 1 for q in range(1, least_length + 1)))


def _stretches(codes: np.ndarray, ends: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words in which each string of ``gram`` words recurs in its text."""
    n = len(codes) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(np.append(0, ends)))[:n].copy()
    for k in range(gram):
        key = (key * np.uint64(0xD6E8FEB86659FD93)) + mixed[k : n + k]
        key ^= key >> np.uint64(31)
    valid = np.ones(len(codes), bool)
    for k in range(1, gram):
        valid[np.maximum(ends - k, 0)[ends >= k]] = False
    at = np.flatnonzero(valid[:n])
    by = at[np.argsort(key[at], kind="stable")]
    same = key[by][1:] == key[by][:-1]
    twice = np.zeros(len(codes) + 1, bool)
    twice[by[:-1][same]] = twice[by[1:][same]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], twice]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2] + gram - 1
    long = end - begin >= least
    return begin[long], end[long]


def word_runs(codes: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """``(text, start, length, period)`` of the runs of texts whose coded words lie one after another."""
    begin, end = _stretches(codes, ends, gram_of(least_length, least_exponent), least_length)
    out, k = [], 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(np.cumsum(end[k:] - begin[k:]), BUNDLE_WORDS, "right")) + k)
        size = end[k:stop] - begin[k:stop]
        which, nth = _counted(size)
        place = begin[k:stop][which] + nth - 1
        # Stretches share no letter, so nothing in one is met in another.
        start, length, period = runs_of(which * (int(codes.max()) + 1) + codes[place], (size // least_exponent)[which])
        good = (length >= least_length) & (length >= least_exponent * period)
        out.append((place[start[good]], length[good], period[good]))
        k = stop
    if not out:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(ends, start, "right")
    by = np.lexsort((period, start))
    text, start, length, period = text[by], start[by], length[by], period[by]
    return text, start - np.append(0, ends)[text], length, period


def _measures(raw: bytes, runs: list[tuple[int, int, int]]) -> tuple:
    words = raw.split()
    if not runs:
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), b" ".join(words)
    keep = bytearray(b"\1" * len(words))
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return len(runs), start, length, period, 1000 * length // period, hashlib.sha256(said).hexdigest(), b" ".join(compress(words, keep))


def _find(least_length: int, least_exponent: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, PACK_BYTES):
            data, ends = text_bytes(batch.column(1))
            codes, word_ends, _ = coded_words(data, ends)
            text, *run_columns = word_runs(codes, word_ends, least_length, least_exponent)
            own = list(zip(*(x.tolist() for x in run_columns), strict=True))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            whole, found, begin, spans = memoryview(np.ascontiguousarray(data)), [], 0, []
            for k, end in enumerate(ends.tolist()):
                spans.append(own[cuts[k] : cuts[k + 1]])
                found.append(_measures(bytes(whole[begin:end]), spans[-1]))
                begin = end
            *numbers, said, left = zip(*found, strict=True) if found else [()] * 7
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(said, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if with_text:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                columns += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in spans], kind), pa.array([x.decode() for x in left], pa.string())]
                names += ["runs", "collapsed"]
            yield pa.RecordBatch.from_arrays(columns, names)
            give_back_memory()

    return run


def collapse_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, with_text: bool = False) -> DataFrame:
    """The periodic runs of words of every row of ``docs(doc_id, text)``, and the text without their repetitions.

    Columns: ``doc_id, n_runs``; ``start, length, period, exponent_milli`` of the run of the greatest
    exact exponent (ties: smallest start, then period), null where there is none;
    ``runs_sha256`` of all runs, ``collapsed_sha256`` of the words that stay: those that no run
    holds after its first period.  ``with_text`` adds ``runs`` and ``collapsed`` themselves.
    ``least_exponent`` is 2 at least and whole.  Null and empty texts have no words and no run;
    repeated rows are measured each; an empty table gives no row; other columns are not read.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    import_on_workers(docs.sparkSession)
    schema = _SCHEMA + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_text else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(least_length, least_exponent, with_text), schema)
