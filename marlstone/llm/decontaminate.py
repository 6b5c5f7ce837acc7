"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping passages of ``WORDS`` words, one every
``WORD_STEP``, so an excerpt of ``WORDS + WORD_STEP - 1`` (13) words or more holds
a whole passage wherever it begins; a shorter item is one passage.  Words so long that a
passage would exceed ``PASSAGE`` bytes (texts without spaces) are cut into
pieces of ``PIECE`` bytes, one every ``PIECE_STEP``.  A passage of ``m`` bytes is
found where a document has a region within ``e = m // EDIT_SHARE`` edits of it.
Such a region shares ``m - q + 1 - q * e`` q-grams with the passage at least, all
on diagonals (place in the document less place in the passage) that drift by
``e`` at most.  So, for every document:

1. its q-grams are looked up among the passages' by a table of bits;
2. shared q-grams are counted in diagonal bands that overlap by half, so that
   any drift of ``2 e + 1`` lies wholly in one band;
3. bands that reach the bound are verified by an alignment inside the band, which
   carries the diagonal it began on, so both ends of a region are known.

An item of fewer than ``Q`` bytes has no q-gram; it is found where its words stand
in a document as they are.

Both sides are compared as lower-case words joined by single spaces.  Documents
are never shuffled, and read once for each ``PASS_BYTES`` of benchmark text, which
a task searches block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers
from marlstone.llm.common import give_back_memory

Q = 10
#: Words of a passage, and between the beginnings of two.
WORDS, WORD_STEP = 11, 3
#: Bound on the bytes of a passage, and the pieces of longer ones.
PASSAGE = 240
PIECE, PIECE_STEP = 60, 20
EDIT_SHARE = 15
#: Bytes of normalised benchmark text that are indexed at once, and that go to the tasks for one scan of the documents.
BLOCK_BYTES, PASS_BYTES = 500_000, 32 << 20
#: Normalised document bytes that are searched at once, and that meet each block where there are several.
BYTES_AT_ONCE, BYTES_HELD = 1 << 20, 8 << 20
#: Bytes that two pieces of a long text share, more than a passage with its edits takes.
OVERLAP = 1 << 10
_TABLE_BITS = 22
_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> bytes:
    return " ".join(_WORD.findall((text or "").lower())).encode("utf-8", "surrogatepass")


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the ``Q`` bytes from each place on."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    b = data.astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(data) - Q + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) + two[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def edits_allowed(m: int) -> int:
    """The edit budget of a passage, small enough for the lemma to ask for two shared q-grams."""
    return max(0, min(m // EDIT_SHARE, (m - Q - 1) // Q))


@dataclass
class PassageIndex:
    """Passages of a block of items and where their q-grams lie."""

    items: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    alone: np.ndarray
    short: dict[bytes, list[int]]


def _windows(n: int, size: int, step: int) -> list[int]:
    """Beginnings of windows over ``n`` places; the last one ends with them."""
    last = max(0, n - size)
    return [*range(0, last, step), last]


def passages(data: bytes) -> list[tuple[int, int]]:
    """``(start, end)`` of an item's passages; one shorter than ``Q`` bytes has none."""
    if len(data) < Q:
        return []
    starts = [0, *(k + 1 for k, c in enumerate(data) if c == 32)]
    ends = [*(s - 1 for s in starts[1:]), len(data)]
    found = set()
    for k in _windows(len(starts), WORDS, WORD_STEP):
        s, e = starts[k], ends[min(k + WORDS, len(ends)) - 1]
        if e - s <= PASSAGE:
            found.add((s, e))
        else:
            found.update((s + at, s + at + PIECE) for at in _windows(e - s, PIECE, PIECE_STEP))
    return sorted((s, e) for s, e in found if e - s >= Q)


def build_index(items: list[tuple[int, bytes]]) -> PassageIndex:
    ids, starts, sizes, texts, base, short = [], [], [], [], 0, {}
    for item, data in items:
        if 0 < len(data) < Q:
            short.setdefault(data, []).append(item)
        for s, e in passages(data):
            ids.append(item)
            starts.append(base)
            sizes.append(e - s)
            texts.append(data[s:e])
            base += e - s
    text = np.frombuffer(b"".join(texts), np.uint8)
    all_grams = [grams(np.frombuffer(t, np.uint8)) for t in texts]
    flat = np.concatenate([np.empty(0, np.uint64), *all_grams])
    passage = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
    place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in all_grams)])
    order = np.argsort(flat, kind="stable")
    unique, first = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _TABLE_BITS, bool)
    seen[(unique >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    # A passage of Q bytes is one q-gram: its bound is one, so it has no second to lie near.
    alone = np.isin(unique, np.array([g[0] for g in all_grams if len(g) == 1], np.uint64))
    return PassageIndex(np.array(ids, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), text, unique, np.append(first, len(flat)), passage[order], place[order], seen, alone, short)


def banded_edits(text: np.ndarray, at: np.ndarray, index: PassageIndex, passage: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits, and the places of the match's begin and end, of passages of one size in regions from ``at`` on.

    The alignment may begin on any of the ``width`` diagonals from ``at`` and stays
    on them.  A cell holds ``cost * width`` and, below it, how far left of the last
    diagonal its alignment began: of equal costs the later begin stands.
    """
    m = int(index.sizes[passage[0]])
    steps = np.arange(width, dtype=np.int32)
    cell = np.zeros((len(at), width), np.int32) + (width - 1 - steps)
    edit = np.int32(width)
    for i in range(m):
        want = index.text[index.starts[passage] + i][:, None]
        where = at[:, None] + i + steps[None, :]
        got = np.where((where >= 0) & (where < len(text)), text[np.clip(where, 0, len(text) - 1)], 0)
        new = cell + (got != want) * edit
        new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + edit)
        cell = np.minimum.accumulate(new - steps * edit, axis=1) + steps * edit
    best = cell.argmin(axis=1)
    value = cell[np.arange(len(at)), best]
    return value // width, at + (width - 1 - value % width), at + m + best


def find_short(texts: list[bytes], short: dict[bytes, list[int]]) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, 0)`` of the first place of each item too short for a q-gram, on whole words."""
    found = []
    for k in {x.count(b" ") for x in short}:
        for t, text in enumerate(texts):
            ends = [i for i, c in enumerate(text) if c == 32] + [len(text)]
            starts, met = [0, *(e + 1 for e in ends[:-1])], set()
            for s, e in zip(starts, ends[k:], strict=False):
                piece = text[s:e] if e - s < Q else b""
                if piece in short and piece not in met:
                    met.add(piece)
                    found += [(t, item, s, e, 0) for item in short[piece]]
    return found


def _portions(text: bytes) -> Iterator[tuple[int, bytes]]:
    """``(begin, piece)`` of a long text: pieces of ``BYTES_AT_ONCE`` that overlap by more than any match."""
    for begin in range(0, max(1, len(text) - OVERLAP), BYTES_AT_ONCE):
        yield begin, text[begin : begin + BYTES_AT_ONCE + OVERLAP]


def find_everywhere(texts: list[bytes], index: PassageIndex) -> list[tuple[int, int, int, int, int]]:
    """As ``find_passages``; a text of over ``BYTES_AT_ONCE`` and ``OVERLAP`` bytes is searched piece by piece, so memory doesn't hang on its length."""
    usual = [t if len(t) <= BYTES_AT_ONCE + OVERLAP else b"" for t in texts]
    found = find_passages(usual, index) if any(usual) else []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, text in enumerate(texts):
        if usual[k] or not text:
            continue
        for begin, piece in _portions(text):
            for _, item, s, e, d in find_passages([piece], index):
                cut = (s == 0 and begin and text[begin - 1] != 32) or (e == len(piece) and begin + e < len(text) and text[begin + e] != 32)
                if cut and e - s < Q:  # part of a word
                    continue
                value = (d, begin + s, begin + e)
                best[k, item] = min(best.get((k, item), value), value)
    return sorted(found + [(t, item, s, e, d) for (t, item), (d, s, e) in best.items()])


def find_passages(texts: list[bytes], index: PassageIndex) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, edits)`` of the best match of each item in each text."""
    short = find_short(texts, index.short) if index.short else []
    if not len(index.grams) or not texts:
        return sorted(short)
    gap = PASSAGE + 2 * Q
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    data = np.frombuffer(b"".join(t + b"\0" * gap for t in texts), np.uint8)
    h = grams(data)
    places = np.flatnonzero(index.seen[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    k = np.searchsorted(index.grams, h[places])
    ok = index.grams[np.minimum(k, len(index.grams) - 1)] == h[places]
    places, k = places[ok], k[ok]
    # A region in budget holds two shared q-grams at least within a passage's length of each other, or is one q-gram.
    if not len(places):
        return sorted(short)
    near = np.diff(places) <= PASSAGE + PASSAGE // EDIT_SHARE
    use = np.append(near, False) | np.insert(near, 0, False) | index.alone[k]
    places, k = places[use], k[use]
    count = index.first[k + 1] - index.first[k]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    cut = np.flatnonzero(np.diff(np.cumsum(count) // (1 << 22))) + 1  # postings in bounded portions
    portions = np.split(np.arange(len(places)), cut)
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    for part in portions:
        n = count[part]
        posting = np.repeat(index.first[k[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        passage = index.passage[posting]
        diagonal = np.repeat(places[part], n) - index.place[posting] + PASSAGE
        half = 2 * _budgets(index.sizes[passage]) + 1
        band = diagonal // half
        # Bands ``b`` and ``b - 1`` both hold the diagonal; each is two halves wide.
        size = (len(data) + 2 * PASSAGE) + 2
        key = np.concatenate([passage * size + band + 1, passage * size + band])
        counted.append(np.unique(key, return_counts=True))
    keys = np.concatenate([c[0] for c in counted])
    unique, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([c[1] for c in counted])).astype(np.int64)
    size = (len(data) + 2 * PASSAGE) + 2
    passage, band = unique // size, unique % size - 1
    m, e = index.sizes[passage], _budgets(index.sizes[passage])
    keep = total >= m - Q + 1 - Q * e
    passage, band, m, e = passage[keep], band[keep], m[keep], e[keep]
    low = band * (2 * e + 1) - PASSAGE - e
    for length in np.unique(m):
        budget = edits_allowed(int(length))
        rows = np.flatnonzero(m == length)
        for part in (rows[i : i + 4096] for i in range(0, len(rows), 4096)):
            edits, starts, ends = banded_edits(data, low[part], index, passage[part], 2 * (2 * budget + 1) + 2 * budget)
            ok = edits <= budget
            for r, d, start, end in zip(part[ok].tolist(), edits[ok].tolist(), starts[ok].tolist(), ends[ok].tolist(), strict=True):
                t = int(np.searchsorted(begins, end - 1, side="right")) - 1
                key = (t, int(index.items[passage[r]]))
                value = (d, max(0, start - int(begins[t])), min(end - int(begins[t]), int(sizes[t])))
                found[key] = min(found.get(key, value), value)
    return sorted([(t, item, s, e_, d) for (t, item), (d, s, e_) in found.items()] + short)


def _budgets(m: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.minimum(m // EDIT_SHARE, (m - Q - 1) // Q))


def benchmark_passes(benchmark: DataFrame) -> Iterator[list[list[tuple[int, bytes]]]]:
    """The benchmark's normalised items in lists of blocks; a block is bounded by ``BLOCK_BYTES``, a list by ``PASS_BYTES``, and one item."""
    blocks, held, size = [[]], 0, 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null").toLocalIterator():
        data = normalise(r[1])
        if blocks[-1] and held + len(data) > PASS_BYTES:
            yield blocks
            blocks, held, size = [[]], 0, 0
        if blocks[-1] and size + len(data) > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], data))
        held, size = held + len(data), size + len(data)
    yield blocks


class Search:
    """Finds the items of one pass in texts; the index of a single block is kept, those of several are built in turn."""

    def __init__(self, blocks: list[list[tuple[int, bytes]]]):
        self.blocks, self.bytes = blocks, BYTES_AT_ONCE if len(blocks) == 1 else BYTES_HELD
        self.only = build_index(blocks[0]) if len(blocks) == 1 else None

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        if self.only is not None:
            return find_everywhere(texts, self.only)
        found, cuts, held = [], [0], 0
        for k, t in enumerate(texts):
            held += len(t)
            if held > BYTES_AT_ONCE or k == len(texts) - 1:
                cuts.append(k + 1)
                held = 0
        for block in self.blocks:
            index = build_index(block)
            for a, b in zip(cuts, cuts[1:], strict=False):
                found += [(r[0] + a, *r[1:]) for r in find_everywhere(texts[a:b], index)]
        return sorted(found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)`` for each benchmark item that a row of ``docs`` holds.

    Places are bytes of the normalised text, ``start`` the first and ``end`` the one
    after the last; the row has the passage with the fewest edits, the first on
    ties.  Null and empty texts and items and items without an id match nothing;
    items shorter than ``Q`` bytes match whole words without an edit; repeated rows
    are reported each; an empty table on either side gives no row.  A very long text
    is searched whole, in pieces that overlap.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    schema = "doc_id long, item_id long, start int, end int, edits int"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for blocks in benchmark_passes(benchmark):
        shared = spark.sparkContext.broadcast(blocks)  # bounded by PASS_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)

            def solve(ids: list, texts: list[bytes]) -> pa.RecordBatch:
                rows = search(texts)
                columns = [[ids[r[0]] for r in rows], *([r[k] for r in rows] for k in range(1, 5))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

            ids, texts, held = [], [], 0
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1), strict=True):
                    ids.append(i.as_py())
                    texts.append(normalise(t.as_py()))
                    held += len(texts[-1])
                    if held > search.bytes:
                        yield solve(ids, texts)
                        ids, texts, held = [], [], 0
            if ids:
                yield solve(ids, texts)
            give_back_memory()

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark passage, with their columns as they were.

    Each row is judged by itself, whatever its id; rows are never shuffled.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    at = docs.columns.index("text")
    for blocks in benchmark_passes(benchmark):
        shared = spark.sparkContext.broadcast(blocks)  # bounded by PASS_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            for batch in batches:
                start, held, texts = 0, 0, []
                for k, t in enumerate(batch.column(at)):
                    texts.append(normalise(t.as_py()))
                    held += len(texts[-1])
                    if held > search.bytes or k == batch.num_rows - 1:
                        bad = {r[0] for r in search(texts)}
                        yield batch.slice(start, len(texts)).filter(pa.array([n not in bad for n in range(len(texts))]))
                        start, held, texts = k + 1, 0, []
            give_back_memory()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
