"""Removal of byte strings that an earlier document holds, by sorted samples of suffixes.

Every ``LENGTH``-byte string of a document that also starts in a document with a
smaller doc_id is covered; what is left is kept.  Exact, over whole texts.

Sorting all suffixes of the corpus by their first bytes moves each of them, many
times the input.  Here suffixes are sampled so that the sample *induces* the
rest: a window of ``LENGTH`` bytes is represented by its least ``GRAM``-byte
hash, so equal windows have equal representatives, and consecutive windows with
one representative form a run.

The method named for this operator, external induced sorting of all suffixes with
disk-backed queues, is thus taken for a sample only; the README says why.

1. Each run is sent as one suffix tuple (representative, digest of the run's
   whole string, document, place, length) to the bucket of its representative.
   Tuples travel as packed sorted-by-bucket column blobs, not as rows.  Of equal
   runs in a task's portion only the one of the smallest document is sent; the
   others are covered by it.
2. Buckets sort their tuples.  Runs whose whole string is met in a smaller
   document are covered by it: the sample's order decides for all their windows.
3. Runs whose representative, but not whole string, is met elsewhere lie at the
   ends of repeats: their common prefixes are shorter than the run.  Only their
   strings are fetched; a suffix array, sorted by induction, and the common
   prefixes of its neighbours tell which windows an earlier document has.
4. Documents meet their covered intervals and are cut.

A bucket or a home of documents is sized by ``BUCKET_BYTES`` of input.  Texts
travel compressed.  A copied document is spread over all buckets.  A passage on a
third of all documents puts at most ``HOT_LOCAL`` tuples of each portion of
``PACK_BYTES`` into one bucket: beyond that its windows go to buckets by their own
content, and of equal windows in a home only the smallest document's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.stage import import_on_workers, write_stage
from marlstone.llm.common import fresh, give_back_memory
from marlstone.llm.induced import same_prefix, suffix_array

LENGTH, GRAM = 50, 20
#: Input bytes for each bucket, windows that are hashed at once, bytes that are packed at once.
BUCKET_BYTES, CHUNK, PACK_BYTES = 8 << 20, 1 << 19, 28 << 20
#: Shards of strings at the ends of repeats, for each bucket.
SHARDS = 8
#: Windows of one representative that form a run at most (periodic texts have longer ones).
LONGEST_RUN = 1024
#: Stands for a null doc_id, which is larger than any other.
LAST_ID = np.iinfo(np.int64).max
#: A representative of more runs than this is hot: its windows go to buckets by their own content.
HOT_ROWS = 4096
#: A representative of more different runs than this in one portion is hot at once.
HOT_LOCAL = 256
#: In place of a representative: the run is covered, or its windows are spread.
COVERED, SPREAD = -1, -2
#: What a tuple says: a run to be sorted, one that is covered, one whose windows are spread, or that a representative is hot.
_RUN, _COVERED, _SPREAD, _HOT = range(4)

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; only those for a chunk are kept."""
    known = _tables.get(base)
    if known is not None and n <= len(known[0]):
        return known
    inverse = pow(base, -1, 1 << 64)
    made = tuple(np.concatenate([[_U(1)], np.multiply.accumulate(np.full(max(n, 2 * CHUNK) - 1, b, _U))]) for b in (base, inverse))
    if n <= 2 * CHUNK:
        _tables[base] = made
    return made


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class _Strings:
    """Digests of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        power, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)])])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0xC2B2AE3D27D4EB4F))

    def each(self, size: int) -> np.ndarray:
        """Digests of all substrings of one size."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, _U)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(place, windows, representative, whole)`` of the runs of texts that lie one after another."""
    out = []
    begins = np.concatenate([[0], ends[:-1]])
    valid = np.ones(len(data), bool)
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        valid[max(b, e - LENGTH + 1) : e] = False
    for c in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        piece = data[c : c + CHUNK + LENGTH - 1]
        strings = _Strings(piece)
        least = strings.each(GRAM)
        width, want = 1, LENGTH - GRAM + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = np.flatnonzero(valid[c : c + len(least)])
        if not len(at):
            continue
        least = least[at]
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
        size = np.diff(np.append(first, len(at)))
        if (size > LONGEST_RUN).any():
            parts = -(-size // LONGEST_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(LONGEST_RUN, np.repeat(size, parts) - nth * LONGEST_RUN)
            first = np.repeat(first, parts) + nth * LONGEST_RUN
        place = at[first]
        out.append((place + c, size, _mix(least[first]), strings.digest(place, place + size + LENGTH - 1)))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _planes(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of unsigned integers as byte planes, compressed."""
    head = np.array([len(columns), *(x for c, s in columns for x in (len(c), s))], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_planes(c, s) for c, s in columns))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    shape = np.frombuffer(raw, np.uint32, 2 * n, 4).reshape(-1, 2).tolist()
    at, out = 4 + 8 * n, []
    for rows, size in shape:
        whole = np.zeros((rows, 8), np.uint8)
        whole[:, :size] = np.frombuffer(raw, np.uint8, rows * size, at).reshape(size, rows).T
        out.append(whole.view(_U).ravel())
        at += rows * size
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after another, and where each ends; null is empty."""
    flat = column.cast(pa.large_binary()).fill_null(b"")
    flat = pa.concat_arrays([flat])
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each text, to tell rows that share a doc_id."""
    raw, begin, out = memoryview(np.ascontiguousarray(data)), 0, []
    for e in ends.tolist():
        out.append(xxhash.xxh64_intdigest(raw[begin:e]))
        begin = e
    return np.array(out, _U).view(np.int64)


def _homes(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(ids.astype(_U) * _U(31) + keys.astype(_U)) % _U(buckets)).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            held.append(part)
            size += part.column(text).nbytes
            if size > PACK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.combine_chunks()


def _flags(ids: np.ndarray, rep: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What the tuples of a portion say: of equal runs those of larger documents are covered; runs of a hot representative are spread."""
    flag = np.zeros(len(ids), np.uint8)
    key = _mix(rep * _U(0x9E3779B97F4A7C15) + whole)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, np.int64)
    if len(starts) < len(key):
        least = np.minimum.reduceat(ids[order], starts)
        flag[order[ids[order] > least[np.searchsorted(starts, np.arange(len(order)), side="right") - 1]]] = _COVERED
    left = np.flatnonzero(flag == _RUN)
    _, of, count = np.unique(rep[left], return_inverse=True, return_counts=True)
    if len(left):
        flag[left[count[of] > HOT_LOCAL]] = _SPREAD
    return flag


def _send_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _portions(batches, 1):
            parts, bases, begin = [], [], 0
            for batch in table.to_batches():
                data, ends = _texts(batch.column(1))
                place, size, rep, whole = runs(data, ends)
                doc = np.searchsorted(ends, place, side="right")
                begins = np.concatenate([[0], ends[:-1]])
                parts.append((doc + begin, place - begins[doc], size, rep, whole))
                bases.append((_ids(batch.column(0)), _keys(data, ends)))
                begin += batch.num_rows
            ids, keys = (np.concatenate(x) for x in zip(*bases, strict=True))
            doc, place, size, rep, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            flag = _flags(ids[doc], rep, whole)
            hot = np.flatnonzero(flag == _SPREAD)
            _, first = np.unique(rep[hot], return_index=True)
            said = hot[first]  # one notice a hot representative
            if len(said):
                flag = np.concatenate([flag, np.full(len(said), _HOT, np.uint8)])
                by = np.argsort(np.concatenate([doc, doc[said]]), kind="stable")  # blobs count on rows in order of documents
                doc, place, size, rep, whole = (np.concatenate([x, x[said]])[by] for x in (doc, place, size, rep, whole))
                flag = flag[by]
            of_rep, of_doc = (rep >> _U(32)) * _U(buckets) >> _U(32), _homes(ids, keys, buckets).astype(_U)[doc]
            bucket = np.where((flag == _RUN) | (flag == _HOT), of_rep, of_doc)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                rows = order[cuts[b] : cuts[b + 1]]
                used, local = np.unique(doc[rows], return_inverse=True)
                blob = _pack([(ids[used], 8), (keys[used], 8), (np.diff(local, prepend=0), 3), (place[rows], 5), (size[rows], 2), (rep[rows] & _U((1 << 48) - 1), 6), (whole[rows] >> _U(8), 7), (flag[rows], 1)])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])
            give_back_memory()

    return run


_MARKED = "home int, doc_id long, tkey long, place long, windows int, rep long"


def _resolve(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("blob"):
            ids, keys, local, place, size, rep, whole, flag = _unpack(blob.as_py())
            doc = np.cumsum(local.astype(np.int64))
            parts.append((ids.astype(np.int64)[doc], keys.astype(np.int64)[doc], place.astype(np.int64), size.astype(np.int64), rep, whole, flag))
        ids, keys, place, size, rep, whole, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
        known = (flag == _COVERED) | (flag == _SPREAD)
        passed = ids[known], keys[known], place[known], size[known], np.where(flag[known] == _COVERED, COVERED, SPREAD)
        spread = np.unique(rep[flag == _HOT])
        run_rows = flag == _RUN
        ids, keys, place, size, rep, whole = (x[run_rows] for x in (ids, keys, place, size, rep, whole))
        out = passed if not len(ids) else [np.concatenate(x) for x in zip(passed, _sorted_runs(ids, keys, place, size, rep, whole, spread), strict=True)]
        give_back_memory()
        return pa.table([pa.array(_homes(out[0], out[1], buckets).astype(np.int32)), *map(pa.array, out[:3]), pa.array(out[3].astype(np.int32)), pa.array(out[4])], ["home", "doc_id", "tkey", "place", "windows", "rep"])

    return run


def _sorted_runs(ids: np.ndarray, keys: np.ndarray, place: np.ndarray, size: np.ndarray, rep: np.ndarray, whole: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    """``ids, keys, place, size, rep`` of the runs that are covered or whose windows must be looked at."""
    order = np.lexsort((ids, whole, rep))
    ids, keys, place, size, rep, whole = (x[order] for x in (ids, keys, place, size, rep, whole))
    fresh_rep = np.concatenate([[True], rep[1:] != rep[:-1]])
    fresh = fresh_rep | np.concatenate([[True], whole[1:] != whole[:-1]])
    of, of_rep = np.cumsum(fresh) - 1, np.cumsum(fresh_rep) - 1
    least = ids[np.flatnonzero(fresh)][of]
    starts = np.flatnonzero(fresh_rep)
    least_rep = np.minimum.reduceat(ids, starts)[of_rep]
    inside = least < ids
    edge = ~inside & (least_rep < ids)
    most_edge = np.maximum.reduceat(np.where(edge, ids, np.iinfo(np.int64).min), starts)[of_rep]
    edge |= fresh & (ids < most_edge)  # the first of equal runs lends its windows to larger documents
    told = np.isin(rep, spread)
    edge |= told & ~inside  # other portions have spread theirs
    use = inside | edge
    hot = told | (np.diff(np.append(starts, len(ids)))[of_rep] > HOT_ROWS)
    return [ids[use], keys[use], place[use], size[use], np.where(hot & edge, SPREAD, np.where(edge, rep.astype(np.int64), COVERED))[use]]


def _send_rows(buckets: int, ids_at: int, text_at: int):
    """Whole rows to their homes, as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for table in _portions(batches, text_at):
            keys = np.concatenate([_keys(*_texts(b.column(text_at))) for b in table.to_batches()])
            ids = np.concatenate([_ids(b.column(ids_at)) for b in table.to_batches()])
            home = _homes(ids, keys, buckets)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                    writer.write_table(table.take(pa.array(order[cuts[b] : cuts[b + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["home", "blob"])
            give_back_memory()

    return run


def _rows_of(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(b.as_py()).read_all() for b in table.column("blob"))


def _fetch(shards: int, ids_at: int, text_at: int):
    """The strings of marked runs for the shard of their representative; single windows of hot ones for one by content.

    Of equal windows in a home the smallest document's is asked; the others go along as covered, with an empty string.
    """

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["bucket", "doc_id", "tkey", "place", "string"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out: list[list] = [[], [], [], [], []]
        if rows.num_rows and marks.num_rows:
            texts = {}
            for batch in _rows_of(rows).to_batches():
                data, ends = _texts(batch.column(text_at))
                begins = np.concatenate([[0], ends[:-1]])
                raw = data.tobytes()
                for i, k, s, e in zip(_ids(batch.column(ids_at)).tolist(), _keys(data, ends).tolist(), begins.tolist(), ends.tolist(), strict=True):
                    texts[i, k] = (raw, s, e)
            marked = list(zip(*(marks.column(c).to_pylist() for c in ("doc_id", "tkey", "place", "windows", "rep")), strict=True))
            least: dict[bytes, int] = {}
            for i, k, place, size, rep in marked:
                if rep == SPREAD:
                    raw, s, _ = texts[i, k]
                    for n in range(s + place, s + place + size):
                        piece = raw[n : n + LENGTH]
                        least[piece] = min(least.get(piece, i), i)
            for i, k, place, size, rep in marked:
                raw, s, _ = texts[i, k]
                string = raw[s + place : s + place + size + LENGTH - 1]
                pieces = [string] if rep != SPREAD else [string[n : n + LENGTH] for n in range(size)]
                for n, piece in enumerate(pieces):
                    if rep != SPREAD:
                        bucket = rep % shards
                    elif i > least[piece]:  # covered by a document of this home
                        bucket, piece = shards + (i ^ k) % shards, b""
                    else:
                        bucket = shards + xxhash.xxh32_intdigest(piece) % shards
                    for x, v in zip(out, (bucket, i, k, place + n, piece), strict=True):
                        x.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return run


def _resolve_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        empty = np.array([not len(x) for x in table.column("string").to_pylist()], bool) if table.column("bucket")[0].as_py() >= SHARDS * buckets else np.zeros(table.num_rows, bool)
        passed = [table.column(c).to_numpy()[empty] for c in ("doc_id", "tkey", "place")]
        found = _asked_windows(table.filter(pa.array(~empty)), table.column("bucket")[0].as_py() < SHARDS * buckets) if not empty.all() else [np.empty(0, np.int64)] * 4
        out = [np.concatenate(x) for x in zip(found, (*passed, np.ones(len(passed[0]), np.int64)), strict=True)]
        give_back_memory()
        return pa.table([pa.array(_homes(out[0], out[1], buckets).astype(np.int32)), *map(pa.array, out[:3]), pa.array(out[3].astype(np.int32)), pa.array(np.full(len(out[0]), COVERED))], ["home", "doc_id", "tkey", "place", "windows", "rep"])

    return run


def _asked_windows(table: pa.Table, prefixes: bool) -> list[np.ndarray]:
    """``ids, keys, place, windows`` of the covered windows among some strings, which share prefixes or are one window each."""
    data, ends = _texts(_whole(table.column("string")))
    ids, keys, place = (table.column(c).to_numpy() for c in ("doc_id", "tkey", "place"))
    begins = np.concatenate([[0], ends[:-1]])
    count = ends - begins - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begins[row]
    one, two = (_Strings(data, b) for b in _BASES)
    if prefixes:
        valid = np.zeros(len(data), bool)
        valid[start] = True
        order = suffix_array(data, one.digest, LENGTH)
        order = order[valid[order]]
        same = same_prefix(order, one.digest, LENGTH, len(data)) & same_prefix(order, two.digest, LENGTH, len(data))
    else:
        key = one.digest(start, start + LENGTH), two.digest(start, start + LENGTH)
        by = np.lexsort(key)
        order = start[by]
        same = np.append(False, (key[0][by][1:] == key[0][by][:-1]) & (key[1][by][1:] == key[1][by][:-1]))
    row_at = np.empty(len(data), np.int64)
    row_at[start] = row
    least_at = np.empty(len(data), np.int64)
    if len(order):
        least_at[order] = np.minimum.reduceat(ids[row_at[order]], np.flatnonzero(~same))[np.cumsum(~same) - 1]
    hit = np.flatnonzero(least_at[start] < ids[row])
    if not len(hit):
        return [np.empty(0, np.int64)] * 4
    new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]))
    first, size = hit[new], np.diff(np.append(new, len(hit)))
    hit_row = row[first]
    return [ids[hit_row], keys[hit_row], start[first] - begins[hit_row] + place[hit_row], size]


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under some intervals; touching ones are one."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        s, e = int(starts[k]), int(ends[k])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _cut(ids_at: int, text_at: int, with_rows: bool, named: list[str]):
    """Rows with their covered bytes taken out."""

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if marks.num_rows:
            ids, keys, place, size = (marks.column(c).to_numpy() for c in ("doc_id", "tkey", "place", "windows"))
            order = np.lexsort((keys, ids))
            ids, keys, place, size = ids[order], keys[order], place[order], size[order]
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                spans[int(ids[a]), int(keys[a])] = covered(place[a:b], place[a:b] + size[a:b] + LENGTH - 1)
        tables = []
        for batch in _rows_of(rows).to_batches() if rows.num_rows else ():
            data, ends = _texts(batch.column(text_at))
            begins, raw, found = np.concatenate([[0], ends[:-1]]).tolist(), data.tobytes(), []
            for i, k, s, e in zip(_ids(batch.column(ids_at)).tolist(), _keys(data, ends).tolist(), begins, ends.tolist(), strict=True):
                own, at, kept = spans.get((i, k), ()), s, []
                for a, b in own:
                    kept.append(raw[at : s + a])
                    at = s + b
                kept.append(raw[at:e])
                left = b"".join(kept)
                found.append((e - s, e - s - len(left), len(own), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_rows else None))
            n_bytes, removed, n_spans, digest, text = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [], [])
            measures = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_rows:
                columns = [pa.array(text, pa.string()) if k == text_at else c for k, c in enumerate(batch.columns)]
                tables.append(pa.table([*columns, *measures.values()], [*batch.schema.names, *named]))
            else:
                tables.append(pa.table([batch.column(ids_at), *measures.values()], ["doc_id", *measures]))
        give_back_memory()
        return pa.concat_tables(tables) if tables else pa.table({})

    return run


def measure_names(columns: list[str]) -> list[str]:
    """Names of the measures beside some columns."""
    return fresh(columns, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame, with_rows: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``.

    ``with_rows`` returns the rows themselves with ``text`` cut (a character that
    is cut in two is lost whole) and the measures after them, under ``measure_names``.  Null texts
    are empty.  A null doc_id counts as larger than all others; rows with one
    doc_id don't cover each other; repeated rows get the same result each.  An
    empty table gives no row.  A very long text is read in chunks of ``CHUNK``
    bytes that overlap, so its length changes nothing.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    own = docs if with_rows else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = measure_names(docs.columns)
    ids_at, text_at = own.columns.index("doc_id"), own.columns.index("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))

    tuples = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_send_runs(buckets), "bucket int, blob binary")
    marks, _ = write_stage(tuples.groupBy("bucket").applyInArrow(_resolve(buckets), _MARKED), "runs")
    packed = own.mapInArrow(_send_rows(buckets, ids_at, text_at), "home int, blob binary")
    edges = packed.groupBy("home").cogroup(marks.filter(F.col("rep") != COVERED).groupBy("home")).applyInArrow(_fetch(SHARDS * buckets, ids_at, text_at), "bucket int, doc_id long, tkey long, place long, string binary")
    windows, _ = write_stage(edges.groupBy("bucket").applyInArrow(_resolve_windows(buckets), _MARKED), "windows")
    found = marks.filter(F.col("rep") == COVERED).unionByName(windows)
    measures = [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))]
    if with_rows:
        schema = T.StructType([*own.schema.fields, *(T.StructField(n, m.dataType) for n, m in zip(named, measures, strict=True))])
    else:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *measures])
    return packed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_cut(ids_at, text_at, with_rows, named), schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of ``text``; rows left without text go.

    ``n_chars``, where present, follows the text.  Rows that were empty stay.
    """
    cut = cut_repeats(docs, with_rows=True).filter((F.col(measure_names(docs.columns)[1]) == 0) | (F.btrim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
