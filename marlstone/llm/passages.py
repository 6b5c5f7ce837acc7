"""Removal of passages of words that an earlier document holds, by suffix trees over parts of all suffixes.

A window is ``WINDOW`` consecutive words.  Each word that is covered by a window whose
words also start in a document with a smaller doc_id goes.  Exact, over whole texts.

1. *Prefixes.*  Suffixes (the places where windows begin) are parted by their first
   words: by one word where few suffixes begin with it, by more where many do, up to the
   whole window.  Tasks report prefixes that are frequent in their portion; what they
   sum up to says which prefixes are split.  A prefix that holds a share of all
   suffixes holds it in some portion, so none is overlooked, and the table has at most
   ``WINDOW`` times ``MOST_SPLIT`` entries.
2. *Groups.*  A group of prefixes fits into a task's memory.  A suffix is sent to it as its
   document and the digest of its window: the label of its path down to the depth
   that counts.  Equal windows of a portion are combined first: the smallest document's is sent
   once, the other documents' are known to be covered.
3. *Subtrees.*  The sorted leaves of a group make its subtree.  Its internal nodes at the
   window's depth with leaves of several documents are the repeats: below each, all leaves but
   the smallest document's are covered.
4. Documents meet their covered windows at home and are cut; windows that touch make
   one maximal repeat.

Leaves and covered windows travel as packed columns, texts compressed, once.  A document id whose
rows hold more words than a home takes has several homes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.stage import import_on_workers
from marlstone.llm.common import fresh, give_back_memory
from marlstone.llm.substring import _ids, _keys, _mix, _pack, _rows_of, _unpack
from marlstone.llm.wordcodes import coded_words, portions, text_bytes

WINDOW = 13
#: Bytes of text for each group and home, and of the portions that tasks look at at once.
GROUP_BYTES, PACK_BYTES = 12 << 20, 16 << 20
#: Prefixes of one length that are split at most: a group is never asked to be under this part of all suffixes.
MOST_SPLIT = 1 << 16
#: Letters a word takes, for the number of suffixes in some bytes of text.
WORD_BYTES = 6

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
_PREFIX, _DOC = 0, 1


class _Portion:
    """The words of some texts: a hash of each prefix of the windows, and the windows' digests."""

    def __init__(self, column: pa.Array, window: int):
        data, ends = text_bytes(column)
        codes, self.ends, words = coded_words(data, ends)
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), _U, len(words))
        self.words, self.window = hashed[codes], window
        self.row = np.repeat(np.arange(len(ends)), np.diff(np.append(0, self.ends)))
        n = max(0, len(codes) - window + 1)
        self.at = np.flatnonzero(self.row[:n] == self.row[len(codes) - n :])

    def prefix(self, hashes: np.ndarray | None, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first ``length`` words at some places, from those of one word less."""
        return _mix((_STEP if hashes is None else hashes * _STEP) + self.words[at + length - 1])

    def digests(self) -> np.ndarray:
        hashes = None
        for length in range(1, self.window + 1):
            hashes = self.prefix(hashes, self.at, length)
        return hashes >> _U(8)


def _frequent(window: int, share: float):
    """Prefixes and document ids that hold a share of a portion's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, PACK_BYTES):
            made, kinds, keys, counts = _Portion(batch.column(1), window), [], [], []
            at, hashes, least = made.at, None, max(2, share * len(made.at))
            for length in range(1, window):
                hashes = made.prefix(hashes, at, length)
                found, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
                many = n >= least
                kinds.append(np.full(many.sum(), _PREFIX))
                keys.append(found[many].view(np.int64))
                counts.append(n[many])
                at, hashes = at[many[of]], hashes[many[of]]
                if not len(at):
                    break
            ids = _ids(batch.column(0))
            found, of = np.unique(ids, return_inverse=True)
            n = np.bincount(of, np.diff(np.append(0, made.ends)), len(found)).astype(np.int64)
            many = n >= max(2, share * len(made.words))
            columns = [np.append(np.concatenate(x) if x else np.zeros(0, np.int64), more) for x, more in ((kinds, np.full(many.sum(), _DOC)), (keys, found[many]), (counts, n[many]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["kind", "key", "n"])
            give_back_memory()

    return run


def _groups(made: _Portion, at: np.ndarray, split: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix: by its first words, as many as it takes to leave the prefixes that are split."""
    out, open_, hashes = np.zeros(len(at), np.int64), np.arange(len(at)), None
    for length in range(1, made.window + 1):
        hashes = made.prefix(hashes, at[open_], length)
        more = np.isin(hashes, split) if len(split) else np.zeros(len(open_), bool)
        done = ~more if length < made.window else np.ones(len(open_), bool)
        out[open_[done]] = ((hashes[done] >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)
        open_, hashes = open_[~done], hashes[~done]
        if not len(open_):
            break
    return out


def _send_leaves(window: int, split: np.ndarray, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, PACK_BYTES):
            made = _Portion(batch.column(1), window)
            digest, doc = made.digests(), _ids(batch.column(0))[made.row[made.at]]
            order = np.lexsort((doc, digest))
            digest, doc = digest[order], doc[order]
            new = np.concatenate([[True], digest[1:] != digest[:-1]]) if len(order) else np.zeros(0, bool)
            own = new | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(order) else new  # once a document
            covered = ~new[own]
            at, digest, doc = made.at[order[own]], digest[own], doc[own]
            group = _groups(made, at, split, groups)
            order = np.lexsort((doc, group))
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[g] : cuts[g + 1]]
                blob = _pack([(np.diff(doc[some].astype(_U), prepend=_U(0)), 8), (digest[some], 7), (covered[some], 1)])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([blob], pa.binary())], ["grp", "blob"])
            del made
            give_back_memory()

    return run


def _home(ids: np.ndarray, part: np.ndarray, homes: int) -> np.ndarray:
    return (_mix(ids.astype(_U) * _U(31) + part.astype(_U)) % _U(homes)).astype(np.int64)


def _subtrees(homes: int, parted: dict[int, int]):
    """The covered windows of a group, for the homes of their documents."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in table.column("blob")]
        doc = np.concatenate([np.cumsum(x[0]).view(np.int64) for x in parts])
        digest, covered = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
        del parts
        leaves = np.lexsort((doc, digest))
        doc, digest, covered = doc[leaves], digest[leaves], covered[leaves] > 0
        node = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        least = np.repeat(doc[node], np.diff(np.append(node, len(doc))))
        hit = covered | (doc > least)
        doc, digest = doc[hit], digest[hit]
        home = _home(doc, np.zeros(len(doc)), homes)
        for i, n in parted.items():  # every home of such a document is told
            of = np.flatnonzero(doc == i)
            for k in range(1, n):
                doc, digest = np.append(doc, doc[of]), np.append(digest, digest[of])
                home = np.append(home, _home(doc[of], np.full(len(of), k), homes))
        order = np.lexsort((digest, doc, home))
        doc, digest, home = doc[order], digest[order], home[order]
        cuts = np.searchsorted(home, np.arange(homes + 1))
        used = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [_pack([(np.diff(doc[a:b].astype(_U), prepend=_U(0)), 8), (digest[a:b], 7)]) for a, b in ((cuts[h], cuts[h + 1]) for h in used)]
        give_back_memory()
        return pa.table([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["home", "blob"])

    return run


def _send_rows(homes: int, parted: dict[int, int], ids_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in portions(batches, text_at, 2 * PACK_BYTES):
            ids, part = _ids(batch.column(ids_at)), np.zeros(batch.num_rows)
            if parted:
                key = _keys(*text_bytes(batch.column(text_at))).view(_U)
                for i, n in parted.items():
                    part = np.where(ids == i, key % _U(n), part)
            home = _home(ids, part, homes)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(homes + 1))
            for h in np.flatnonzero(np.diff(cuts)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(order[cuts[h] : cuts[h + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["home", "blob"])
            give_back_memory()

    return run


def _kept_words(batch: pa.RecordBatch, ids_at: int, text_at: int, window: int, doc: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, list[bytes], list[tuple[int, int]]]]:
    """For each row its words' number, those that stay, and the maximal stretches of the others.

    ``doc`` are the documents with covered windows, ``known`` the mixed ids and digests of these; both sorted.
    """
    ids = _ids(batch.column(ids_at))
    marked = np.isin(ids, doc)
    some = pa.array(np.flatnonzero(marked))
    made = _Portion(batch.column(text_at).take(some), window)
    asked = _mix(ids[marked][made.row[made.at]].astype(_U) * _U(31) + made.digests())
    place = np.searchsorted(known, asked)
    hit = made.at[known[np.minimum(place, len(known) - 1)] == asked] if len(known) else made.at[:0]
    lost = np.zeros(len(made.words) + 1, np.int32)
    np.add.at(lost, hit, 1)
    np.add.at(lost, hit + window, -1)
    keep = np.cumsum(lost[:-1]) == 0
    data, ends = text_bytes(batch.column(text_at))
    raw, begin, word, nth = memoryview(np.ascontiguousarray(data)), 0, 0, 0
    for end, is_marked in zip(ends.tolist(), marked.tolist(), strict=True):
        words, spans = bytes(raw[begin:end]).split(), []
        begin, n = end, len(words)
        if is_marked:
            own = keep[word : int(made.ends[nth])]
            word, nth = int(made.ends[nth]), nth + 1
            edge = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8))).tolist()
            spans = list(zip(edge[::2], edge[1::2], strict=True))
            words = list(compress(words, own.tolist()))
        yield n, words, spans


def _cut(ids_at: int, text_at: int, window: int, named: list[str] | None):
    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in marks.column("blob")]
        doc = np.concatenate([np.cumsum(x[0]).view(np.int64) for x in parts]) if parts else np.zeros(0, np.int64)
        digest = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, _U)
        known, doc = np.sort(_mix(doc.astype(_U) * _U(31) + digest)), np.unique(doc)
        tables = []
        for batch in _rows_of(rows).combine_chunks().to_batches() if rows.num_rows else ():
            found = [(n, n - len(words), b" ".join(words), spans) for n, words, spans in _kept_words(batch, ids_at, text_at, window, doc, known)]
            n_words, removed, left, spans = zip(*found, strict=True) if found else ([], [], [], [])
            measures = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if named is None:
                tables.append(pa.table([batch.column(ids_at), *measures], ["doc_id", "n_words", "n_removed", "kept_sha256"]))
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                stretches = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)
                texts = [None if old is None else new.decode() for old, new in zip(batch.column(text_at).to_pylist(), left, strict=True)]
                columns = [pa.array(texts, pa.string()) if k == text_at else c for k, c in enumerate(batch.columns)]
                tables.append(pa.table([*columns, *measures, stretches], [*batch.schema.names, *named]))
        give_back_memory()
        return pa.concat_tables(tables) if tables else pa.table({})

    return run


def measure_names(columns: list[str]) -> list[str]:
    """Names of the measures beside some columns."""
    return fresh(columns, "n_words", "n_removed", "kept_sha256", "removed")


def cut_passages(docs: DataFrame, window: int = WINDOW, with_rows: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``.

    ``with_rows`` returns the rows themselves, ``text`` being the words that stay, joined by
    spaces, and after them the measures and the removed stretches (word numbers, end excluded)
    under ``measure_names``.  Null and empty texts have no words.  A null
    doc_id counts as larger than all others; rows with one doc_id don't cover each other, and a
    window covered for one is covered for all of them.  Repeated rows get the same result each.  An empty
    table gives no row.  A very long text is one portion: some 60 bytes a byte at its largest.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    own = docs if with_rows else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids_at, text_at = own.columns.index("doc_id"), own.columns.index("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, -(-total // group_bytes))
    share = max(1 / (4 * groups), 1 / MOST_SPLIT)
    said = plain.mapInArrow(_frequent(window, share), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    many = said.filter(F.col("n") >= F.lit(max(2, int(share * total / WORD_BYTES / 2)))).collect()
    split = np.array([r.key for r in many if r.kind == _PREFIX], np.int64).view(_U)
    # A document id with more words than a home takes is parted by its texts.
    parted = {r.key: min(groups, 1 + int(4 * r.n * WORD_BYTES // group_bytes)) for r in many if r.kind == _DOC}
    leaves = plain.mapInArrow(_send_leaves(window, np.sort(split), groups), "grp int, blob binary")
    marks = leaves.groupBy("grp").applyInArrow(_subtrees(groups, parted), "home int, blob binary")
    packed = own.mapInArrow(_send_rows(groups, parted, ids_at, text_at), "home int, blob binary")
    measures = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()))]
    named = None
    if with_rows:
        named = measure_names(docs.columns)
        spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
        fields = [*own.schema.fields, *(T.StructField(n, t) for n, t in zip(named, (*(m.dataType for m in measures), spans), strict=True))]
    else:
        fields = [T.StructField("doc_id", T.LongType()), *measures]
    return packed.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_cut(ids_at, text_at, window, named), T.StructType(fields))
