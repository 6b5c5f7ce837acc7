"""Links between the tokens of two tokenizers over one text, by a dictionary of groups.

The ends that both tokenizations share cut a text into *groups* of tokens of A and
B.  All tokens of a group are linked with each other.  A corpus has few distinct
groups beside their occurrences, so each is interned once: its links are expanded
once, weighted by how often a document holds the group, and what corpus-wide counts
say about it is joined back by the group's key, which is its content (``a1,a2|b1``).

1. Tasks read documents in portions.  A space between two other characters is a
   border of pieces for both tokenizers (A's pattern begins a piece there, no piece
   of B holds a space after something else), so groups never cross it, and the
   *units* between such spaces are tokenized once a portion each.  The portion sends
   its documents with the numbers of their distinct groups, its dictionary of groups,
   and its pairs of ids with the number of its documents that hold them linked.
2. Counts of pairs are summed over portions; each A id gets its highest.
3. The dictionaries of all portions are made one, expanded into pairs, joined with the
   counts and summed for each group key.
4. Each portion gets these sums for its own groups; documents add them up.

A portion holds ``PACK_BYTES`` of text (or one document that is longer), so nothing
in a task grows with the corpus.  Hot groups travel once a portion.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers, write_stage
from marlstone.llm.common import give_back_memory

#: Text of a portion, and of units that are tokenized at once.
PACK_BYTES, UNITS_AT_ONCE = 8 << 20, 1 << 13
#: The spaces at which both tokenizations always part.
BORDER = re.compile(r"(?<=\S) (?=\S)").split
#: A text with this character is not what the tokens of B spell (they use it for the space).
SPACE_PIECE = "▁"

_STAGED = "kind int, portion long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held array<int>, times array<int>, grp int, key string, a int, b int, docs long"
_DOC, _GROUP, _PAIR = range(3)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """A byte-level tokenizer (A) and a piece tokenizer with byte fallback (B), with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        #: Whether borders are borders for B too: no piece holds its space after another character.
        self.parts = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in (self.b.id_to_piece(k) for k in range(self.b.get_piece_size())))

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(SPACE_PIECE, " ").encode()

    def units(self, text: str) -> list[str]:
        return BORDER(text) if self.parts else [text]

    def encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids by A of space+unit and by B of the unit."""
        for k in range(0, len(units), UNITS_AT_ONCE):
            some = units[k : k + UNITS_AT_ONCE]
            of_a = self.a.encode_batch([f" {u}" for u in some], add_special_tokens=False)
            yield from zip((x.ids for x in of_a), self.b.encode(some, num_threads=1), strict=True)

    def groups(self, unit: str, a: list[int], b: list[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]] | None:
        """The groups of a unit; None if the tokens don't spell it."""
        spelled_a, spelled_b = [self.a_bytes[t] for t in a], [self.b_bytes[t] for t in b]
        whole = f" {unit}".encode("utf-8", "surrogatepass")
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            return None
        if len(a) == 1 or len(b) == 1:
            return [(tuple(a), tuple(b))]
        out, i, j, from_a, from_b, at_a, at_b = [], 0, 0, 0, 0, len(spelled_a[0]), len(spelled_b[0])
        while True:
            if at_a == at_b:
                out.append((tuple(a[from_a : i + 1]), tuple(b[from_b : j + 1])))
                i, j = i + 1, j + 1
                from_a, from_b = i, j
                if i == len(a):
                    return out
                at_a, at_b = at_a + len(spelled_a[i]), at_b + len(spelled_b[j])
            elif at_a < at_b:
                i += 1
                at_a += len(spelled_a[i])
            else:
                j += 1
                at_b += len(spelled_b[j])


_ready: dict[tuple[str, str], Tokenizers] = {}


def load(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of two files, made once a worker."""
    if (a_path, b_path) not in _ready:
        _ready[a_path, b_path] = Tokenizers(a_path, b_path)
    return _ready[a_path, b_path]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and where each begins."""
    begins = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=begins[1:])
    return np.fromiter((v for x in lists for v in x), np.int64, begins[-1]), begins


def _gather(values: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of flattened ``values`` one after another, and how long each is."""
    size = (begins[1:] - begins[:-1])[which]
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - ends + size, size)], size


class _Portion:
    """A dictionary of the units and groups of some documents."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        self.tokenizers = tokenizers
        units, self.size = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = tokenizers.units(text) if text and SPACE_PIECE not in text else []
            self.size[k] = len(own)
            units += own
        coded = pa.array(units, pa.large_string()).dictionary_encode()
        del units
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self._intern(coded.dictionary.to_pylist())
        doc = np.repeat(np.arange(len(texts)), self.size)
        wrong = np.zeros(len(texts), bool)
        wrong[doc[~self.spelled[self.codes]]] = True
        self.codes = self.codes[~wrong[doc]]
        self.size[wrong] = 0
        self.doc = np.repeat(np.arange(len(texts)), self.size)

    def _intern(self, units: list[str]) -> None:
        known: dict[tuple, int] = {}
        of_unit, self.counts, self.spelled = [], np.zeros((len(units), 2), np.int64), np.ones(len(units), bool)
        for k, (unit, (a, b)) in enumerate(zip(units, self.tokenizers.encode(units), strict=True)):
            found = self.tokenizers.groups(unit, a, b)
            if found is None:
                self.spelled[k], found = False, []
            else:
                self.counts[k] = len(a), len(b)
            of_unit.append([known.setdefault(g, len(known)) for g in found])
        self.groups = list(known)
        self.keys = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in self.groups]
        self.unit_keys = [";".join([self.keys[g] for g in x]) for x in of_unit]
        self.unit_groups, self.unit_begins = _flat(of_unit)

    def documents(self) -> list[pa.Array]:
        n = len(self.size)
        groups, per_unit = _gather(self.unit_groups, self.unit_begins, self.codes)
        doc = np.repeat(self.doc, per_unit)
        links = np.array([len(a) * len(b) for a, b in self.groups], np.int64)
        both, times = np.unique(doc * len(self.groups) + groups, return_counts=True)
        self.held_doc, self.held = (both // max(1, len(self.groups)), both % max(1, len(self.groups)))
        cuts = np.searchsorted(self.held_doc, np.arange(n + 1))
        sums = [np.bincount(at, w, n).astype(np.int64) for at, w in ((self.doc, self.counts[self.codes, 0]), (self.doc, self.counts[self.codes, 1]), (doc, None))]
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, self.held_doc, links[self.held] * times)
        digests, begin, codes, spelled = [], 0, self.codes.tolist(), self.unit_keys.__getitem__
        for size in self.size.tolist():
            digests.append(hashlib.sha256(";".join(map(spelled, codes[begin : begin + size])).encode()).hexdigest() if size else "")
            begin += size
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (self.held, times)]
        return [*(pa.array(x, pa.int64()) for x in (*sums, n_links)), pa.array(digests, pa.string()), *lists]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids that are linked, and how many documents hold each."""
        known: dict[tuple[int, int], int] = {}
        of_group = [[known.setdefault((x, y), len(known)) for x in set(a) for y in set(b)] for a, b in self.groups]
        values, begins = _flat(of_group)
        pair, size = _gather(values, begins, self.held)
        once = np.unique(np.repeat(self.held_doc, size) * max(1, len(known)) + pair)
        docs = np.bincount(once % max(1, len(known)), minlength=len(known))
        ids = np.array(list(known), np.int64).reshape(-1, 2)
        held = docs > 0  # units of documents that aren't spelled bring none
        return ids[held, 0], ids[held, 1], docs[held]


def _portions(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text)
            if size > pack_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _intern(a_path: str, b_path: str, pack_bytes: int):
    schema = pa.schema([("kind", pa.int32()), ("portion", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("held", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("grp", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])

    def rows(n: int, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
        yield from (whole.slice(k, 4096) for k in range(0, n, 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, base = load(a_path, b_path), TaskContext.get().partitionId() << 32
        for nth, (ids, texts) in enumerate(_portions(batches, pack_bytes)):
            made = _Portion(tokenizers, texts)
            n, at = len(ids), base + nth
            names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times")
            yield from rows(n, kind=pa.array([_DOC] * n), portion=pa.array([at] * n), doc_id=pa.array(ids, pa.int64()), **dict(zip(names, made.documents(), strict=True)))
            a, b, docs = made.pairs()
            used = np.unique(made.held)
            n = len(used)
            yield from rows(n, kind=pa.array([_GROUP] * n), portion=pa.array([at] * n), grp=pa.array(used), key=pa.array([made.keys[g] for g in used.tolist()], pa.string()))
            n = len(a)
            yield from rows(n, kind=pa.array([_PAIR] * n), a=pa.array(a), b=pa.array(b), docs=pa.array(docs))
            del made
            give_back_memory()

    return run


def _add_up(docs: pa.Table, said: pa.Table) -> pa.Table:
    """Documents of a portion with the sums of what counts say about their groups."""
    held, times = (docs.column(c).combine_chunks() for c in ("held", "times"))
    size = held.value_lengths().to_numpy(zero_copy_only=False) if docs.num_rows else np.zeros(0, np.int64)
    at = np.repeat(np.arange(docs.num_rows), size)
    sums, number = [], said.column("grp").to_numpy()
    for name in ("best", "total"):
        value = np.zeros(number.max(initial=-1) + 1, np.int64)
        value[number] = said.column(name).to_numpy()
        out = np.zeros(docs.num_rows, np.int64)
        if len(at):
            np.add.at(out, at, value[held.flatten().to_numpy()] * times.flatten().to_numpy())
        sums.append(pa.array(out, pa.int64()))
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, *sums, docs.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


class Alignment:
    """The links of a corpus: its tokenizations are written once, in the shared folder."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, pack_bytes: int = PACK_BYTES):
        self.spark = docs.sparkSession
        import_on_workers(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_intern(a_path, b_path, pack_bytes), _STAGED)
        _, self.path = write_stage(rows, "alignment")

    def _kind(self, kind: int, *columns: str) -> DataFrame:
        return self.spark.read.schema(_STAGED).parquet(self.path).filter(F.col("kind") == kind).select(*columns)

    def pairs(self) -> DataFrame:
        """``(a, b, docs)``: how many documents hold an A id and a B id linked."""
        return self._kind(_PAIR, "a", "b", "docs").groupBy("a", "b").agg(F.sum("docs").alias("docs"))

    def groups(self) -> DataFrame:
        """``(key, best, total)`` for each distinct group: its links with the highest count of their A id, and the sum of its links' counts."""
        pairs = self.pairs()
        highest = pairs.groupBy("a").agg(F.max("docs").alias("most"))
        counted = pairs.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("top"))
        sides = F.split("key", r"\|")
        one = self._kind(_GROUP, "key").distinct().select("key", *(F.split(sides[k], ",").cast("array<int>").alias(n) for k, n in enumerate("xy")))
        one = one.select("key", "x", "y", F.explode(F.array_distinct("x")).alias("a"))
        one = one.select("key", "x", "y", "a", F.explode(F.array_distinct("y")).alias("b"))
        times = F.size(F.filter("x", lambda v: v == F.col("a"))).cast("long") * F.size(F.filter("y", lambda v: v == F.col("b")))
        links = one.select("key", "a", "b", times.alias("times")).join(counted, ["a", "b"])
        return links.groupBy("key").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("docs")).alias("total"))

    def documents(self) -> DataFrame:
        """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row."""
        said = self._kind(_GROUP, "portion", "grp", "key").join(self.groups(), "key").select("portion", "grp", "best", "total")
        docs = self._kind(_DOC, "portion", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times")
        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return docs.groupBy("portion").cogroup(said.groupBy("portion")).applyInArrow(_add_up, schema)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Measures of the links between two tokenizations of every row of ``docs(doc_id, text)``.

    Null and empty texts, and texts that the tokens don't spell, have no tokens:
    zeros and an empty digest.  Repeated rows count as documents each.  An empty
    table gives no row; other columns are not read.  A very long text is tokenized
    in units; one that has no border at all is one unit, tokenized whole.
    ``n_best`` takes all links whose count is their A id's highest, ties included.
    """
    return Alignment(docs, a_path, b_path).documents()
