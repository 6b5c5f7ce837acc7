"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes, each prefix has one valid encoding, so it is enough to
store each prefix's *last* token.  Token ``t`` ends prefix ``i`` exactly if
``t`` spells its end and may follow the last token of prefix ``i - len(t)``: the
pair is one that merging by rank would leave apart.  The table of last tokens
allows exact appends (new prefixes are filled on) and re-encoding near an edit
(prefixes before it stay).

Pieces are the matches of the pre-tokenizer's pattern, each encoded on its own.
New short pieces of a batch fill their tables side by side: an automaton over all
tokens names the longest one that ends at each byte, and those it holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers
from marlstone.llm.common import give_back_memory

#: Distinct pieces a worker remembers, twice: when the newer memory is full it becomes the older one.
#: Prefixes are kept as they come; a full memory starts anew after many that found no room.
PIECE_MEMORY = 1 << 17
PAIR_MEMORY = 1 << 18
PREFIX_MEMORY = 1 << 18
#: Bytes of a piece whose table is filled beside others', pieces that are filled at once, and places of the pairs they remember (a power of two).
SHORT_PIECE = 48
SIDE_BY_SIDE = 1 << 14
PAIR_PLACES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Automaton:
    """States are the prefixes of all tokens; each knows the longest token that ends it.

    Steps are kept in an open table of places, not one for each state and byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        steps: dict[int, int] = {}
        token, depth, levels = [-1], [0], []
        for spelled, rank in ranks.items():
            state = 0
            for k, byte in enumerate(spelled):
                key = state << 8 | byte
                state = steps.get(key, 0)
                if not state:
                    state = steps[key] = len(token)
                    token.append(-1)
                    depth.append(k + 1)
            token[state] = rank
        self.token, self.depth = np.array(token, np.int32), np.array(depth, np.int32)
        self.bits = np.uint64(64 - max(8, 2 * len(steps)).bit_length())
        self.keys = np.full(1 << int(np.uint64(64) - self.bits), -1, np.int64)
        self.to = np.zeros(len(self.keys), np.int32)
        keys, to = np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        at, left = self._place(keys), np.arange(len(keys))
        while left.size:
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            self.to[at[free]] = to[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        #: The state of the longest proper end that is a prefix of a token, and of the longest end that is a token.
        self.fail = np.zeros(len(token), np.int32)
        self.out = np.where(self.token >= 0, np.arange(len(token), dtype=np.int32), 0).astype(np.int32)
        levels = self.depth[to]
        for level in range(1, int(levels.max(initial=0)) + 1):
            some = np.flatnonzero(levels == level)
            state, above, byte = to[some], (keys[some] >> 8).astype(np.int32), keys[some] & 255
            if level > 1:
                self.fail[state] = self.step(self.fail[above], byte)
            self.out[state] = np.where(self.token[state] >= 0, state, self.out[self.fail[state]])

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self.bits).astype(np.int64)

    def _child(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        keys = (states.astype(np.int64) << 8) | bytes_
        at = self._place(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.to[at], 0)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while left.size:
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        out = self._child(states, bytes_)
        left = np.flatnonzero((out == 0) & (states != 0))
        back = states[left]
        while left.size:
            back = self.fail[back]
            out[left] = self._child(back, bytes_[left])
            on = (out[left] == 0) & (back != 0)
            left, back = left[on], back[on]
        return out


class PrefixBPE:
    """Encodes and decodes by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).finditer
        self.split = regex.compile(pattern).findall
        self.spelled = {r: b for b, r in ranks.items()}
        #: Tokens by their bytes from the last to the first, as nested tables; -1 holds the token.
        self.endings: dict[int, dict] = {}
        for spelled, rank in ranks.items():
            node = self.endings
            for byte in reversed(spelled):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: Prefixes of pieces as numbered nodes, and each one's last token; bounded, then begun anew.
        self.prefixes: dict[int, int] = {}
        self.prefix_last: list[int] = [-1]
        self.passed = 0
        #: Made when pieces are first filled side by side: the automaton, lengths of tokens, which of them merging makes (-1: not known yet), pairs and whether they stay apart.
        self.automaton: Automaton | None = None

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merging by rank, lowest first and leftmost on ties, of pairs ranked under ``below``."""
        out = [piece[k : k + 1] for k in range(len(piece))]
        while len(out) > 1:
            rank, at = min((self.ranks.get(out[k] + out[k + 1], below), k) for k in range(len(out) - 1))
            if rank >= below:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a token that no merge makes is its own half."""
        got = self.parts.get(token)
        if got is None:
            merged = self._merge(self.spelled[token], token)
            got = (self.ranks[merged[0]], self.ranks[merged[1]]) if len(merged) == 2 else (token, token)
            self.parts[token] = got
        return got

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens open.

        A merge over the border would take the last part of ``left`` and the
        first part of ``right`` while both exist.  Walk the parts that touch the
        border from the latest formed to the earliest; a pair that merges before
        either of its sides has gone on joins the two.
        """
        key = (left, right)
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) >= PAIR_MEMORY:
                self.apart.clear()
            got = self.apart[key] = self._border_stays(left, right)
        return got

    def _border_stays(self, left: int, right: int) -> bool:
        ends = self._edge(left, 1)
        starts = self._edge(right, 0)
        # Each list holds (token, rank at which it merges into the next larger), smallest token first.
        i = j = 0
        spelled, ranks = self.spelled, self.ranks
        while True:
            (a, a_goes), (b, b_goes) = ends[i], starts[j]
            joined = ranks.get(spelled[a] + spelled[b])
            # On equal rank the leftmost goes first: the left part's own merge lies left of the border's.
            if joined is not None and joined < a_goes and joined <= b_goes:
                return False
            if i + 1 == len(ends) and j + 1 == len(starts):
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        chain_, over = [], 1 << 62
        while True:
            chain_.append((token, over))
            part = self.halves(token)
            if part[0] == token:
                break
            over, token = token, part[side]
        return chain_[::-1]

    def fill(self, piece: bytes, last: list[int]) -> None:
        """Extend ``last`` (the last token of each prefix from length 1 on) to the whole piece."""
        endings, apart = self.endings, self.apart.get
        for end in range(len(last), len(piece)):
            node, start, found = endings, end, []
            while start >= 0 and (node := node.get(piece[start])) is not None:
                if -1 in node:
                    found.append((start, node[-1]))
                start -= 1
            for start, token in reversed(found):
                if not start:
                    fits = self._reachable(token)
                elif (fits := apart((last[start - 1], token))) is None:
                    fits = self.may_follow(last[start - 1], token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")

    def _reachable(self, token: int) -> bool:
        return len(self.spelled[token]) == 1 or self.halves(token)[0] != token

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.spelled[last[end - 1]])
        return out[::-1]

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of a piece.  Prefixes met in earlier pieces bring their last token along."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        known, tokens, node, last = self.prefixes, self.prefix_last, 0, []
        for byte in piece:
            node = known.get(node << 8 | byte)
            if node is None:
                break
            last.append(tokens[node])
        if (met := len(last)) < len(piece):
            self.fill(piece, last)
            if len(tokens) + len(piece) < PREFIX_MEMORY:
                self._remember(piece, last, met)
            else:
                self.passed += 1
                if self.passed > 4 * PREFIX_MEMORY:
                    known.clear()
                    del tokens[1:]
                    self.passed = 0
        return tuple(self.walk_back(last))

    def _remember(self, piece: bytes, last: list[int], met: int) -> None:
        known, tokens, node = self.prefixes, self.prefix_last, 0
        for k, byte in enumerate(piece):
            key = node << 8 | byte
            if k >= met:
                known[key] = len(tokens)
                tokens.append(last[k])
            node = known[key]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.older.get(piece) or self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
            if len(piece) < 256:
                if len(self.pieces) >= PIECE_MEMORY:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        known, rest = self.pieces.get, self.encode_piece
        return list(chain.from_iterable([known(p) or rest(p) for p in self.split(text)]))

    def _side_by_side(self) -> Automaton:
        if self.automaton is None:
            most = max(self.spelled) + 1
            self.shared = list(range(most))  # one object a token, whatever the pieces that are remembered
            self.lengths = np.zeros(most, np.int32)
            self.lengths[list(self.spelled)] = [len(b) for b in self.spelled.values()]
            self.made = np.full(most, -1, np.int8)
            self.pair_keys, self.pair_apart = np.full(PAIR_PLACES, -1, np.int64), np.zeros(PAIR_PLACES, bool)
            self.automaton = Automaton(self.ranks)
        return self.automaton

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; each place remembers the last pair that fell on it."""
        keys = (left.astype(np.int64) << 32) | right
        at = ((keys.astype(np.uint64) * _ODD) >> np.uint64(65 - PAIR_PLACES.bit_length())).astype(np.int64)
        fits = self.pair_apart[at]
        new = np.flatnonzero(self.pair_keys[at] != keys)
        if new.size:
            some, where = np.unique(keys[new], return_inverse=True)
            told = np.array([self.may_follow(k >> 32, k & 0xFFFFFFFF) for k in some.tolist()], bool)
            fits[new] = told[where]
            self.pair_keys[at[new]] = keys[new]
            self.pair_apart[at[new]] = self._last_written(at[new], keys[new], fits[new])
        return fits

    def _last_written(self, at: np.ndarray, keys: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """For each place the answer of the pair whose key stands there, where several pairs fell on one."""
        stands = self.pair_keys[at] == keys
        self.pair_apart[at[stands]] = fits[stands]
        return self.pair_apart[at]

    def _all_made(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.made[tokens] < 0]).tolist():
            self.made[t] = self._reachable(t)
        return self.made[tokens] > 0

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``encode_bytes`` of short pieces that are no token: the last tokens of all their prefixes of a length are found together."""
        if not pieces:
            return []
        auto = self._side_by_side()
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        most, n = int(sizes[0]), len(pieces)
        flat = np.frombuffer(b"".join(pieces[k].ljust(most, b"\0") for k in order.tolist()), np.uint8).reshape(n, most).T.astype(np.int64)
        last, state = np.zeros((most, n), np.int32), np.zeros(n, np.int32)
        live = np.searchsorted(-sizes, -np.arange(most), side="left")  # pieces longer than each place
        for end in range(most):
            m = int(live[end])
            state = auto.step(state[:m], flat[end, :m])
            todo, node = np.arange(m), auto.out[state]
            while todo.size:
                if not node.all():
                    raise ValueError("a byte has no token")
                token, before = auto.token[node], end - auto.depth[node]
                fits, inner = np.zeros(len(todo), bool), before >= 0
                fits[~inner] = self._all_made(token[~inner])
                fits[inner] = self._all_apart(last[before[inner], todo[inner]], token[inner])
                last[end, todo[fits]] = token[fits]
                todo, node = todo[~fits], auto.out[auto.fail[node[~fits]]]
        at, who, found = sizes - 1, np.arange(n), []
        while who.size:
            token = last[at, who]
            found.append((who, token))
            at = at - self.lengths[token]
            who, at = who[at >= 0], at[at >= 0]
        owner, tokens = np.concatenate([w for w, _ in found[::-1]]), np.concatenate([t for _, t in found[::-1]])
        tokens = list(map(self.shared.__getitem__, tokens[np.argsort(owner, kind="stable")].tolist()))
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        out: list[tuple[int, ...]] = [()] * n
        for k, start, stop in zip(order.tolist(), [0, *ends[:-1]], ends, strict=True):
            out[k] = tuple(tokens[start:stop])
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """``encode`` of each text; short pieces that are new to the memory are encoded together first."""
        cut = list(map(self.split, texts))
        known, older, ranks = self.pieces, self.older, self.ranks
        met: dict[str, tuple[int, ...]] = {}
        new: list[tuple[str, bytes]] = []
        for p in set().union(*cut).difference(known):
            if (got := older.get(p)) is None:
                spelled = p.encode("utf-8", "surrogatepass")
                if spelled not in ranks and len(spelled) <= SHORT_PIECE:
                    new.append((p, spelled))
                    continue
                got = self.encode_bytes(spelled)
            met[p] = got
        new.sort(key=lambda x: len(x[1]))
        for k in range(0, len(new), SIDE_BY_SIDE):
            some = new[k : k + SIDE_BY_SIDE]
            met.update(zip([p for p, _ in some], self.encode_many([b for _, b in some]), strict=True))
        known.update(met)
        for pieces in cut:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))
        for p in [p for p in met if len(p) >= 256]:
            del known[p]
        if len(known) >= PIECE_MEMORY:
            self.older, self.pieces = known, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class EditableEncoding:
    """A text with its encoding, kept exact under appends and edits.

    Pieces before the one an edit touches, less two that the pattern may redraw,
    keep their tokens; the walk goes on until a piece border of the old text is met.
    """

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, text
        self.pieces = [(m.start(), bpe.encode_piece(m.group())) for m in bpe.find(text)]

    @property
    def ids(self) -> list[int]:
        return [t for _, ids in self.pieces for t in ids]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        old, moved = self.pieces, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, next((k for k, (at, _) in enumerate(old) if at >= start), len(old)) - 3)
        tail = {at + moved: k for k, (at, _) in enumerate(old) if at > end + 1}
        fresh, stop = [], len(old)
        for m in self.bpe.find(self.text, old[first][0] if old else 0):
            if m.start() in tail and m.start() > start + len(new) + 1:
                stop = tail[m.start()]
                break
            fresh.append((m.start(), self.bpe.encode_piece(m.group())))
        self.pieces = old[:first] + fresh + [(at + moved, ids) for at, ids in old[stop:]]


_ready: dict[tuple, PrefixBPE] = {}


def load(path: str, pattern: str) -> PrefixBPE:
    """The encoder of a vocabulary file, made once a worker."""
    if (path, pattern) not in _ready:
        with open(path, "rb") as lines:
            _ready[path, pattern] = PrefixBPE(read_ranks(lines), pattern)
    return _ready[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs(doc_id, text)``.

    ``with_ids`` adds the ids.  ``vocabulary`` is a rank file that every worker
    has (the library of tokenizers is installed on all of them).  Null texts are
    empty and have no token; repeated rows are encoded each; an empty table gives
    no row; other columns are not read.
    """
    import_on_workers(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        names = {t: str(t) for t in bpe.spelled}.__getitem__
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                counts, digests, decoded, kept = [], [], [], []
                for ids in bpe.encode_texts([text or "" for text in part.column(1).to_pylist()]):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join(map(names, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *counts], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(kept), np.int32, int(ends[-1])))))
                yield pa.RecordBatch.from_arrays(columns, fields)
        give_back_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
