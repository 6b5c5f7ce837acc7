"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, all
of them scored.  A run of word characters over ``PIECE`` is several words, pieces
that overlap, so every place of a run without spaces is read.  A word enters as a hashed word vector beside the mean of its
hashed character trigram vectors; two gated recurrent layers read the window in
either direction; attention pools their states into a logit; the text's logit is
its windows' largest.  Trained in numpy on a bounded sample of labelled rows
(``SAMPLE_ROWS`` of each class): the loss at the largest window is passed back to
the windows by a softmax of their logits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.stage import import_on_workers

#: Bound on the labelled rows of each class that the network is trained on.
SAMPLE_ROWS = 1000
WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTEND = 1 << 14, 1 << 12, 8, 8, 8
#: Characters of a word at most, and between the beginnings of the pieces of a longer run.
PIECE, PIECE_STEP = 24, 16
#: Spread of fresh word vectors, and the rate at which they learn.
SPREAD, RATE = 0.1, 0.25
STEPS, BATCH, SHARP = 300, 24, 2.0
#: Share of words hidden in training, and what word vectors lose a step, so that rare words aren't learned by heart.
DROPPED, FADE = 0.05, 0.003
WINDOWS_AT_ONCE = 4096
WORD_MEMORY = 1 << 17
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Words in order; a run over ``PIECE`` characters is cut into pieces that overlap."""
    found = _WORD.findall((text or "").lower())
    if not found or len(max(found, key=len)) <= PIECE:
        return found
    return [p for w in found for p in ([w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)])]


def word_codes(word: str) -> tuple[int, list[int]]:
    """The rows of a word in the word table and of all its trigrams, borders included (``PIECE`` at most)."""
    w = f"<{word}>"
    return xxhash.xxh32_intdigest(word) % WORD_ROWS, [xxhash.xxh32_intdigest(w[i : i + 3]) % CHAR_ROWS for i in range(max(1, len(w) - 2))]


def windows_of(n: int) -> list[tuple[int, int]]:
    """All windows over ``n`` words; no word still has one, empty, window."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng, f = np.random.default_rng(seed), np.float32
    p = {"ew": rng.normal(0, SPREAD, (WORD_ROWS, WIDTH)), "ec": rng.normal(0, SPREAD, (CHAR_ROWS, WIDTH))}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.35, (2 * WIDTH, 3 * HIDDEN))
        p["u" + d] = rng.normal(0, 0.35, (HIDDEN, 3 * HIDDEN))
        p["c" + d] = np.zeros(3 * HIDDEN)
    p |= {"wa": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "ba": np.zeros(ATTEND), "va": rng.normal(0, 0.3, ATTEND), "wo": rng.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1)}
    return {k: v.astype(f) for k, v in p.items()}


def word_inputs(p: dict, ids: np.ndarray, chars: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Input vectors of words from their rows; ``chars`` is padded with -1."""
    mean = (p["ec"][chars] * (chars >= 0)[:, :, None]).sum(axis=1) / np.maximum(n_chars, 1)[:, None]
    return np.concatenate([p["ew"][ids], mean], axis=1).astype(np.float32)


def _gru(p: dict, d: str, proj: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction: ``proj`` are the words' projected inputs, ``at`` the words of each window."""
    n, steps = at.shape
    h, u, hh = np.zeros((n, HIDDEN), np.float32), p["u" + d], HIDDEN
    states, cache = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x, m = proj[at[:, t]], mask[:, t : t + 1]
        rec = h @ u[:, : 2 * hh]
        gates = _sigmoid(x[:, : 2 * hh] + rec)
        z, r = gates[:, :hh], gates[:, hh:]
        rh = r * h
        new = np.tanh(x[:, 2 * hh :] + rh @ u[:, 2 * hh :])
        if keep:
            cache.append((t, h, z, r, rh, new, m))
        h = (h + z * (new - h)) * m
        states[:, t] = h
    return states, cache


def _gru_back(p: dict, g: dict, d: str, dstates: np.ndarray, cache: list, at: np.ndarray, dproj: np.ndarray) -> None:
    u, hh = p["u" + d], HIDDEN
    dh = np.zeros_like(dstates[:, 0])
    dgates_at = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
    for t, h, z, r, rh, new, m in reversed(cache):
        dh = (dh + dstates[:, t]) * m
        dnew = dh * z * (1 - new * new)
        drh = dnew @ u[:, 2 * hh :].T
        dz, dr = dh * (new - h) * z * (1 - z), drh * h * r * (1 - r)
        dgates = np.concatenate([dz, dr], axis=1)
        g["u" + d][:, 2 * hh :] += rh.T @ dnew
        g["u" + d][:, : 2 * hh] += h.T @ dgates
        dgates_at[:, t, : 2 * hh], dgates_at[:, t, 2 * hh :] = dgates, dnew
        dh = dh * (1 - z) + drh * r + dgates @ u[:, : 2 * hh].T
    flat, rows = at.ravel(), dgates_at.reshape(-1, 3 * HIDDEN)
    for k in range(3 * HIDDEN):
        dproj[:, k] += np.bincount(flat, weights=rows[:, k], minlength=len(dproj))


def forward(p: dict, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows over words with inputs ``x``; word 0 is padding."""
    sides = [_gru(p, d, x @ p["w" + d] + p["c" + d], at, mask, keep) for d in "fb"]
    h = np.concatenate([s for s, _ in sides], axis=2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = np.where(mask > 0, a @ p["va"], -1e9)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    pooled = (alpha[:, :, None] * h).sum(axis=1)
    logits = pooled @ p["wo"] + p["bo"][0]
    return logits, (sides, h, a, alpha, pooled)


def backward(p: dict, x: np.ndarray, at: np.ndarray, kept, dlogits: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense parameters and of the words' inputs."""
    sides, h, a, alpha, pooled = kept
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("ew", "ec")}
    g["wo"], g["bo"][0] = pooled.T @ dlogits, dlogits.sum()
    dpool = dlogits[:, None] * p["wo"]
    dalpha = (h * dpool[:, None, :]).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
    g["wa"], g["ba"] = np.einsum("nth,nta->ha", h, da), da.sum(axis=(0, 1))
    dh = alpha[:, :, None] * dpool[:, None, :] + da @ p["wa"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        dproj = np.zeros((len(x), 3 * HIDDEN), np.float32)
        _gru_back(p, g, d, dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], sides[k][1], at, dproj)
        g["w" + d], g["c" + d] = x.T @ dproj, dproj.sum(axis=0)
        dx += dproj @ p["w" + d].T
    return g, dx


class WordTable:
    """Rows of words, found once each; number 0 is padding."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ids, self.chars = [0], [[]]

    def row(self, word: str) -> int:
        got = self.rows.get(word)
        if got is None:
            got = self.rows[word] = len(self.ids)
            i, c = word_codes(word)
            self.ids.append(i)
            self.chars.append(c)
        return got

    def arrays(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars = np.full((len(self.ids) - start, PIECE), -1, np.int32)
        sizes = np.array([len(c) for c in self.chars[start:]], np.int64)
        chars[np.arange(PIECE)[None, :] < sizes[:, None]] = [x for c in self.chars[start:] for x in c]
        return np.array(self.ids[start:], np.int64), chars, sizes


def _windows(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, mask, text)`` of all windows of texts given as word numbers."""
    spans = [(k, s, e) for k, t in enumerate(texts) for s, e in windows_of(len(t))]
    at = np.zeros((len(spans), WINDOW), np.int64)
    mask = np.zeros((len(spans), WINDOW), np.float32)
    for n, (k, s, e) in enumerate(spans):
        at[n, : e - s] = texts[k][s:e]
        mask[n, : max(1, e - s)] = 1
    return at, mask, np.array([k for k, _, _ in spans], np.int64)


def train(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to ``(text, label)`` rows; one class only gives a constant score."""
    p, rng = fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        p["wo"][:] = 0
        p["bo"][0] = 4.0 if len(rows) and labels[0] else -4.0
        return p
    words = WordTable()
    texts = [[words.row(w) for w in words_of(t)] for t, _ in rows]
    ids, chars, sizes = words.arrays()
    yes, no = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    dense = [k for k in p if k not in ("ew", "ec")]
    m1, m2 = ({k: np.zeros_like(p[k]) for k in dense} for _ in range(2))
    seen = {k: np.full(len(p[k]), 1e-3, np.float32) for k in ("ew", "ec")}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(yes, BATCH // 3), rng.choice(no, BATCH - BATCH // 3)])
        at, mask, of = _windows([texts[k] for k in pick])
        at[rng.random(at.shape) < DROPPED] = 0
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape)
        x = word_inputs(p, ids[used], chars[used], sizes[used])
        logits, kept = forward(p, x, local, mask, keep=True)
        top = np.full(len(pick), -np.inf, np.float32)
        np.maximum.at(top, of, logits)
        share = np.exp(SHARP * (logits - top[of]))
        share /= np.bincount(of, weights=share, minlength=len(pick))[of]
        dlogits = ((_sigmoid(top) - labels[pick])[of] * share / len(pick)).astype(np.float32)
        g, dx = backward(p, x, local, kept, dlogits)
        rate = 0.02 * min(1.0, 2.2 * (1 - step / (steps + 1)))
        for k in dense:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.98 * m2[k] + 0.02 * g[k] ** 2
            p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.98**step)) + 1e-7)
        gw = np.zeros_like(p["ew"])
        np.add.at(gw, ids[used], dx[:, :WIDTH])
        gc = np.zeros_like(p["ec"])
        has = chars[used] >= 0
        np.add.at(gc, chars[used][has], np.repeat(dx[:, WIDTH:] / np.maximum(sizes[used], 1)[:, None], has.sum(axis=1), axis=0))
        for k, gk in (("ew", gw), ("ec", gc)):
            seen[k] += (gk**2).sum(axis=1)
            p[k] *= 1 - FADE
            p[k] -= (RATE * min(1.0, 2.2 * (1 - step / (steps + 1)))) * gk / np.sqrt(seen[k])[:, None]
    return p


class Scorer:
    """Scores texts; input projections of words are kept between texts."""

    def __init__(self, p: dict):
        self.p, self.words, self.x = p, WordTable(), np.zeros((0, 2 * WIDTH), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words.ids) > WORD_MEMORY:
            self.words, self.x = WordTable(), self.x[:0]
        known, row = self.words.rows.get, self.words.row
        rows = [[known(w) or row(w) for w in words_of(t)] for t in texts]
        self.x = np.concatenate([self.x, word_inputs(self.p, *self.words.arrays(len(self.x)))])
        top = np.full(len(texts), -np.inf, np.float32)
        at, mask, of = _windows(rows)
        for k in range(0, len(at), WINDOWS_AT_ONCE):
            logits, _ = forward(self.p, self.x, at[k : k + WINDOWS_AT_ONCE], mask[k : k + WINDOWS_AT_ONCE])
            np.maximum.at(top, of[k : k + WINDOWS_AT_ONCE], logits)
        return _sigmoid(top.astype(np.float64))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """Up to ``rows`` labelled whole texts of each class, by the order of a hash of the id.

    A document labelled both ways counts as toxic; null labels and ids don't count.  Of rows that share
    an id the text with the least digest stands.
    """
    voted = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [r for y in (0, 1) for r in voted.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    ids = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in chosen], "doc_id long, toxic int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # 2 * rows ids at most
    text = F.coalesce("text", F.lit(""))
    one = found.groupBy("doc_id", "toxic").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    return [(r["text"], r["toxic"]) for r in one.orderBy("doc_id").collect()]


def score_documents(docs: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs(doc_id, text)``; null texts score as empty ones.

    Repeated rows are scored each; an empty table gives no row; other columns are not read.
    A very long text has all its windows scored, ``WINDOWS_AT_ONCE`` at a time.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    shared = spark.sparkContext.broadcast(p)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer.score(texts))], ["doc_id", "score"])
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer.score(texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
