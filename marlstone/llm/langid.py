"""Language identification of mixed-language text.

1. Words are runs of letters (category L), lower-cased; a run is cut where its
   script changes and into pieces of ``PIECE`` letters, so that a run without
   spaces is a walk of its own and every letter of it counts.  The script of a
   word (by code ranges) leaves the languages that training has seen in that
   script; a word in a script that no language uses says nothing.
2. Each word scores every language: log-probability of its character pairs and triples
   (with word borders) under that language, capped so that one odd word can't
   decide a span.
3. A Viterbi walk over the words with a penalty for each switch labels spans.
   Texts of a batch take their steps together in numpy, longest text first.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` a
language, chosen by a hash of id and text), whose n-grams Spark counts; the
driver sees counts only.  Every language that the sample holds is learned, and
everything else covers all rows.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.stage import drop_stage, import_on_workers, write_stage

#: Bound on the labelled rows that the model is fitted on, for each language.
SAMPLE_ROWS = 600
#: N-grams that the model keeps at most, the most frequent ones, and numbers it holds: many languages leave room for fewer n-grams.
MOST_GRAMS, MOST_CELLS = 60_000, 12_000_000
#: Values of ``lang`` that can be told apart; more are an error, none is left out.
MOST_LANGUAGES = 10_000
#: Letters of a word at most; longer runs are several words.
PIECE = 32
SWITCH_PENALTY = 8.0
WORD_CAP = 12.0
#: Words whose scores a worker remembers, and words whose walk runs at once.
WORD_MEMORY = 1 << 18
WORDS_AT_ONCE = 1 << 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
#: Fractions, circled digits and the like: word characters of the pattern language, but no letters.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: A class of the basic plane is a table look-up, one beyond it a search; few texts need that.
_NUMERAL, _FAR, _FAR_NUMERAL = re.compile(f"[{''.join(c for c in _NUMERALS if c <= chr(0xFFFF))}]"), re.compile("[\U00010000-\U0010FFFF]"), re.compile(f"[{''.join(c for c in _NUMERALS if c > chr(0xFFFF))}]")
#: First code points of script ranges; the code points of a range are written in one script (fixed values).
SCRIPTS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]
_STARTS = [s for s, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(word[0])) - 1)][1]


def grams(word: str) -> list[str]:
    """Character pairs and triples of a word with its borders."""
    w = f" {word} "
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


def pieces(run: str) -> list[str]:
    """A run of letters cut where its script changes, and into ``PIECE`` letters; the pieces make up the run."""
    cuts = [0, *(k for k in range(1, len(run)) if script_of(run[k]) != script_of(run[k - 1])), len(run)] if not run.isascii() else [0, len(run)]
    return [run[s : min(s + PIECE, e)] for a, e in zip(cuts, cuts[1:], strict=False) for s in range(a, e, PIECE)]


def letters_only(text: str) -> str:
    """A text of the same length whose word characters are letters, digits and ``_``."""
    if text.isascii():
        return text
    text = _NUMERAL.sub(" ", text)
    return _FAR_NUMERAL.sub(" ", text) if _FAR.search(text) else text


def words_of(text: str, known: dict[str, list[str]] | None = None) -> list[str]:
    """The words of a text; ``known`` remembers the pieces of runs."""
    found = _WORD.findall(letters_only(text.lower()))
    if not found or (text.isascii() and len(max(found, key=len)) <= PIECE):
        return found
    known = {} if known is None else known
    return [p for w in found for p in (known.get(w) or known.setdefault(w, pieces(w)))]


@dataclass
class LanguageModel:
    """Log-probabilities of n-grams by language (row 0: unseen ones), and the scripts of each language."""

    languages: list[str]
    rows: dict[str, int]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words, 0 for the likeliest language; zero for all where the script says nothing."""
        row = self.rows.get
        found = [[row(g, 0) for g in grams(w)] for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
        score = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        none = np.zeros(len(self.languages), bool)
        use = np.stack([self.scripts.get(script_of(w), none) for w in words])
        score[~use] = -np.inf
        best = np.where(use.any(axis=1), score.max(axis=1), 0)[:, None]
        score = np.maximum(score - best, -WORD_CAP)
        score[~use.any(axis=1)] = 0
        return score.astype(np.float32)


def count_words(words: Iterable[str] | Counter) -> Counter:
    """N-grams of words or of counted words, and, under a leading NUL, the letters in each script."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for g in grams(w):
            out[g] += n
        out["\0" + script_of(w)] += n * len(w)
    return out


def model_of(counts: dict[str, dict[str, float]], kept: list[str], totals: dict[str, float]) -> LanguageModel:
    """A model of the n-grams ``kept``: ``counts`` of each language and ``totals`` of all its n-grams."""
    languages = sorted(totals)
    table = np.array([[0] * len(languages), *([counts[k].get(g, 0) for k in languages] for g in kept)], float).reshape(len(kept) + 1, len(languages))
    total = np.array([totals[k] for k in languages], float)
    weights = np.log((table + 0.3) / (total + 0.3 * len(table))).astype(np.float32)
    letters = {s: np.array([counts[k].get("\0" + s, 0) for k in languages], float) for s in {name for _, name in SCRIPTS}}
    sums = sum(letters.values())
    scripts = {s: n > 0.01 * sums for s, n in letters.items() if (n > 0.01 * sums).any()}
    return LanguageModel(languages, {g: k for k, g in enumerate(kept, 1)}, weights, scripts)


def _most_grams(languages: int) -> int:
    return min(MOST_GRAMS, MOST_CELLS // max(1, languages))


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model of ``(lang, text)`` rows; no row with a letter gives a model without languages."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(count_words(words_of(text)))
    counts = {k: c for k, c in counts.items() if c}
    every: Counter = Counter()
    for c in counts.values():
        every.update({g: n for g, n in c.items() if g[0] != "\0"})
    kept = sorted((g for g, n in every.items() if n > 1), key=lambda g: (-every[g], g))[: _most_grams(len(counts))]
    return model_of(counts, kept, {k: sum(n for g, n in c.items() if g[0] != "\0") for k, c in counts.items()})


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; texts lie one after another in ``scores``, ``lengths`` words each."""
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (ends - lengths)[order], lengths[order]
    label = np.uint8 if scores.shape[1] < 1 << 8 else np.int32
    back = np.zeros(len(scores), label)  # the label that a switch at this word came from
    switched = np.zeros(scores.shape, bool)
    best = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + t
        if t:
            top = best[:live].argmax(axis=1)
            jump = best[np.arange(live), top] - penalty
            moved = best[:live] < jump[:, None]
            back[at] = top
            switched[at] = moved
            best[:live] = np.where(moved, jump[:, None], best[:live]) + scores[at]
        else:
            best[:live] = scores[at]
    labels = np.zeros(len(scores), label)
    now = best.argmax(axis=1).astype(label)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + t
        labels[at] = now[:live]
        now[:live] = np.where(switched[at, now[:live]], back[at], now[:live])
    return labels


class Labeller:
    """Scores words once and walks over texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows, self.scores = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Labels (as numbers of languages) of the words of each text."""
        if len(self.rows) > WORD_MEMORY:
            self.rows, self.scores = {}, self.scores[:0]
        fresh = list(set(chain.from_iterable(texts)) - self.rows.keys())
        if fresh:
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(fresh)])
        lengths = np.array([len(t) for t in texts], np.int64)
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        return np.split(viterbi(self.scores[rows], lengths), np.cumsum(lengths)[:-1]) if len(texts) else []


def label_spans(text: str, labeller: Labeller) -> list[tuple[int, int, str]]:
    """``(start, end, lang)`` spans of a text, from first to last letter of each run."""
    found = [p for m in _WORD.finditer(letters_only(text)) for p in _placed(m.start(), m.group())]
    (labels,) = labeller.label([[text[a:b].lower() for a, b in found]])
    spans: list[tuple[int, int, str]] = []
    for (a, b), k in zip(found, labels.tolist(), strict=True):
        lang = labeller.model.languages[k]
        if spans and spans[-1][2] == lang:
            spans[-1] = (spans[-1][0], b, lang)
        else:
            spans.append((a, b, lang))
    return spans


def _placed(at: int, run: str) -> list[tuple[int, int]]:
    """Where the pieces of a run lie."""
    out = []
    for p in pieces(run):
        out.append((at, at + len(p)))
        at += len(p)
    return out


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(lang, text)`` of up to ``rows`` labelled rows of each language, by the order of a hash of id and text.

    A count by language sets the share of hashes that is read, with room to
    spare, and what comes is cut by rank.  Rows equal in language, id and text
    count once; null languages and texts not at all.
    """
    some = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = some.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang are no languages")
    counts = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long"))  # MOST_LANGUAGES rows at most
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24)
    share = F.least(F.lit(1.0), F.lit(1.2 * rows + 40) / F.col("n")) * float(1 << 40)
    near = some.join(counts, "lang").filter(place <= share).groupBy("lang", place.alias("h")).agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return near.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= rows).select("lang", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of the labelled rows of ``docs(doc_id, text, lang)``; what is collected is bounded by the model's size."""
    import_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py(), known))
            found = [(k, g, n) for k, c in counts.items() for g, n in count_words(c).items()]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "gram", "n"])

    sampled = training_sample(docs, rows).mapInArrow(run, "lang string, gram string, n long")
    counted, where = write_stage(sampled.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    letters = F.col("gram").startswith("\0")
    totals = {r["lang"]: r["n"] for r in counted.filter(~letters).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    every = counted.filter(~letters).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    kept = [r["gram"] for r in every.orderBy(F.desc("n"), "gram").limit(_most_grams(len(totals))).collect()]
    known = counted.filter(letters).unionByName(counted.join(docs.sparkSession.createDataFrame([(g,) for g in kept], "gram string"), "gram", "left_semi").select("lang", "gram", "n"))
    counts: dict[str, dict[str, float]] = {k: {} for k in totals}
    for r in known.collect():  # MOST_CELLS at most, and a row for each script of a language
        counts[r["lang"]][r["gram"]] = r["n"]
    drop_stage(docs.sparkSession, where)
    return model_of(counts, kept, totals)


def identify(docs: DataFrame, model: LanguageModel, with_spans: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language of most letters, ``score`` its share of them;
    a null text or one without letters is ``und`` with score 0, and so is any
    text under a model without languages.  Texts are read whole, however long:
    one is a walk of its own over all its words.  ``with_spans`` adds the labelled runs
    of words as ``spans``.  Repeated rows are labelled each; an empty table gives
    no row; other columns are not read.
    """
    spark = docs.sparkSession
    import_on_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by MOST_CELLS
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        languages, known = shared.value.languages, {}

        def solve(ids: list, texts: list[str]) -> pa.RecordBatch:
            if len(known) > WORD_MEMORY:
                known.clear()
            words = [words_of(t, known) if languages else [] for t in texts]
            labels = labeller.label(words) if languages else [()] * len(texts)
            preds, scores, spans = [], [], []
            for text, w, own in zip(texts, words, labels, strict=True):
                if not w:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    spans.append([])
                    continue
                mass = np.bincount(own, weights=np.fromiter(map(len, w), np.int64, len(w)), minlength=len(languages))
                preds.append(languages[int(mass.argmax())])
                scores.append(float(mass.max() / mass.sum()))
                if with_spans:
                    spans.append([{"start": a, "end": b, "lang": lang} for a, b, lang in label_spans(text, labeller)])
            columns = [pa.array(ids, pa.int64()), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(columns + [pa.array(spans, span)] * with_spans, ["doc_id", "lang_pred", "score", *["spans"] * with_spans])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or ""
                if texts and held + len(text) > 3 * WORDS_AT_ONCE:
                    yield solve(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i.as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield solve(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
