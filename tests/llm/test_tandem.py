import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from marlstone.llm import queries, tandem


def plain_runs(w, least_length=24, least_exponent=3):
    """Maximal runs by comparing every word with the one a period on, for every period."""
    out, n = [], len(w)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least_length, least_exponent * q):
                if not any(q % d == 0 and all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                    out.append((s, length, q))
            i += 1
    return sorted(out)


def power(w):
    return any(len(w) % d == 0 and w == w[:d] * (len(w) // d) for d in range(1, len(w)))


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(i, words):
    runs = plain_runs(words)
    keep = [not any(s + q <= k < s + n for s, n, q in runs) for k in range(len(words))]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for w, k in zip(words, keep) if k)))


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def run(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in tandem.collapse_runs(spark.createDataFrame(rows, schema)).collect()), key=repr)


def texts(rng):
    """Words with periodic stretches, some inside others, some with a fault."""
    for _ in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            base = [rng.choice("abcx") for _ in range(rng.randrange(1, 12))]
            stretch = (base * 40)[: rng.randrange(10, 90)]
            if rng.random() < 0.3:
                stretch[rng.randrange(len(stretch))] = "fault"
            at = rng.randrange(len(w) + 1)
            w[at:at] = stretch * rng.choice([1, 1, 3])
        yield rng.choice([" ", "\n", " \t"]).join(w)


def test_against_plain_code(spark):
    rows = list(enumerate(texts(random.Random(5))))
    rows += [(1, "a " * 24), (1, "a " * 23), (None, "a b " * 40), (None, None), (900, ""), (901, " \n "), (902, "é\x1c é\x85 " * 30), (903, "x" * 5000), (904, "w\x00 " * 30), (1, "a " * 24)]
    assert run(spark, rows) == sorted((plain(i, plain_words(t)) for i, t in rows), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_squares_and_runs_of_small_strings(seed):
    rng = random.Random(seed)
    for _ in range(20):
        n, letters = rng.randrange(1, 45), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.3:
            w = [w[k % min(n, 7)] for k in range(n)]
        found = tandem.Suffixes(np.array(w))
        assert found.order.tolist() == sorted(range(n), key=lambda i: w[i:])
        start, period = tandem.covering_squares(found, np.full(n, n // 2))
        own = tandem.primitive(found, start, period)
        start, period = tandem.vocabulary(found, start[own], period[own])
        squares = [tuple(w[i : i + 2 * k]) for i, k in zip(start.tolist(), period.tolist())]
        assert len(set(squares)) == len(squares)
        assert set(squares) == {tuple(w[i : i + 2 * k]) for i in range(n) for k in range(1, (n - i) // 2 + 1) if w[i : i + k] == w[i + k : i + 2 * k] and not power(w[i : i + k])}
        runs = tandem.runs_of(np.array(w), np.full(n, n // 2))
        assert sorted(zip(*(x.tolist() for x in runs))) == plain_runs(w, 2, 2)


def test_other_lengths_and_exponents(spark):
    rng = random.Random(8)
    for least, exponent in ((2, 2), (5, 2), (12, 4), (30, 3)):
        w = [rng.choice("ab") for _ in range(120)] + list("abc" * 15) + [rng.choice("abc") for _ in range(60)]
        codes = np.array([ord(c) for c in w])
        _, *found = tandem.word_runs(codes, np.array([len(w)]), least, exponent)
        assert sorted(zip(*(x.tolist() for x in found))) == plain_runs(w, least, exponent)


def test_long_text_and_runs_themselves(spark):
    base = [f"w{k}" for k in range(3000)]
    words = base * 4 + ["end"] + ["tick", "tock"] * 50_000
    frame = spark.createDataFrame([(1, " ".join(words)), (2, "no run")], "doc_id long, text string")
    long, short = sorted(tandem.collapse_runs(frame, with_text=True).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in long.runs] == [(0, 12000, 3000), (12001, 100_000, 2)]
    assert (long.start, long.length, long.period, long.exponent_milli) == (12001, 100_000, 2, 50_000_000)
    assert long.collapsed == " ".join([*base, "end", "tick", "tock"])
    assert short.runs == [] and short.collapsed == "no run"


def planted(i, text):
    """The words that the query's rule makes of a document's."""
    w = plain_words(text)
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_registered_query_against_plain_code(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = planted(i, text)
        assert len(words) == len(plain_words(text))
        if len(words) < 4000:
            assert got[i] == plain(i, words)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a " * 30, 3, "x"), (2, None, None, None)]
    got = run(spark, rows, "doc_id int, text string, start int, runs string")
    assert got == sorted((plain(i, plain_words(t)) for i, t, *_ in rows), key=repr)
