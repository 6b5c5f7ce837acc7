"""Nothing is cut: long words, short items, many rules and languages, streams without roles, exact places."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, langid, toxicity, urls


def test_words_are_letters_and_long_runs_are_pieces():
    assert langid.words_of("½ ² ①② 𐄇 12 Straße x²y") == ["straße", "x", "y"]
    run = "мир" * 40 + "word" * 30
    assert "".join(langid.pieces(run)) == run and max(map(len, langid.pieces(run))) <= langid.PIECE
    assert all(len({langid.script_of(c) for c in p}) == 1 for p in langid.pieces(run))


def test_texts_without_letters_are_undetermined(spark):
    model = langid.fit([("en", "the thing that was "), ("de", "nicht und die einer ")])
    rows = spark.createDataFrame([(1, "½ ²"), (2, "①②③"), (3, "12 _"), (4, "the ½")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_the_middle_of_a_long_run_has_its_own_label():
    model = langid.fit([("en", "the thing that was with this and other them " * 30), ("ru", "это другой язык " * 20)])
    text = "the" * 30 + "другой" * 30 + "the" * 30
    spans = langid.label_spans(text, langid.Labeller(model))
    assert [s[2] for s in spans] == ["en", "ru", "en"] and spans[1][:2] == (90, 270)


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    own = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(260)}
    rows = [(k, " ".join(rng.choice(w) for _ in range(30)), lang) for k, (lang, w) in enumerate(own.items())]
    rows += [(None, rows[0][1], "l0")] * 40 + [(900, None, "l1"), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, rows=5)
    assert len(model.languages) == 260
    got = langid.identify(docs.filter("doc_id < 260"), model).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']}" for r in got) > 250


def test_spark_counts_fit_the_same_model(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate([("en", "the thing that was thing"), ("de", "nicht und die einer und"), ("en", "other them thing")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.train(docs), langid.fit([(lang, t) for _, t, lang in rows])
    assert a.languages == b.languages and a.rows == b.rows and np.allclose(a.weights, b.weights)
    assert langid.train(docs.limit(0)).languages == []


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(None, "same text", "en")] * 50 + [(k, f"text {k}", "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, rows=100).collect()
    assert len(sample) == 31 and langid.training_sample(docs, rows=10).count() == 10


def test_language_predictions_on_held_out_rows(spark, sf_dir):
    from marlstone.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op2_language_id"](spark, sf_dir).join(docs, "doc_id").filter("held_out and lang is not null and text rlike '[A-Za-z]{5}'")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count() > 0
    assert QUERIES["op2_language_id"](spark, sf_dir).count() == docs.count()


def test_long_words_of_toxicity_are_read_whole():
    run = "".join(chr(97 + k * 7 % 26) for k in range(100))
    pieces = toxicity.words_of(run)
    assert all(any(run[k : k + 9] in p for p in pieces) for k in range(92)) and max(map(len, pieces)) <= toxicity.PIECE
    word = "abcdefghijklmnopqrstuvwx"
    assert len(toxicity.word_codes(word)[1]) == len(word)


def test_toxicity_scores_are_the_plain_maximum(spark):
    """The scores of the query's operator against a plain pass over one window at a time."""
    p = toxicity.train([("you are vile scum " * 3, 1), ("a fine day by the river " * 3, 0)] * 4, steps=40)
    texts = [None, "", "vile", "a fine day " * 60 + "vile scum " + "river " * 70, "x" * 500, "so fine"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, p).collect()}
    for k, t in enumerate(texts):
        words, best = toxicity.words_of(t), -np.inf
        for s, e in toxicity.windows_of(len(words)):
            codes = [toxicity.word_codes(w) for w in words[s:e]] or None
            if codes is None:
                x, at, mask = np.zeros((1, 2 * toxicity.WIDTH), np.float32), np.zeros((1, 1), int), np.ones((1, 1), np.float32)
                x[0, : toxicity.WIDTH] = p["ew"][0]
            else:
                x = np.stack([np.concatenate([p["ew"][i], p["ec"][c].mean(axis=0)]) for i, c in codes]).astype(np.float32)
                at, mask = np.arange(len(codes))[None, :], np.ones((1, len(codes)), np.float32)
            best = max(best, float(toxicity.forward(p, x, at, mask)[0][0]))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-best)), abs=1e-4), t


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_places_of_passages_are_exact(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaks = {1: (item, 0), 2: (item[:9] + item[14:], 5), 3: (item[:30] + "zz" + item[30:], 2), 4: (item[:40] + "#" + item[41:], 1), 5: ("x" + item[1:], 1)}
    docs = spark.createDataFrame([(k, f"lead {leak} tail") for k, (leak, _) in leaks.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    for k in (1, 3):
        assert (got[k]["start"], got[k]["end"], got[k]["edits"]) == (5, 5 + len(leaks[k][0]), leaks[k][1])
    assert set(got) <= set(leaks)
    for k, r in got.items():
        region = decontaminate.normalise(f"lead {leaks[k][0]} tail")[r["start"] : r["end"]]
        assert plain_distance(decontaminate.normalise(item), region) == r["edits"] <= decontaminate.edits_allowed(len(item))


def test_short_items_match_whole_words(spark):
    bench = spark.createDataFrame([(1, "a cat"), (2, "x"), (3, "ninebytes"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here is A cat."), (2, "a category"), (3, "x x"), (4, "ninebytess"), (5, "so ninebytes")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, 8, 13, 0), (3, 2, 0, 1, 0), (5, 3, 3, 12, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 4]


def test_many_rules_by_joins_equal_the_expression(spark, monkeypatch):
    rng = random.Random(2)
    rules = [urls.UrlRule(rng.choice(["allow", "block"]), f"{'h.' * rng.randrange(3)}s{rng.randrange(40)}.org", "/" + "p/" * rng.randrange(3)) for _ in range(1001)]
    pages = spark.createDataFrame([(k, f"http://{'h.' * rng.randrange(4)}s{rng.randrange(50)}.org/{'p/' * rng.randrange(4)}x", None) for k in range(300)] + [(900, None, None), (901, "none", "x")], "page_id long, url string, html string")
    joined = sorted(map(tuple, urls.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(urls, "MOST_RULES", 5000)
    assert joined == sorted(map(tuple, urls.judge_urls(pages, rules).collect())) and len(joined) == 302
    assert sum(r[3] is not None for r in joined) > 50


def test_aliases_meet_in_normal_form(spark):
    rules = [urls.UrlRule("block", "b.net", "/es/")]
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://P.org/z", link.format("HTTP://B.net:80/es/./x/../1?a=1&amp;b=2")), (2, "http://p.org/z#top", ""), (3, "http://b.net/es/1?a=1&b=2", ""),
        (4, "http://q.org", f"<!-- {link.format('http://b.net/es/2')} -->"), (5, "http://q.org/s", f"<script>{link.format('http://b.net/es/2')}</script>"),
        (6, "https://r.org:443", link.format("http://b.net/es/2")), (7, "https://r.org/", ""), (8, "http://r.org/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow"}
    paths = {"/a/../b": "/b", "/a/./b/": "/a/b/", "/../x": "/x", "/a/b/..": "/a/", "/..": "/", "/a/.": "/a/"}
    frame = spark.createDataFrame(list(paths.items()), "p string, want string")
    assert frame.select(urls.without_dots(F.col("p")).alias("got"), "want").filter("got <> want").count() == 0


def test_streams_need_not_repeat_roles(spark):
    rows = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"),
        (2, 0, 0, "message", "user", "x"), (2, 0, 1, "edit", None, "y"), (2, 1, 2, "message", "assistant", "old"), (2, 1, 3, "regenerate", None, "new"), (2, 1, 4, "delta", None, "er"),
        (3, 0, 0, "message", None, "z"), (3, 1, 1, "message", "user", "p"), (3, 1, 2, "edit", "assistant", "q"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = chat.format_chats(events)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conv_id", chat.read_chats(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "Hi"), ("assistant", "ab")], 2: [("user", "y"), ("assistant", "newer")], 3: [("", "z"), ("assistant", "q")]}
    assert {r["conv_id"]: r["loss_chars"] for r in chat.chat_digests(out).collect()} == {1: 2, 2: 5, 3: 1}
