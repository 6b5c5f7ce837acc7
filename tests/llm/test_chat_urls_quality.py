import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, components, quality, urls
from marlstone.llm.queries import QUERIES, SQL
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), SQL[name])


# Chats

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, formatted string, extra int"


def chats(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], EVENTS))


def turns(spark, rows):
    read = chats(spark, rows).select("conv_id", chat.read_chats(F.col("formatted")).alias("t"))
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in read.collect()}


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "Hi"),
        (1, 1, 1, "message", "assistant", ""), (1, 1, 3, "delta", "assistant", "b"), (1, 1, 2, "delta", "assistant", "a"),
        (1, 1, 4, "regenerate", "assistant", "x"), (1, 1, 5, "delta", "assistant", "y"),
        (1, 0, 6, "edit", "user", "Hello"),
    ]
    assert turns(spark, rows) == {1: [("user", "Hello"), ("assistant", "xy")]}


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "|>", "a\nb\n", "", "<|im_end|>\n", "\\", "🙂<|im_start|>", "$1 \\1"]


def test_texts_come_back(spark):
    rows = [(k, 0, 0, "message", "user", t) for k, t in enumerate(NASTY)] + [(k, 1, 1, "message", "assistant", t) for k, t in enumerate(NASTY)]
    assert turns(spark, rows) == {k: [("user", t), ("assistant", t)] for k, t in enumerate(NASTY)}
    out = chats(spark, rows)
    digests = {r["conv_id"]: r for r in chat.chat_digests(out).collect()}
    assert all(digests[k]["loss_chars"] == len(t) for k, t in enumerate(NASTY))
    assert all("".join(p["text"] for p in r["pieces"]) == r["formatted"] for r in out.collect())


@pytest.mark.parametrize("role", ["a\nb", "\\n", "\\\n", "<|im_end|>", ""])
def test_roles_come_back(spark, role):
    assert turns(spark, [(1, 0, 0, "message", role, "t")]) == {1: [(role, "t")]}


def test_chat_nulls_repeats_and_none(spark):
    rows = [(None, None, None, None, None, None), (1, 0, 0, "message", "user", "a"), (1, 0, 0, "message", "user", "a"), (1, 1, 1, "message", "assistant", None)]
    got = turns(spark, rows)
    assert got[None] == [("", "")] and got[1] == [("user", "a"), ("user", "a"), ("assistant", "")]
    assert chats(spark, []).count() == 0


def test_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("w "), 50).alias("text"))
    r = chat.chat_digests(chat.format_chats(chat.conversation_events(rows))).first()
    assert r["n_turns"] == 3000


# URLs

RULES = [urls.UrlRule("allow", "com", "/"), urls.UrlRule("block", "example.com", "/en/"), urls.UrlRule("allow", "www.example.com", "/en/"), urls.UrlRule("block", "net", "/es/")]
PAGE = "page_id long, url string, html string, host string, verdict int"


def judged(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, RULES, **more).collect()}


def test_rules_and_parts(spark):
    got = judged(spark, [(1, "http://M.Example.com/en/a?x=/b#c", ""), (2, "https://www.example.com/en/", None), (3, "http://example.com", ""), (4, "http://notexample.com/en/", ""), (5, "nohost/en", ""), (6, None, ""), (7, "http://a.net#/es/", ""), (8, "x://b.net/es/://c", "")])
    assert got[1] == ("m.example.com", "/en/a", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3] == ("example.com", "", None, "allow")
    assert got[4][2:] == ("com/", "allow") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("a.net", "", None, "allow") and got[8] == ("b.net", "/es/://c", "net/es/", "block")


def test_aliases_share_decisions(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.org/x", canonical.format("http://b.net/es/1")), (2, "http://b.net/es/1", ""), (3, "http://c.org/#f", "<META http-equiv=refresh content='0; url=//a.org/x'>"),
        (4, "http://d.org/p/q", canonical.format("../z") + canonical.format("/r")), (5, "http://d.org/r", canonical.format("http://k.com/")), (6, "http://d.org/r", canonical.format("http://b.net/es/9")), (7, "http://e.org", ""),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    extra = spark.createDataFrame([("http://e.org", "http://b.net/es/1")], "a string, b string")
    assert judged(spark, rows, redirects=extra)[7][3] == "block"
    assert judged(spark, []) == {}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2080)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    want = {n: find(n) for n in root}
    assert got == {n: r for n, r in want.items() if n in {x for p in pairs if None not in p and p[0] != p[1] for x in p}}


# Quality

DOC = "doc_id long, text string, source string, kept int, key string, host int"


def verdicts(spark, rows, rules=quality.QualityRules()):
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], DOC)
    return quality.quality_verdicts(docs, rules), quality.apply_quality(docs, rules)


def test_base_measures_against_brute_force(spark):
    texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "a a a a a", "x\nx\n\n x\n", "# $ <b>\u00a0é", "p q r s p q r t q r s", " ".join(["w"] * 5000), "\u2028 a\x1cb"]
    got = {r["doc_id"]: r for r in verdicts(spark, [(k, t, "s") for k, t in enumerate(texts)])[0].collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i in range(len(w) - 2) for j in range(3) if count[w[i], w[i + 1], w[i + 2]] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, k


def test_frequent_lines_deplete(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    common = " ".join(f"c{i}" for i in range(300))
    rules = quality.QualityRules(line_min_docs=5, line_host_percent=10)
    rows = [(k, f"{body(k)}\n {common.upper()} ", "a") for k in range(10)] + [(100 + k, body("copy"), "a") for k in range(30)] + [(200, f"{body(200)}\n{common}", "b"), (201, body(201), None), (200, f"{body(200)}\n{common}", "b")]
    out, kept = verdicts(spark, rows, rules)
    got = {(r["doc_id"], r["kept"]) for r in out.collect()}
    assert {k for k, ok in got if not ok} == set(range(10))
    assert out.count() == len(rows) and sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(100, 130), 200, 200, 201])
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert verdicts(spark, [])[0].count() == 0 and verdicts(spark, [])[1].count() == 0
    assert verdicts(spark, [(None, None, None)])[0].first()["kept"] is False


def test_null_and_empty_texts_count_once_a_host(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    common = " ".join(f"c{i}" for i in range(300))
    rules = quality.QualityRules(line_min_docs=1, line_host_percent=60)
    rows = [(1, f"{body(1)}\n{common}", "a"), (2, f"{body(2)}\n{common}", "a"), (3, None, "a"), (4, "", "a")]
    assert not any(r["kept"] for r in verdicts(spark, rows, rules)[0].collect())  # two of three texts hold the line
