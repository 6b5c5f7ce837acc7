import hashlib
import os
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, decontaminate, langid, toxicity, warc
from marlstone.llm.queries import QUERIES, vocabulary

DOC = "doc_id long, text string, lang string, ids string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)


# Byte-level BPE

@pytest.fixture(scope="module")
def coder():
    return bpe.load(*vocabulary())


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=coder.ranks, special_tokens={})


TEXTS = st.text(alphabet=st.sampled_from("abcdefthe  \n\t'sl0129.,;é漢🙂<|>\u00a0"), max_size=80)


def test_encoding_equals_library(coder, reference):
    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(t):
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t) and coder.decode(ids) == t.encode()

    check()
    rng = random.Random(2)
    spelled = list(coder.ranks)
    for _ in range(3000):
        piece = b"".join(rng.choice(spelled) for _ in range(rng.randrange(1, 4)))
        assert list(coder.encode_bytes(piece)) == reference._core_bpe.encode_single_piece(piece)
    assert coder.encode("x" * 20_000) == reference.encode_ordinary("x" * 20_000)


def test_edits_equal_fresh_encoding(coder, reference):
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), TEXTS.map(lambda x: x[:8])), max_size=12))
    def check(edits):
        e = bpe.EditableEncoding(coder, "the thing's 12 words\n\n  end")
        for at, size, new in edits:
            start = min(at, len(e.text))
            e.replace(start, min(len(e.text), start + size), new)
            assert e.ids == reference.encode_ordinary(e.text)
        e.append("  more")
        assert e.ids == reference.encode_ordinary(e.text)

    check()


def test_encode_rows(spark, reference):
    rows = [(1, "Hello <|endoftext|>", "en"), (1, "Hello <|endoftext|>", "en"), (None, None, None), (2, "", None)]
    got = bpe.encode_documents(frame(spark, rows), *vocabulary(), with_ids=True).collect()
    for r, (i, t, _) in zip(sorted(got, key=repr), sorted(((i, t or "", 0) for i, t, _ in rows), key=lambda x: (x[0] is None, x[0] or 0)) , strict=False):
        assert r["n_tokens"] == len(r["ids"])
    want = sorted((str(i), hashlib.sha256(" ".join(map(str, reference.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode_documents(frame(spark, []), *vocabulary()).count() == 0


# Languages

def test_viterbi_against_plain():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 1, 9, 3])
    scores = -rng.random((int(lengths.sum()), 3)).astype(np.float32) * 6
    got, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        own, best = scores[at : at + n], None
        import itertools

        for path in itertools.product(range(3), repeat=int(n)):
            value = sum(own[k, p] for k, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            best = max(best or (-1e9, ()), (value, path))
        if n:
            found = got[at : at + n].tolist()
            value = sum(own[k, p] for k, p in enumerate(found)) - 2.0 * sum(a != b for a, b in zip(found, found[1:], strict=False))
            assert value == pytest.approx(best[0], abs=1e-4)
        at += n


def test_mixed_text_has_spans_and_edges(spark):
    en, de = "the thing that was with this and other them", "nicht und die einer auch schon werden noch"
    model = langid.fit([("en", " ".join([en] * 30)), ("de", " ".join([de] * 30)), ("ru", "это другой язык " * 20)])
    text = f"{en} {en}. {de} {de} {de}"
    spans = langid.label_spans(text, langid.Labeller(model))
    assert [s[2] for s in spans] == ["en", "de"] and text[spans[1][0] :].startswith("nicht")
    rows = [(1, text, "en"), (2, None, "de"), (3, "123 --", None), (4, "другой", "en"), (5, "漢字", "en"), (2, None, "de"), (6, "a" * 300_000 + " the", "en")]
    got = sorted((tuple(r) for r in langid.identify(frame(spark, rows), model).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1][1] == "de" and by[2][1:] == ("und", 0.0) and by[3][1] == "und" and by[4][1] == "ru" and by[5][1] in ("de", "en", "ru")
    assert langid.identify(frame(spark, rows), langid.fit([])).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(frame(spark, []), model, with_spans=True).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, sf).filter("held_out").join(truth, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# Toxicity

def test_gradients_against_differences():
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    rng = np.random.default_rng(0)
    x, at, mask, d = rng.normal(0, 1, (20, 16)), rng.integers(0, 20, (3, 8)), np.ones((3, 8)), rng.normal(0, 1, 3)
    mask[1, 5:] = 0
    _, kept = toxicity.forward(p, x, at, mask, True)
    g, _ = toxicity.backward(p, x, at, kept, d)
    for name in ("wf", "wb", "uf", "ub", "cf", "wa", "ba", "va", "wo", "bo"):
        i = np.unravel_index(int(rng.integers(p[name].size)), p[name].shape)
        side = []
        for e in (1e-2, -1e-2):
            q = {**p, name: p[name].copy()}
            q[name][i] += e
            side.append(float((toxicity.forward(q, x, at, mask)[0] * d).sum()))
        assert g[name][i] == pytest.approx((side[0] - side[1]) / 2e-2, rel=2e-2, abs=2e-4), name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        spans = toxicity.windows_of(n)
        assert {k for s, e in spans for k in range(s, e)} == set(range(n)) and all(e - s <= toxicity.WINDOW for s, e in spans)
        assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_training_finds_words(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    def text(bad):
        t = [rng.choice(words) for _ in range(rng.randrange(10, 150))]
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["vile", "nasty"])
        return " ".join(t)
    rows = [(text(k % 2), k % 2) for k in range(500)]
    p = toxicity.train(rows, steps=150)
    fresh = [(text(k % 2), k % 2) for k in range(300)]
    score = toxicity.Scorer(p).score([t for t, _ in fresh])
    assert np.mean((score >= 0.5) == np.array([y for _, y in fresh])) > 0.9
    docs = frame(spark, [(1, "vile " * 50, None), (1, "vile " * 50, None), (None, None, None), (2, "", None), (3, "w1 " * 30_000, None)])
    got = toxicity.score_documents(docs, p).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(frame(spark, []), toxicity.train([])).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert sorted(y for _, y in toxicity.training_sample(docs, labels)) == [0, 1]


# Benchmark passages

def plain_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_passages_against_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randrange(4, 45))) for k in range(12)]
    docs = []
    for k in range(120):
        body = text(80)
        if k % 2:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 14)):
                leak[rng.randrange(len(leak))] = rng.choice(["", "z", "qq"])
            body = text(rng.randrange(20)) + " " + "".join(leak) + " " + text(rng.randrange(20))
        docs.append((k, body, None))
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*items, (90, None), (91, "x"), (None, items[0][1]), (3, items[3][1])]], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    want = {}
    for k, t, _ in docs:
        for i, item in items:
            b, d = decontaminate.normalise(item), decontaminate.normalise(t)
            found = [e for s, z in decontaminate.passages(b) if (e := plain_edits(b[s:z], d)) <= decontaminate.edits_allowed(z - s)]
            if found:
                want[k, i] = min(found)
    assert got == want and len(want) > 20
    left = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k, _, _ in docs if not any(a == k for a, _ in want)]


def test_passage_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    rows = [(None, "One, two\nthree FOUR five six; seven eight", None), (2, None, None), (3, "", None), (4, "w " * 200_000 + "one two three four five six seven eight", None), (4, "clean", None)]
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "None"]
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()) == ["2", "3", "4"]
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    many = decontaminate.contaminated(frame(spark, rows), bench.union(spark.createDataFrame([(2, "nothing like it here at all")], "item_id long, text string")))
    assert many.count() == 2


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number {k} has some words of its own {k * 7919}") for k in range(6)], "item_id long, text string")
    docs = frame(spark, [(k, f"before item number {k} has some words of its own {k * 7919} after", None) for k in range(6)])
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and len(whole) >= 6
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


# WARC

PAGE = "page_id long, url string, html string, file int, node string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], PAGE)


def test_audit_finds_damage(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 50 + 1)) for k in range(400)]
    good = warc.archive(pages(spark, rows), per_file=150)
    assert warc.audit(good, good, span=512, fanout=4).count() == 0
    hurt = good.withColumn("sha256", F.when(F.col("page_id").isin(7, 310), F.lit("0")).otherwise(F.col("sha256")))
    got = {(r["file"], r["status"]) for r in warc.audit(good, hurt, span=512, fanout=4).collect()}
    assert got == {(0, "changed"), (2, "changed")} and warc.audit(good, hurt, span=512, fanout=4).count() == 2
    less = good.filter("page_id <> 5 and file <> 1")
    lost = warc.audit(good, less, span=512, fanout=4)
    assert lost.filter("status = 'missing'").count() == 151 and warc.audit(less, good, span=512, fanout=4).filter("status = 'extra'").count() == 151
    assert warc.audit(good.limit(0), good.limit(0)).count() == 0


def test_archive_edges(spark):
    rows = [(None, None, None), (None, "u", ""), (1, "u", "é"), (1, "u", "é")]
    a = warc.archive(pages(spark, rows))
    assert a.count() == 4 and a.filter("file = -1").count() == 2 and a.filter("file = 0").select("offset").distinct().count() == 2
    assert warc.audit(a, a).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_come_back(spark, tmp_path, compression):
    rows = [(k, f"http://h/{k}", f"<p>é{k}</p>\r\n\r\n") for k in range(30)]
    warc.write_warc(pages(spark, rows), str(tmp_path / "w"), per_file=10, compression=compression)
    got = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted((r["uri"], bytes(r["body"]).decode()) for r in got.collect()) == sorted((u, h) for _, u, h in rows)
    index = warc.archive(pages(spark, rows), per_file=10)
    assert warc.audit(index, got).count() == 0
    if compression == "none":  # a file cut short, a byte overwritten, and a record more
        import glob

        one, two, three = (glob.glob(f"{tmp_path}/w/file={k}/part*")[0] for k in range(3))
        data = [open(f, "rb").read() for f in (one, two, three)]
        for f, d in zip((one, two, three), (data[0][:-10], data[1].replace(b"\xc3\xa915", b"\xc3\xa9!5"), data[2] + data[1][: len(data[1]) // 10 + 3]), strict=True):
            open(f, "wb").write(d)
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
        bad = {(r["file"], r["status"]) for r in warc.audit(index, warc.read_warc(spark, str(tmp_path / "w"), bodies=False)).collect()}
        assert bad == {(0, "changed"), (1, "changed"), (2, "extra")}
    assert list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))[0][3] == b"abc" and not list(warc.parse_records(b"junk"))


# Pipeline

def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.schema.names == docs.schema.names
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in seen.select("doc_id").collect()}
        seen = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in seen.collect()} and out.count() > 100
    hashes = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in seen.collect()}
    assert all(hashes[r["doc_id"]] == r["decoded_sha256"] for r in out.collect())
