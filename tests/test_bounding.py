"""Cuts by running totals against plain loops that render the report after every pop or halving."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import bounding as B
from marlstone.operators import budget


def text_of(report):
    return json.dumps(report, ensure_ascii=False, separators=(",", ":"))


def plain_compact(report, tokens):
    def size():
        return -(-len(text_of(report)) // 4)

    if tokens < 256:
        while size() > tokens:
            family = next((n for n in B.SMALL_POP_ORDER if len(report.get(n, [])) > 1), None)
            if family is None:
                for n in ("findings", "omissions", *(("edges", "ranking") if tokens < 20 else ("snippets",))):
                    report[n].clear()
                break
            report[family].pop()
    else:
        while size() > tokens:
            family = next((n for n in B.POP_ORDER if report.get(n)), None)
            if family is None:
                break
            report[family].pop()
    return {n: len(x) for n, x in report.items()}


def half(items, least):
    if len(items) <= least:
        return False
    del items[max(-(-len(items) // 2), least) :]
    return True


def plain_evidence(report, most):
    while len(text_of(report).encode()) > most:
        if any([half(f["symbols"], 16) for f in report["files"]]):
            continue
        if any([half(report[n], least) for n, least in B.HALVED.items() if n in report]):
            continue
        if not half(report["files"], 8):
            break
    return {n: len(x) for n, x in report.items()} | {"symbols": sum(len(f["symbols"]) for f in report["files"])}


def made(rng, scale, symbols=0):
    word = lambda: "".join(rng.choice("abé\"\\ ü") for _ in range(rng.randrange(12)))
    names = [*B.POP_ORDER]
    report = {n: [{"at": k, "x": word()} for k in range(rng.randrange(scale))] for n in names}
    for k, f in enumerate(report["files"]):
        f["symbols"] = [{"n": j, "name": word()} for j in range(rng.randrange(symbols))] if symbols else []
    return report


def collections(spark, report, size, with_symbols=False):
    out = []
    for n, items in report.items():
        rows = spark.createDataFrame([(x["at"], x["x"]) for x in items], "at int, x string")
        out.append(B.Collection(n, rows, [F.asc("at")], size("at", "x") + (len(',"symbols":[]') if n == "files" and not with_symbols else 0)))
    return out


@pytest.mark.parametrize("tokens", [19, 60, 255, 300, 900])
def test_pops_equal_a_loop(spark, tokens):
    rng = random.Random(tokens)
    report = made(rng, 40)
    got = {r["name"]: r["returned"] for r in B.compact_bound(collections(spark, report, B.json_chars), tokens).collect()}
    assert got == plain_compact(report, tokens)


@pytest.mark.parametrize("most", [600, 6_000, 20_000])
def test_halvings_equal_a_loop(spark, most):
    rng = random.Random(most)
    report = made(rng, 60, symbols=70)
    symbols = spark.createDataFrame([(f["at"], s["n"], s["name"]) for f in report["files"] for s in f["symbols"]], "at int, n int, name string")
    own = B.Collection("symbols", symbols, [F.asc("n")], B.json_bytes("n", "name"))
    got = {r["name"]: r for r in B.evidence_bound(collections(spark, report, B.json_bytes, True), own, "at", most).collect()}
    totals = {n: len(x) for n, x in report.items()} | {"symbols": symbols.count()}
    want = plain_evidence(report, most)
    assert {n: r["returned"] for n, r in got.items()} == want
    assert {n: (r["total"], r["truncated"], r["reason"]) for n, r in got.items()} == {n: (t, want[n] < t, "output_budget" if want[n] < t else None) for n, t in totals.items()}


def test_empty_collections(spark):
    report = {n: [] for n in B.POP_ORDER}
    assert all(r["returned"] == 0 and not r["truncated"] for r in B.compact_bound(collections(spark, report, B.json_chars), 300).collect())
    nothing = spark.createDataFrame([], "at int, n int, name string")
    own = B.Collection("symbols", nothing, [F.asc("n")], B.json_bytes("n", "name"))
    assert all(r["returned"] == 0 for r in B.evidence_bound(collections(spark, report, B.json_bytes, True), own, "at", 5).collect())


def test_places_and_totals_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(7)
    got, _ = B.placed(rows, [F.asc("id")])
    assert sorted((r["place"], r["id"]) for r in got.collect()) == [(k, k) for k in range(1000)]
    got, _ = B.running_total(rows, [F.asc("id")], "id")
    assert sorted((r["id"], r["before"]) for r in got.collect()) == [(k, k * (k - 1) // 2) for k in range(1000)]


def plain_fold(costs, left):
    out = []
    for k, c in enumerate(costs):
        if c <= 0:
            out.append(k)
        elif c <= left:
            left -= c
            out.append(k)
    return out


@pytest.mark.parametrize(("seed", "scale", "left"), [(1, 50, 1000), (2, 5000, 4000), (3, 3, 10**9), (4, 1 << 24, 64 << 20)])
def test_skip_greedy_equals_a_fold(spark, seed, scale, left):
    rng = random.Random(seed)
    costs = [rng.choice([rng.randrange(-1, 3), rng.randrange(scale), int(scale ** rng.random())]) for _ in range(700)]
    rows = spark.createDataFrame(list(enumerate(costs)), "k int, c long").repartition(5)
    got = sorted(r["k"] for r in budget.skip_greedy(rows, [F.asc("k")], F.col("c"), left).collect())
    assert got == plain_fold(costs, left)


def test_rounds_are_bounded_by_the_bits_of_the_budget(spark):
    # Small rows with large ones between them that just don't fit: a round a pair, if rounds ended at each misfit.
    costs, left = [], 1 << 12
    for _ in range(300):
        costs += [10, max(1, left - 5)]
        left -= 10
        if left < 20:
            break
    ranked = spark.createDataFrame(list(enumerate(costs)), "k long, c long").coalesce(1).withColumn("__place", F.monotonically_increasing_id())
    assert len(budget.fitting_rounds(ranked, "c", 1 << 12)) <= 13


def plain_sections(report, tokens):
    kept = {n: [] for n in report}
    for n, items in report.items():
        for x in items:
            kept[n].append(x)
            if -(-len(text_of(kept)) // 4) > tokens:
                kept[n].pop()
    return {n: [x["at"] for x in items] for n, items in kept.items()}


@pytest.mark.parametrize("tokens", [5, 60, 200, 700])
def test_sections_share_a_budget_as_in_a_loop(spark, tokens):
    rng = random.Random(tokens)
    report = {n: [{"at": k, "x": "y" * int(120 ** rng.random())} for k in range(rng.randrange(30))] for n in ("risks", "files", "edges", "none", "next")}
    report["none"] = []
    kept, said = B.fill_sections([B.Collection(n, spark.createDataFrame([(x["at"], x["x"]) for x in items], "at int, x string"), [F.asc("at")], B.json_chars("at", "x")) for n, items in report.items()], tokens)
    want = plain_sections(report, tokens)
    assert {n: sorted(r["at"] for r in df.collect()) for n, df in kept.items()} == want
    assert {r["name"]: (r["total"], r["returned"]) for r in said.collect()} == {n: (len(report[n]), len(want[n])) for n in report}
