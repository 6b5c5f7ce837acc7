"""Edges by name alone against the general way."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import edges
from tests.test_operators import SYMBOL, sym


@pytest.fixture(scope="module")
def symbols(spark):
    """Forty files of two languages: few names, more definitions of some than a list takes, imports without a line."""
    rng, rows = random.Random(3), []
    for k in range(40):
        path = f"d{k % 3}/f{k:02d}.{'rs' if k % 4 else 'py'}"
        for o in range(30):
            name = rng.choice(["alpha", "beta", "gamma", "delta", "data", f"own{k}", f"rare{k % 7}"])
            what = rng.randrange(5)
            rows.append(sym(path, o, name, "definition", "syntax") if what == 0 else sym(path, o, name, "definition", "import", None, kind="import") if what == 1 else sym(path, o, name, kind="call"))
    made = spark.createDataFrame(rows, SYMBOL)
    return made.withColumn("visibility", F.when(F.col("ord") % 2 == 0, "public").otherwise("private")).withColumn("language", F.when(F.col("path").endswith("rs"), "rust").otherwise("python"))


def plain(symbols):
    return edges.questions(symbols).filter("context is null")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def general(symbols, candidates=5):
    return edges.resolve(symbols, candidates, asked=plain(symbols))


def test_edges_by_name_equal_the_general_ones(symbols):
    assert edges.by_name_alone(symbols)
    found = general(symbols)
    got = rows(edges.resolve_names(symbols, 5).select(*found.columns))
    assert got == rows(found) and {r[5] for r in got} == {0, 3}
    assert not edges.by_name_alone(symbols.withColumn("context", F.lit("use a::b;"))) and not edges.by_name_alone(symbols.withColumn("language", F.lit("go")))


def test_lists_do_not_travel_with_references(symbols):
    """What is shuffled has no column of arrays but the lists themselves, once."""
    plan = edges.resolve_names(symbols, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_ambiguous_groups_by_name(symbols):
    want = edges.ambiguity_findings(edges.describe(edges.answers(plain(symbols), symbols, 5)))
    assert rows(edges.ambiguous_by_name(symbols, 5).select(*want.columns)) == rows(want) != []


def test_update_by_name_equals_a_cold_build(symbols):
    changed = symbols.filter("path like 'd1/%'").select("path").distinct()
    before = symbols.join(changed, "path", "left_anti")
    cold = edges.resolve_names(symbols)
    kept, fresh = edges.update_edges_by_name(edges.resolve_names(before), symbols, changed, before)
    assert rows(kept.unionByName(fresh)) == rows(cold)
    want = edges.update_edges(general(before, 32), symbols, changed, before)[1].filter("ord >= 0").join(plain(symbols).select("source", "symbol").distinct(), ["source", "symbol"], "left_semi")
    asked = symbols.filter("role = 'reference'").select(F.col("path").alias("source"), "ord")
    want = want.join(asked, ["source", "ord"], "left_semi")
    assert rows(fresh.select("source", "ord", "symbol", "target")) == rows(want.select("source", "ord", "symbol", "target"))


def test_counts_by_name(symbols):
    want = edges.reference_counts(general(symbols))
    assert rows(edges.reference_counts_by_name(symbols, 5)) == rows(want)


@pytest.mark.parametrize("cap", [1, 7, 100])
def test_first_edges_by_name(symbols, cap):
    want = edges.first_edges(general(symbols), cap)
    assert rows(edges.first_edges_by_name(symbols, cap, 5).select(*want.columns)) == rows(want)
