"""Work that grew faster than the input, or met in one task."""

import pytest

from varigrid.operators import checks, ledger, lineage
from varigrid.queries import entity_edges, t

DATA = "/root/testdata/sf0.001"


def test_leaves_are_in_no_round_of_levels(spark, monkeypatch):
    edges = [("r", "a"), ("r", "b"), ("a", "b"), ("r", "z"), *((p, f"{p}{i}") for p in "ab" for i in range(50)), *(("r", f"a{i}") for i in range(50)), ("r", "z")]
    rounds, peel = [], lineage._peel
    monkeypatch.setattr(lineage, "_peel", lambda e, *x: rounds.append(e.count()) or peel(e, *x))
    got = {r.node: r.level for r in lineage.levels(spark.createDataFrame(edges, "parent string, child string")).collect()}
    assert rounds == [3] and got == {"r": 1, "a": 2, "b": 3, "z": 2, **{f"a{i}": 3 for i in range(50)}, **{f"b{i}": 4 for i in range(50)}}


def test_chains_are_contracted_at_once(spark, monkeypatch):
    edges = [(100 * c + i, 100 * c + i + 1) for c in range(3) for i in range(40)]
    rounds, peel = [], lineage._peel
    monkeypatch.setattr(lineage, "_peel", lambda e, n, *x: rounds.append(n) or peel(e, n, *x))
    got = {tuple(r) for r in lineage.levels(spark.createDataFrame(edges, "parent long, child long")).collect()}
    assert rounds == [None] and got == {(100 * c + i, i + 1) for c in range(3) for i in range(41)}
    with pytest.raises(ValueError, match="cycle"):
        lineage.levels(spark.createDataFrame([*edges, (900, 901), (901, 902), (902, 900), (902, 903)], "parent long, child long"))


def test_collapse_without_virtual_chains_takes_no_rounds(spark, monkeypatch):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = [("a", "v"), ("a", "v"), ("b", "v"), ("v", "x"), ("v", "y"), ("a", "b"), ("w", "x"), ("c", "u")]
    plain = lineage.collapse(frame([*edges, ("v", "u"), ("u", "z"), ("u", "v")], "parent string, child string"), frame([(x,) for x in "vwu"], "node string"))
    assert {tuple(r) for r in plain.collect()} == {("a", "b"), *((p, c) for p in "abc" for c in "xyz")}
    monkeypatch.setattr(lineage, "reach", None)
    got = lineage.collapse(frame(edges, "parent string, child string"), frame([("v",), ("w",), ("u",), ("v",)], "node string"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


@pytest.mark.parametrize("many", [-1, 20])
def test_closures_that_meet_few_candidates(spark, monkeypatch, many):
    monkeypatch.setattr(lineage, "MANY", many)
    edges = [(f"a{i}", "h") for i in range(60)] + [("h", "i"), ("i", "a3"), ("i", "k")]
    got = lineage.dependents(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([(f"a{i}",) for i in range(60)], "node string"))
    assert sorted(r.node for r in got.collect()) == sorted([*(f"a{i}" for i in range(60)), "h", "i", "k"])


def test_entity_edges_are_not_shuffled(spark):
    rows = {n: t(spark, DATA, n).count() for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    assert entity_edges(spark, DATA).count() == sum(rows.values()) + rows["lineitem"]


def test_places_of_a_listing_over_many_ranges(spark):
    rows = [(v, k, f"n{i * 7 % 50}", "r", i) for v in (1, None) for k in ("todo", "existing") for i in range(50)]
    got = ledger.version_rows(spark.createDataFrame(rows, "version int, kind string, name string, realization string, task_version int"))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(v, k, i + 1, e) for v in (1, None) for k in ("todo", "existing") for i, e in enumerate(sorted("/".join(map(str, x[2:])) for x in rows if x[:2] == (v, k)))}
    assert {tuple(r) for r in got.collect()} == want


def test_keys_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(checks, "ROWS", 10)
    fact, dim = (spark.createDataFrame([(x,) for x in rows], "k long") for rows in ([*range(100), 5, None], [*range(50, 150), 60, None]))
    got = checks.check_keys(fact, dim, "k")
    want = {(x, "undeclared", "warn") for x in [*range(50), None]} | {(x, "unused", "warn") for x in [*range(100, 150), None]}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want and got.rdd.getNumPartitions() > 20
