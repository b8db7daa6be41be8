"""Facts about branch points, plans, joins and ledgers, worked out by hand."""

import datetime
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from varigrid import functions as fn
from varigrid import plans, sources, streaming
from varigrid.operators import ledger, lineage, pipeline, summary, sweep, variants
from varigrid.operators.pipeline import Step, derive
from varigrid.plans import BranchPoint

SIZE, N = BranchPoint("WhichSize", {"smaller": 5, "bigger": 100}), BranchPoint("N", {"one": 1, "two": 2})
M = plans.sequence("M", 1, 10)


def test_sequences():
    assert list(M.branches) == [str(i) for i in range(1, 11)] and M.baseline == "1"
    assert list(plans.sequence("S", 1, 6, 2).branches) == ["1", "3", "5"]
    assert list(plans.sequence("S", "1", "5.0", "0.5").branches) == ["1", "1.5", "2", "2.5", "3", "3.5", "4", "4.5", "5"]
    assert list(plans.sequence("S", 10, 30, 10).branches) == ["10", "20", "30"]
    for bad in (("1", "5", "0"), ("1", "1e9", "1")):
        with pytest.raises(ValueError):
            plans.sequence("S", *bad)


def test_one_off_is_the_filtered_product(spark):
    points = [SIZE, N, M]
    full = plans.grid(spark, points, plans.cross(points))
    direct = plans.grid(spark, points, plans.one_off(points))
    assert direct.count() == 12
    assert sorted(map(str, full.where(plans.is_one_off(points)).collect())) == sorted(map(str, direct.collect()))
    assert len(plans.one_off([SIZE, N])) == 3


def test_plan_tutorial(spark):
    points = [SIZE, N, M]
    g = plans.grid(spark, points, plans.cross(points))
    clauses = [{"WhichSize": "*", "M": "*"}, {"WhichSize": "*", "N": ["two"]}, {"WhichSize": "*", "N": ["two"], "M": ["10"]}]
    assert [g.where(plans.in_clause(points, c)).count() for c in clauses] == [20, 2, 2]
    assert plans.plan_union(g, points, {"P": clauses}, ["P"]).count() == 24
    with pytest.raises(KeyError):
        plans.plan_union(g, points, {"P": clauses}, ["Q"])
    assert g.where(plans.in_clause([N], {}, {"N": ["two"]})).count() == 40
    assert plans.explain_plan(g, points, {"P": clauses}).where("accepted").count() == 24


def test_globs():
    assert fn.glob_to_regex("a*.{x,y}?") == r"^(?:a.*\.(x|y).)$"
    assert fn.glob_to_regex("a,b}") == r"^(?:a,b\})$"


def test_graft_and_two_grafts_of_one_parent(spark):
    vf = variants.branch(variants.variants(spark.range(1)), BranchPoint("D", {"a": 1, "b": 2}), into="v")
    assert vf.df.count() == 2
    both = variants.vjoin(variants.VariantFrame(variants.graft(vf, D="a").df.withColumnRenamed("v", "x").drop("id"), {}), variants.VariantFrame(variants.graft(vf, D="b").df.withColumnRenamed("v", "y").drop("id"), {}))
    assert both.df.collect() == [Row(x=1, y=2)]
    again = variants.branch(variants.graft(vf, D="a"), BranchPoint("D", {"a": 1, "b": 2}))
    assert again.df.count() == 2
    with pytest.raises(ValueError):
        variants.branch(vf, BranchPoint("D", {"a": 1}))
    with pytest.raises(KeyError):
        variants.graft(vf, D="c")


def test_nested_points_and_joins_agree_with_the_theta_form(spark):
    inner = {"train": lambda v: variants.branch(v, BranchPoint("Corpus", {"s": 1, "m": 2})), "test": lambda v: variants.branch(v, BranchPoint("Split", {"x": 1, "y": 2, "z": 3}))}
    left = variants.branch_nested(variants.variants(spark.createDataFrame([(1,), (2,)], "k int")), BranchPoint("Data", {"train": 0, "test": 1}), inner)
    assert left.df.count() == 10
    right = variants.branch_nested(variants.variants(spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "k int, w string")), BranchPoint("Data", {"train": 0, "test": 1}), {"train": lambda v: variants.branch(v, BranchPoint("Corpus", {"s": 1, "m": 2}))})
    for on in (["k"], []):
        r = right if on else variants.VariantFrame(right.df.drop("k"), right.points, right.masks)
        a, b = variants.vjoin(left, r, on).df, variants.vjoin_theta(left, r, on).df
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
        assert "NestedLoop" not in variants.vjoin(left, right, ["k"]).df._jdf.queryExecution().executedPlan().toString()


def test_sweep_forms_agree(spark):
    facts = spark.range(200).select((F.col("id") % 17).alias("a"), (F.col("id") % 23).cast("double").alias("b"), F.col("id").alias("x"))
    points = [BranchPoint("A", {"1": 1, "5": 5, "9": 9}), BranchPoint("B", {"0": 0, "12": 12})]
    rows, sums = plans.cross(points), {"n": F.lit(1).cast("long"), "s": F.col("x")}
    c = sweep.sweep(facts, points, rows, lambda: (F.col("a") >= F.col("val_A")) & (F.col("b") >= F.col("val_B")), [F.sum(v).alias(k) for k, v in sums.items()])
    a = sweep.sweep_conditional(facts, points, rows, lambda r: (F.col("a") >= r["A"]) & (F.col("b") >= r["B"]), sums)
    b = sweep.sweep_thresholds(facts, points, rows, {"A": "a", "B": "b"}, sums)
    sets = [sorted(map(tuple, x.select("bp_A", "bp_B", "n", "s").collect())) for x in (a, b, c)]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 6


def test_gather_counts_and_order(spark):
    points = [BranchPoint(p, {f"{p}{i}": i for i in range(3)}) for p in "ABC"]
    vf = variants.variants(spark.range(1))
    for p in points:
        vf = variants.branch(vf, p, into=p.name.lower())
    assert [summary.gather(vf, g, "a").count() for g in ([], ["A"], ["A", "B"], ["A", "B", "C"])] == [27, 9, 3, 1]
    assert summary.gather(vf, ["A"], "a", " ").select("a").distinct().collect() == [Row(a="0 1 2")]
    wide = variants.branch(variants.variants(spark.range(1)), plans.sequence("S", 1, 900))
    assert summary.gather(wide, ["S"], "bp_S", " ").first()[0].split() == [str(i) for i in range(1, 901)]


def test_names(spark):
    row = lambda *v: spark.createDataFrame([v], "bp_B string, bp_A string").select(fn.realization({"B": F.col("bp_B"), "A": F.col("bp_A")}, {"A": "a", "B": "b"}).alias("n"), fn.realization_full({"B": F.col("bp_B"), "A": F.col("bp_A")}).alias("f")).first()
    assert tuple(row("x", "y")) == ("A.y+B.x", "A.y+B.x") and tuple(row("b", "a")) == (fn.BASELINE, "A.a+B.b") and tuple(row(None, "a")) == (fn.BASELINE, "A.a")
    assert len(row("x" * 300, "a")[0]) == 32


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    s = F.lit
    assert one(fn.split_first(s("a/b/c"), "/")) == ["a", "b/c"] and one(fn.split_last(s("a/b/c"), "/")) == ["a/b", "c"] and one(fn.split_last(s("a"), "/")) == ["a", None]
    assert one(fn.split_on(s("a.b"), ".")) == ["a", "b"] and one(fn.human_size(s(1536))) == "1.5 KB" and one(fn.basename(s("/x/y.tar.gz"), ".tar.gz")) == "y"
    assert one(fn.parse_bool(s("Enable"))) is True and one(fn.parse_bool(s("f"))) is False and one(fn.parse_bool(s(None).cast("string"))) is None
    with pytest.raises(Exception, match="not a boolean"):
        one(fn.parse_bool(s("maybe")))
    assert one(fn.namespace(s("a/b/c"))) == ["a/b", "c"] and one(fn.exit_ok(s("0\nx"))) is True and one(fn.exit_ok(s(None).cast("string"))) is False
    assert one(fn.parse_number(s("1.5e2"))) == 150 and one(fn.parse_number(s(".5"))) is None
    m = lambda **k: F.create_map(*(s(x) for kv in k.items() for x in kv))
    assert one(fn.merge_branches(m(A="a", B="b"), m(B="c"))) == {"A": "a", "B": "c"} and one(fn.drop_branches(m(A="a", B="b"), ["A"])) == {"B": "b"}
    assert one(fn.has_branch(m(A="a"), "A")) and one(fn.all_branches(m(A="a"), lambda k, v: v == "a")) and one(fn.count_where(F.array(s(1), s(5)), lambda x: x > 2)) == 1


def test_lineage(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    nodes = lambda df: sorted(r.node for r in df.collect())
    start = lambda x: spark.createDataFrame([(x,)], "node string")
    assert nodes(lineage.required_for(e, start("d"))) == list("abcd") and nodes(lineage.dependents(e, start("c"))) == list("cde")
    assert {(r.node, r.level) for r in lineage.levels(e).collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 4)}
    assert nodes(lineage.check_acyclic(e)) == [] and nodes(lineage.check_acyclic(e.union(spark.createDataFrame([("e", "c")], e.schema)))) == list("cde")
    order = lambda mode: [r.node for r in lineage.order_nodes(lineage.levels(e), mode).collect()]
    assert order("breadth") == list("abcde") and order("depth") == list("edbca") and sorted(order("arbitrary")) == list("abcde")
    for cycle in ([("x", "y"), ("y", "x")], [("a", "b"), ("b", "c"), ("c", "b")]):
        with pytest.raises(ValueError, match="cycle"):
            lineage.levels(spark.createDataFrame(cycle, e.schema))
    led = spark.createDataFrame([("a", 1), ("b", 2)], "node string, version int")
    assert sorted(map(tuple, lineage.invalidated(led, start("b")).collect())) == [("a", 1, False), ("b", 2, False), ("b", 2, True)]
    assert sorted(map(tuple, lineage.collapse(e, spark.createDataFrame([("b",), ("d",)], "node string")).collect())) == [("a", "c"), ("a", "e"), ("c", "e")]


def test_ledger_states_and_reuse(spark):
    cols = "task string, realization string, version int, has_dir boolean, has_version_file boolean, exit_code string, has_stdout boolean, has_stderr boolean, invalidated boolean, outputs_exist boolean, locked boolean"
    full = (True, True, "0", True, True, False, True, False)
    rows = [("ok", "r", 1, *full), ("inv", "r", 1, True, True, "0", True, True, True, True, False), ("lock", "r", 1, True, True, None, True, True, False, True, True), ("broken", "r", 1, True, False, None, True, True, False, True, False)]
    led = spark.createDataFrame(rows, cols)
    planned = led.select("task", "realization").union(spark.createDataFrame([("new", "r")], "task string, realization string"))
    got = {r.task: r.state for r in ledger.classify(planned, led).collect()}
    assert got == {"ok": "complete", "inv": "partial", "lock": "locked", "broken": "broken", "new": "fresh"}
    assert ledger.todo(planned, planned).count() == 0 and ledger.next_version(led).first()[0] == 2
    assert {r.task: r.version for r in ledger.assign_versions(ledger.classify(planned, led), 7).collect()}["ok"] == 1


def test_manifest_and_variant_tables(spark, tmp_path):
    rows = [(3, "package", "tool", None, None, "v1", None), (3, "existing", "t", "Baseline.baseline", 2, None, None), (3, "todo", "u", "N.two", 3, None, ["tool", "x"])]
    df = spark.createDataFrame(rows, sources.MANIFEST)
    sources.write_manifest(df, f"{tmp_path}/m")
    (tmp_path / "m" / "part-comment.txt").write_text("# a comment\n")
    assert sorted(map(str, sources.read_manifest(spark, f"{tmp_path}/m", 3).collect())) == sorted(map(str, df.collect()))
    sources.write_variants(spark.createDataFrame([("N.two", 1)], "realization string, x int"), f"{tmp_path}/v", "t", 1)
    assert spark.read.parquet(f"{tmp_path}/v").where("task = 't' AND version = 1").count() == 1


def test_derive_runs_steps_on_shared_branches(spark):
    src = variants.branch(variants.variants(spark.createDataFrame([(1,), (2,)], "k int")), SIZE, into="s")
    pre = Step("pre", lambda v, p: v, {"src": {}}, points=[N])
    use = Step("use", lambda v, p: v, {"pre": {"N": "two"}, "src": {}}, on=["k"])
    with pytest.raises(KeyError):
        derive([use], {"src": src})
    src2 = variants.VariantFrame(src.df.drop("s"), src.points, src.masks)
    out = derive([pre, use], {"src": src2})
    assert out["pre"].df.count() == 8 and out["use"].df.count() == 4 and set(out["use"].points) == {"WhichSize"}


def test_ready_stream_agrees_with_batch(spark, tmp_path):
    edges = spark.createDataFrame([("p1", "c1"), ("p2", "c1"), ("p2", "c2"), ("p3", "c3")], "parent string, child string")
    events = spark.createDataFrame([(1, 1, "p1", "completed"), (2, 2, "p2", "failed"), (3, 3, "p2", "completed"), (4, 4, "p3", "failed")], "ts long, event_id long, parent string, status string")
    last = events.groupBy("parent").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    assert sorted(r.child for r in streaming.ready_batch(last, edges).collect()) == ["c1", "c2"]


def test_globs_with_ranges(spark):
    names = spark.createDataFrame([(x,) for x in ("xb1", "x-1", "xd", "a!", "ax", "ay", "1.5", "105", "a@b", "a%", "c^")], "n string")
    got = lambda glob: {r.n for r in names.where(fn.match_name(F.col("n"), glob)).collect()}
    assert got("x[a-c]*") == {"xb1"} and got("a[!x]") == {"a!", "ax"} and got("1.*") == {"1.5"}
    assert got("a@b") == {"a@b"} and got("*%") == {"a%"} and got("c^") == {"c^"} and got("x-1") == {"x-1"}


def counted(spark, runs):
    """Steps out of order: report compares each size with the pinned smaller one; aside is needed by no goal."""
    rows = spark.createDataFrame([(i, "smaller" if i % 3 else "bigger") for i in range(30)], "n long, bp_WhichSize string")
    source = variants.VariantFrame(rows, {"WhichSize": SIZE}, frozenset([frozenset(["WhichSize"])]))

    def count(v, params):
        runs.append("count")
        return variants.VariantFrame(v.df.groupBy(*v.columns).agg(F.count(F.lit(1)).alias("c")), v.points, v.masks)

    def aside(v, params):
        raise AssertionError("aside is not needed")

    report = Step("report", lambda v, params: v, {"count": {}, "base": ("count", {"WhichSize": "smaller"})})
    return [report, Step("aside", aside, {"count": {}}), Step("count", count, {"rows": {}}, points=[N])], {"rows": source}


def test_planned_realizations_with_a_graft(spark):
    steps, frames = counted(spark, [])
    only = [plans.Plan("big", ["report"], {"WhichSize": ["bigger"], "N": "*"})]
    need = {s: sorted(r.realization for r in df.collect()) for s, df in pipeline.planned(steps, frames, only).items()}
    # The smaller size is pinned, so count has it though no plan names it, and report, a goal, has not.
    assert need == {"report": ["N.two+WhichSize.bigger", "WhichSize.bigger"], "count": ["Baseline.baseline", "N.two", "N.two+WhichSize.bigger", "WhichSize.bigger"], "rows": ["Baseline.baseline", "WhichSize.bigger"]}


def test_steps_run_on_planned_realizations_alone(spark):
    runs = []
    steps, frames = counted(spark, runs)
    both = [plans.Plan("big", ["report"], {"WhichSize": ["bigger"]}), plans.Plan("two", ["count"], {"N": ["two"]})]
    out = pipeline.derive_planned(steps, frames, both)
    assert runs == ["count"] and "aside" not in out
    assert sorted(tuple(r) for r in out["count"].df.select("bp_WhichSize", "bp_N", "c").collect()) == [("bigger", "one", 10), ("smaller", "one", 20), ("smaller", "two", 20)]
    assert [tuple(r) for r in out["report"].df.select("bp_WhichSize", "bp_N", "c", "base_c").collect()] == [("bigger", "one", 10, 20)]


def test_without_plans_one_branch_differs(spark):
    steps, frames = counted(spark, [])
    need = {s: {r.realization for r in df.collect()} for s, df in pipeline.planned(steps, frames).items()}
    assert need["count"] == {"Baseline.baseline", "N.two", "WhichSize.bigger"} == need["report"]


def test_two_grafts_of_one_parent(spark):
    df = spark.createDataFrame([("one", "1"), ("two", "2")], "bp_N string, out string")
    t1 = variants.VariantFrame(df, {"N": N}, frozenset([frozenset(["N"])]))
    t2 = Step("t2", lambda v, params: v, {"in1": ("t1", {"N": "one"}), "in2": ("t1", {"N": "two"})})
    for out in (derive([t2], {"t1": t1}), pipeline.derive_planned([t2], {"t1": t1}, [plans.Plan("all", ["t2"], {})])):
        assert [tuple(r) for r in out["t2"].df.select("in1_out", "in2_out").collect()] == [("1", "2")]


def test_plans_that_cannot_be(spark):
    steps, frames = counted(spark, [])
    with pytest.raises(ValueError, match="needs no realization"):
        pipeline.planned(steps, frames, [plans.Plan("none", ["report"], {"WhichSize": ["huge"]})])
    with pytest.raises(KeyError, match="no step"):
        pipeline.planned(steps, frames, [plans.Plan("x", ["nothing"], {})])
    with pytest.raises(ValueError, match="need each other"):
        pipeline.order_steps([Step("a", None, {"b": {}}), Step("b", None, {"a": {}})])
    with pytest.raises(KeyError, match="gone"):
        pipeline.order_steps([Step("a", None, {"gone": {}})])


def graph(spark, seed):
    """Long paths, some inside others, a ladder, a loop of inner nodes beside them, and repeated edges."""
    r = random.Random(seed)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [(f"b{i}", f"b{i + 1}") for i in range(25)] + [("a7", "b3"), ("b20", "a33"), ("x", "a0"), ("x", "b0")]
    edges += [(f"r{i}", f"r{i + 1}") for i in range(8)] + [(f"r{i}", f"r{i + 2}") for i in range(7)] + [("a40", "r0"), ("a1", "a2")]
    names = [f"n{i}" for i in range(30)]
    edges += [tuple(sorted(r.sample(names, 2), key=lambda n: int(n[1:]))) for _ in range(35)]
    return edges


def reachable(edges, start):
    out, todo = set(start), list(start)
    while todo:
        here = todo.pop()
        for a, b in edges:
            if a == here and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize(("seed", "rounds"), [(1, 1)])
def test_closures_by_contracted_paths(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(lineage, "PLAIN_ROUNDS", rounds)
    edges = graph(spark, seed)
    loop = [("l0", "l1"), ("l1", "l2"), ("l2", "l0")]
    df = spark.createDataFrame(edges + loop, "parent string, child string")
    node = lambda *x: spark.createDataFrame([(n,) for n in x], "node string")
    for start in (["a5", "n3"], ["x", "l1"], ["nowhere"]):
        assert {r.node for r in lineage.dependents(df, node(*start)).collect()} == reachable(edges + loop, start)
    back = [(b, a) for a, b in edges + loop]
    pins = spark.createDataFrame([("a39", "p"), ("r8", "p"), ("b22", "q")], "node string, branch string")
    want = {(n, "p") for n in reachable(back, ["a39", "r8"])} | {(n, "q") for n in reachable(back, ["b22"])}
    assert {tuple(r) for r in lineage.relaxations(df, pins).collect()} == want
    virtual = {n for e in edges for n in e if n[0] in "ab" and n not in ("a0", "a20", "b24", "a40")}
    passing = [(a, b) for a, b in edges if a in virtual]
    ends = {(a, n) for a, b in edges if a not in virtual for n in reachable(passing, [b]) if n not in virtual}
    assert {tuple(r) for r in lineage.collapse(spark.createDataFrame(edges, "parent string, child string"), node(*virtual)).collect()} == ends


@pytest.mark.parametrize("rounds", [1])
def test_levels_by_contracted_paths(spark, monkeypatch, rounds):
    monkeypatch.setattr(lineage, "PLAIN_ROUNDS", rounds)
    edges, level = graph(spark, 3), {}
    nodes = {n for e in edges for n in e}
    for _ in nodes:
        level = {n: 1 + max((level.get(a, 0) for a, b in edges if b == n), default=0) for n in nodes}
    assert {r.node: r.level for r in lineage.levels(spark.createDataFrame(edges, "parent string, child string")).collect()} == level
    with pytest.raises(ValueError, match="cycle"):
        lineage.levels(spark.createDataFrame([*edges, ("l0", "l1"), ("l1", "l0")], "parent string, child string"))


def test_a_deep_chain_takes_few_rounds_and_leaves_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("varigrid.sources.shared_dir", lambda _: f"file://{tmp_path}")
    edges = spark.range(2000).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    written = []
    monkeypatch.setattr(lineage, "stored", lambda df: written.append(1) or sources.stored(df))
    got = lineage.required_for(edges, spark.createDataFrame([(2000,)], "node long"))
    assert got.count() == 2001 and len(written) <= 24 and len(list(tmp_path.iterdir())) == 1
    assert lineage.levels(edges).agg(F.sum("level")).first()[0] == 2001 * 2002 // 2


def below(folder):
    return sorted(str(f.relative_to(folder)) for f in folder.rglob("*.parquet"))


def test_archive_touches_only_files_with_such_rows(spark, tmp_path):
    path, attic = tmp_path / "store", tmp_path / "attic"
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("realization"), F.col("id").alias("v"))
    sources.write_variants(df.repartition(2), str(path), "a b", 1)
    before = below(path)
    schema = spark.read.parquet(str(path)).schema
    read = lambda p: spark.read.schema(schema).parquet(str(p))
    kept = sources.archive(read(path), spark.createDataFrame([("0",)], "realization string"), f"file://{path}", f"file://{attic}")
    assert kept.count() == 60 and below(path) == [f for f in before if "realization=0" not in f] and below(attic) == [f for f in before if "realization=0" in f]
    # A key of the rows: one realization keeps some.
    victims = spark.createDataFrame([(1,), (4,), (7,)], "v long")
    kept = sources.archive(read(path), victims, str(path), str(attic))
    assert kept.count() == 57 and read(attic).count() == 33 and {r.v for r in read(attic).where("realization = '1'").collect()} == {1, 4, 7}
    assert [f for f in below(path) if "realization=2" in f] == [f for f in before if "realization=2" in f]
    again = below(path), below(attic)
    assert sources.archive(read(path), victims, str(path), str(attic)).count() == 57 and (below(path), below(attic)) == again
    gone = sources.purge_store(read(path), read(path).where("realization = '2' OR v = 10").select("v"), str(path))
    assert gone.count() == 26 and not [f for f in below(path) if "realization=2" in f] and not list(path.glob("_change*"))


@pytest.mark.parametrize("steps", [0, 3])
def test_a_stopped_archive_is_finished_by_the_next(spark, tmp_path, monkeypatch, steps):
    path, attic, done = tmp_path / "store", tmp_path / "attic", []
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("realization"), F.col("id").alias("v"))
    sources.write_variants(df.coalesce(1), str(path), "count", 1)
    schema, at = spark.read.parquet(str(path)).schema, sources._at
    read = lambda p: spark.read.schema(schema).parquet(str(p))

    def stop(spark, uri):
        if "_change-" in uri or "realization=1" in uri:
            done.append(uri)
        if len(done) > 2 + steps:
            raise OSError("stopped")
        return at(spark, uri)

    monkeypatch.setattr(sources, "_at", stop)
    victims = spark.createDataFrame([(i,) for i in (1, 4, 0, 3)], "v long")
    with pytest.raises(OSError, match="stopped"):
        sources.archive(read(path), victims, str(path), str(attic))
    monkeypatch.setattr(sources, "_at", at)
    assert sources.archive(read(path), victims, str(path), str(attic)).count() == 56
    assert sorted(r.v for r in read(attic).collect()) == [0, 1, 3, 4] and sorted(r.v for r in read(path).collect()) == sorted(set(range(60)) - {0, 1, 3, 4})


def test_new_combinations_of_three_parents(spark):
    def frames(rows):
        made = [spark.createDataFrame([r[1:] for r in rows if r[0] == k] or [], f"u long, bp_N string, {c} long") for k, c in enumerate("abc")]
        return [variants.VariantFrame(made[k] if k < 2 else made[k].drop("bp_N"), {"N": N} if k < 2 else {}, frozenset([frozenset(["N"] if k < 2 else [])])) for k in range(3)]

    r = random.Random(4)
    rows = [(i % 3, r.randrange(3), r.choice(["one", "two"]), i) for i in range(40)]
    keys = ["u", "bp_N", "a", "b", "c"]
    whole = Counter(tuple(x) for x in variants.vjoin_new(frames([]), frames(rows), ["u"]).df.select(*keys).collect())
    by_hand = Counter((x[1], x[2], x[3], y[3], z[3]) for x in rows for y in rows for z in rows if (x[0], y[0], z[0]) == (0, 1, 2) and x[1] == y[1] == z[1] and x[2] == y[2])
    cut = [rows[:10], rows[10:11], rows[11:30], rows[30:]]
    in_parts = sum((Counter(tuple(x) for x in variants.vjoin_new(frames(sum(cut[:i], [])), frames(cut[i]), ["u"]).df.select(*keys).collect()) for i in range(4)), Counter())
    assert whole == by_hand == in_parts and whole


def test_arrivals_in_batches_run_twice(spark, tmp_path):
    take = lambda kind, out: lambda df: variants.variants(df.where(F.col("kind") == kind).select("u", F.col("id").alias(out)))
    arrivals = streaming.Arrivals(f"file://{tmp_path}/x", {k: take(k, k) for k in "abc"}, ["u"])
    rows = [("abc"[i % 3], i % 2, i) for i in range(18)]
    for batch, part in enumerate((rows[:5], rows[5:6], rows[6:])):
        df = spark.createDataFrame(part, "kind string, u long, id long")
        arrivals.add(df, batch)
        if batch < 2:
            arrivals.add(df, batch)
    got = Counter(tuple(r) for r in arrivals.derived(spark).select("u", "a", "b", "c").collect())
    assert got == Counter((x[1], x[2], y[2], z[2]) for x in rows for y in rows for z in rows if x[0] + y[0] + z[0] == "abc" and x[1] == y[1] == z[1])


def test_sweeps_by_cells_agree_with_the_general_form(spark):
    r = random.Random(5)
    facts = spark.createDataFrame([(r.choice([None, *range(12)]), r.random(), r.choice("pqrs"), r.randrange(100_000), r.randrange(9)) for _ in range(400)], "a long, b double, c string, k long, v long")
    points = [BranchPoint("A", {"a0": 0, "a5": 5, "also5": 5, "a9": 9, "a99": 99}), BranchPoint("C", {"p": {"p"}, "pq": ["p", "q"], "none": ["z"]}), BranchPoint("B", {f"b{i}": i / 10 for i in range(10)})]
    on = {"A": "a", "B": "b", "C": "c"}
    for rows in (plans.cross(points), plans.one_off(points), [{"A": "a9", "C": "pq", "B": "b3"}, {"A": "also5", "C": "p", "B": "b0"}]):
        got = sweep.sweep_cells(facts, points, rows, on, {"s": F.col("v"), "n": F.lit(1).cast("long")}, {"low": F.col("v")}, {"high": F.col("b")}, {"kinds": F.col("k")})
        flat = [BranchPoint(p.name, {b: v if p.name != "C" else ",".join(v) for b, v in p.branches.items()}) for p in points]
        holds = lambda: (F.col("a") >= F.col("val_A")) & (F.col("b") >= F.col("val_B")) & F.array_contains(F.split("val_C", ","), F.col("c"))
        want = sweep.sweep(facts, flat, rows, holds, [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("b").alias("high"), F.count_distinct("k").alias("kinds")])
        columns = ["bp_A", "bp_B", "bp_C", "s", "n", "low", "high", "kinds"]
        assert sorted(tuple(x) for x in got.select(*columns).collect()) == sorted(tuple(x) for x in want.select(*columns).collect())


@pytest.mark.parametrize("seed", [1])
def test_cycles_are_named(spark, seed):
    """Two cycles joined at a node, a loop with a long handle, self edges, nodes between cycles, and random edges."""
    r = random.Random(seed)
    edges = [(i, (i + 1) % 9) for i in range(9)] + [(4, 20), *((i, i + 1) for i in range(20, 24)), (24, 4)]
    edges += [(30, 31), (31, 30), (31, 32), (32, 33), (33, 40), *((40 + i, 40 + (i + 1) % 6) for i in range(6)), (50, 50), (51, 51), (50, 51), (8, 30), *((60 + i, 60 + (i + 1) % 5) for i in range(5))]
    edges += [(r.randrange(70, 95), r.randrange(70, 95)) for _ in range(30)]
    nodes = {n for e in edges for n in e}
    down = {n: reachable(edges, [n]) for n in nodes}
    mine = {n: {m for m in nodes if m in down[n] and n in down[m]} for n in nodes}
    want = {(n, min(mine[n])) for n in nodes if len(mine[n]) > 1 or (n, n) in edges}
    got = lineage.cycles(spark.createDataFrame(edges, "parent long, child long")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert lineage.cycles(spark.createDataFrame([(1, 2), (2, 3)], "parent long, child long")).count() == 0


def test_ranks_over_many_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice(["b", "a", "é", "Z", None]), r.choice(["10", "9", "x", None]), i) for i in range(300)]
    got = summary.ranked(spark.createDataFrame(rows, "t string, n string, i long").repartition(7), [("t", "text", True), ("i", "number", False)]).collect()
    order = sorted(rows, key=lambda x: x[2])
    order = sorted(order, key=lambda x: (x[0] is not None, (x[0] or "").encode()), reverse=True)
    assert [tuple(x)[:3] for x in sorted(got, key=lambda x: x.rank)] == sorted(order, key=lambda x: ((x[0] is None), tuple(-b for b in (x[0] or "").encode()), x[2]))
    assert sorted(x.rank for x in got) == list(range(1, 301))
    assert summary.ranked(spark.createDataFrame([], "t string, n string, i long"), [("t", "text", False)]).count() == 0


def test_comment_lines_and_header_are_kept_apart(spark):
    lines = ["# first", "name score", "b 2", "#second", "a 10", "b 10", "a x", "c", "B 1"]
    df = spark.createDataFrame(list(enumerate(lines)), "at long, line string")
    got = sorted((r.part, r.place, r.line) for r in summary.tabular_lines(df, [(1, "text", False), (2, "number", True)]).collect())
    assert got == [("comment", 1, "# first"), ("comment", 2, "#second"), ("header", 1, "name score"), ("row", 1, "B 1"), ("row", 2, "a 10"), ("row", 3, "a x"), ("row", 4, "b 10"), ("row", 5, "b 2"), ("row", 6, "c")]


def test_only_files_with_new_size_or_time_are_read(spark, tmp_path, monkeypatch):
    for name, text in {"same": "1", "touched": "2", "edited": "3", "gone": "4"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    pattern, read = f"file://{tmp_path}/*.txt", []
    snapshot = sources.stored(ledger.file_digests(spark, pattern))
    (tmp_path / "gone.txt").unlink()
    (tmp_path / "edited.txt").write_text("33")
    (tmp_path / "new one.txt").write_text("5")
    os.utime(tmp_path / "touched.txt", (1, 1))
    whole = ledger.file_digests
    monkeypatch.setattr(ledger, "file_digests", lambda s, *paths, **k: read.extend(paths) or whole(s, *paths, **k))
    got = {os.path.basename(r.path): (r.change, r.digest) for r in ledger.changed_on_disk(spark, snapshot, pattern).collect()}
    md5 = lambda x: hashlib.md5(x).hexdigest()
    assert got == {"edited.txt": ("changed", md5(b"33")), "new one.txt": ("new", md5(b"5")), "gone.txt": ("gone", md5(b"4"))}
    assert sorted(os.path.basename(p) for p in read) == ["edited.txt", "new one.txt", "touched.txt"]
    assert "content" not in ledger.listed_files(spark, pattern)._jdf.queryExecution().executedPlan().toString()


def test_a_result_with_very_many_inputs_in_buckets(spark, tmp_path):
    result = [F.lit("t").alias("task"), F.lit("r").alias("realization")]
    inputs = spark.range(1_000_000).select(*result, F.col("id").alias("input_name"))
    one = spark.range(1).select(*result)
    sources.ledger_save("many_inputs", f"file://{tmp_path}", 4, tasks=one, inputs=inputs, outputs=one.withColumn("output_name", F.lit("o")), params=one.limit(0).withColumn("p", F.lit("x")))
    tables = {k: sources.ledger_table(spark, "many_inputs", k) for k in ("tasks", "inputs", "outputs", "params")}
    lines = sources.status_lines(**tables)
    assert lines.agg(F.count(F.lit(1)), F.max("place"), F.count_distinct("line")).first()[:] == (1_000_001, 1_000_000, 1_000_001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables["inputs"].join(tables["tasks"].select(*sources.KEY), sources.KEY, "left_semi")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def files_in_turn(spark, tmp_path, batches, schema):
    """A stream of one file for each batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")


def test_last_status_with_late_events_and_state_that_goes(spark, tmp_path, rocks):
    at = lambda day, *x: (datetime.datetime(2024, 1, day), *x)
    batches = [[at(5, 1, "t", "r", "begin"), at(6, 2, "t", "r", "succeed"), at(5, 3, "u", "r", "fail")], [at(5, 4, "t", "r", "fail"), at(7, 5, "u", "r", "begin"), at(20, 6, "v", "r", "begin")], [at(19, 8, "t", "r", "fail")], [at(7, 7, "u", "r", "succeed"), at(20, 9, "v", "r", "other"), at(21, 10, "v", "r", "skip")]]
    stream = files_in_turn(spark, tmp_path, batches, "ts timestamp, event_id long, task string, realization string, event string")
    seen = []
    out = streaming.live_status_changes(stream, "2 days", 3 * 86400)
    out.writeStream.foreachBatch(lambda df, i: seen.extend((r.task, r.event_id, r.status) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    # Event 4 is older than what its result has; event 7 is too late two batches after the 20th; event 9 is no change of status.
    assert sorted(seen, key=lambda x: x[1]) == [("t", 2, "completed"), ("u", 3, "failed"), ("u", 5, "running"), ("v", 6, "running"), ("t", 8, "failed"), ("v", 10, "completed")]
    with pytest.raises(ValueError, match="as long as"):
        streaming.live_status_changes(stream, "2 days", 60)


def test_ready_goes_on_from_its_checkpoint(spark, tmp_path, rocks):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "parent string, child string")
    schema, at = "ts long, event_id long, parent string, status string", f"{tmp_path}/checkpoint"
    sent = []
    for batch, want in (([(1, 1, "a", "completed"), (1, 2, "c", "failed")], []), ([(2, 3, "b", "completed")], ["x", "y"]), ([(3, 4, "b", "completed"), (3, 5, "c", "completed")], ["x", "y", "z"])):
        stream = files_in_turn(spark, tmp_path, [batch], schema)
        streaming.ready(stream, edges).writeStream.foreachBatch(lambda df, i: sent.extend(r.child for r in df.collect())).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert sorted(sent) == want
