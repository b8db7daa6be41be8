"""Lineage over an edge table (parent, child): closures, levels, invalidation, collapsing."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.sources import discard, stored

#: Rounds by single edges before nonbranching paths are contracted.
PLAIN_ROUNDS = 6
#: From so many found rows on, a round's few candidates are met with their own rows among them alone.
MANY = 1_000_000


def parents(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node")).distinct()


def children(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def _straight(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paths`` without the loops."""
    inner, short, loops = paths(edges)
    discard(loops)
    return inner, short


def paths(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nonbranching paths of edges (src, dst), found by pointer doubling.

    Returns inner (node, path, place): nodes with one edge in and one out, by the path they are on, named after its first inner node, and their place on it, from 1;
    and short (src, dst, path, length): the edges between all other nodes, a path being one edge of its length, with its name. A cycle of
    inner nodes alone has no first one, so its nodes count as others; loops (node, loop) has them, with the smallest node of their cycle. Each round doubles what a pointer spans twice, so a path of n nodes takes about log4(n).
    """
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    once = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    middle = stored(once("src").join(once("dst"), "node"))
    back = edges.join(middle.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("at"))
    is_inner = middle.select(F.col("node").alias("at"), F.lit(False).alias("done"))
    at = stored(back.join(is_inner, "at", "left").select("node", "at", F.col("node").alias("path"), F.lit(1).cast("long").alias("place"), F.col("node").alias("least"), F.coalesce("done", F.lit(True)).alias("done")))
    discard(middle)

    def doubled(x: DataFrame) -> DataFrame:
        far = x.select(F.col("node").alias("at"), F.col("at").alias("at_"), F.col("path").alias("path_"), F.col("place").alias("place_"), F.col("least").alias("least_"), F.col("done").alias("done_"))
        open_ = x.where("NOT done").join(far, "at").select("node", F.col("at_").alias("at"), F.col("path_").alias("path"), (F.col("place") + F.col("place_")).alias("place"), F.least("least", "least_").alias("least"), F.col("done_").alias("done"))
        return x.where("done").unionByName(open_)

    for _ in range(2 + at.count().bit_length() // 2):
        if at.where("NOT done").isEmpty():
            break
        before, at = at, stored(doubled(doubled(at)))
        discard(before)
    inner = stored(at.where("done").select("node", "path", "place", F.col("at").alias("src")))
    loops = stored(at.where("NOT done").select("node", F.col("least").alias("loop")))
    discard(at)
    here = inner.select(F.col("node").alias("src"), "path", "place", F.col("src").alias("from"))
    onward = edges.join(here, "src").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    onward_ = onward.select(F.col("from").alias("src"), "dst", "path", (F.col("place") + 1).alias("length"))
    ends = inner.select(F.col("node").alias("n"))
    plain = edges.join(ends, F.col("src") == F.col("n"), "left_anti").join(ends, F.col("dst") == F.col("n"), "left_anti")
    short = stored(plain.select("src", "dst", F.lit(None).cast(inner.schema["path"].dataType).alias("path"), F.lit(1).cast("long").alias("length")).unionByName(onward_))
    return inner, short, loops


def reach(edges: DataFrame, start: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, node) that edges (src, dst) lead to from those of ``start``, which are among them.

    A round looks at the new rows alone and writes them as a table of the shared folder. After ``PLAIN_ROUNDS`` of them the
    nonbranching paths are contracted, and from there on a path of any length is one round. The tables of the rounds are deleted at the end.
    """
    columns = [*keys, "node"]
    frontier = stored(start.select(*columns).distinct())
    found, entered, rest, n_found = [frontier], [], [], 0
    inner = short = None
    for n in itertools.count(1):
        if frontier.isEmpty():
            break
        if n == PLAIN_ROUNDS + 1:
            inner, short = contract(edges)
            rest = [inner, short]
            inside = frontier.join(inner, "node")
            entered.append(stored(inside.select(*keys, "path", "place")))
            last = short.where("path IS NOT NULL").select("path", F.col("dst").alias("node"))
            onward = inside.select(*keys, "path").join(last, "path").select(*columns)
            frontier = stored(onward.unionByName(frontier.join(inner.select("node"), "node", "left_anti").select(*columns)).distinct())
            found.append(frontier)
        if short is None:
            step = frontier.join(edges, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node"))
        else:
            taken = stored(frontier.join(short, F.col("node") == F.col("src")).select(*keys, "dst", "path").distinct())
            entered.append(taken)
            step = taken.select(*keys, F.col("dst").alias("node"))
        seen, new = reduce(DataFrame.union, found), step.distinct()
        n_found += frontier.count()
        if n_found > MANY:
            candidates = stored(new)
            few = candidates.count() * 20 < n_found
            frontier = stored(candidates.join(seen.join(candidates, columns, "left_semi") if few else seen, columns, "left_anti").select(*columns))
            discard(candidates)
        else:
            frontier = stored(new.join(seen, columns, "left_anti").select(*columns))
        found.append(frontier)
    out = reduce(DataFrame.union, found)
    if entered:
        ways = entered[0].unionByName(reduce(DataFrame.union, (t.where("path IS NOT NULL").select(*keys, "path", F.lit(0).cast("long").alias("place")) for t in entered[1:])))
        first = ways.groupBy(*keys, "path").agg(F.min("place").alias("from_"))
        out = out.union(first.join(inner, "path").where("place > from_").select(*columns)).distinct()
    out = stored(out)
    discard(*found, *entered, *rest)
    return out


def required_for(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals (node) and everything upstream."""
    return reach(_turned(edges), goals)


def dependents(edges: DataFrame, victims: DataFrame) -> DataFrame:
    """Victims (node) and everything downstream."""
    return reach(_straight(edges), victims)


def invalidate(edges: DataFrame, ledger: DataFrame, matching: Column, name_match_only: bool = False) -> DataFrame:
    """Existing results (node) that match or depend on one that does; ``name_match_only`` keeps to those that match themselves."""
    victims = ledger.where(matching).select("node")
    return (victims.distinct() if name_match_only else dependents(edges, victims)).join(ledger.select("node").distinct(), "node", "left_semi")


def invalidated(ledger: DataFrame, victims: DataFrame) -> DataFrame:
    """The ledger with rows appended that mark the victims (node) invalidated; the rows before stay as its history."""
    rest = [c for c in ledger.columns if c not in ("node", "invalidated")]
    rows = victims.select("node").distinct().join(ledger.select("node", *rest).distinct(), "node").withColumn("invalidated", F.lit(True))
    before = ledger if "invalidated" in ledger.columns else ledger.withColumn("invalidated", F.lit(False))
    return before.unionByName(rows.select(*before.columns))


def relaxations(edges: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins (node, branch) are allowed on all ancestors of the node as well."""
    return reach(_turned(edges), pins, ["branch"]).select("node", "branch")


def _peeled(edges: DataFrame) -> list[DataFrame]:
    """Nodes level by level, each once: a node follows as soon as the last of its parents has been taken. Nodes on or after a cycle are in none."""
    each = _straight(edges).distinct().withColumn("length", F.lit(1).cast("long"))
    return _peel(each, None) or []


def _peel(edges: DataFrame, rounds: int | None, nodes: DataFrame | None = None) -> list[DataFrame] | None:
    """Frames (node, level) of edges (src, dst, length), one for each round; a level is one more than the longest way from a root. None if ``rounds`` do not suffice.

    ``nodes`` (node), if given, are all nodes, so that those without edges are roots as well.
    """
    need = stored(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")))
    top = (edges.select(F.col("src").alias("node")).distinct() if nodes is None else nodes).join(need, "node", "left_anti")
    frontier = stored(top.withColumn("level", F.lit(1).cast("long")))
    taken, written, waiting = [frontier], [need, frontier], None
    for n in itertools.count():
        if frontier.isEmpty():
            discard(need)
            return taken
        if n == rounds:
            discard(*written)
            return None
        parents_ = frontier.select(F.col("node").alias("src"), F.col("level").alias("from_"))
        got = edges.join(parents_, "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("got"), F.max(F.col("from_") + F.col("length")).alias("level"))
        if waiting is not None:
            got = got.unionByName(waiting).groupBy("node").agg(F.sum("got").alias("got"), F.max("level").alias("level"))
        counted = stored(got.join(need, "node"))
        written.append(counted)
        frontier = counted.where("got = need").select("node", "level")
        waiting = counted.where("got < need").select("node", "got", "level")
        taken.append(frontier)


def levels(edges: DataFrame) -> DataFrame:
    """node, level: 1 for roots, else one more than the highest parent. A cycle is an error.

    Only edges between nodes that have children are gone through in rounds; all leaves, mostly far more, follow in one step from their parents.
    A graph deeper than ``PLAIN_ROUNDS``, or most of whose nodes are on nonbranching paths, has these contracted first, so that they are one round each.
    """
    each = _straight(edges)
    nodes = stored(each.select(F.col("src").alias("node")).distinct())
    with_children = nodes.select(F.col("node").alias("dst"), F.lit(True).alias("inner"))
    tagged = stored(each.join(with_children, "dst", "left"))
    inner = tagged.where("inner").select("src", "dst").distinct()
    if not inner.where("src = dst").isEmpty():
        raise ValueError("the edges have a cycle")
    inner = stored(inner)
    degree = inner.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(inner.select("dst", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    n = degree.agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("out") == 1) & (F.col("in") == 1)).alias("middle")).first()
    taken = None if 2 * n.middle > n.all else _peel(inner.withColumn("length", F.lit(1).cast("long")), PLAIN_ROUNDS, nodes)
    if taken is not None:
        known = reduce(DataFrame.union, taken)
    else:
        inside, short = contract(inner)
        on_paths = inside.select("node")
        ends = stored(reduce(DataFrame.union, _peel(short, None, nodes.join(on_paths, "node", "left_anti"))))
        known = ends.union(inside.join(ends.withColumnRenamed("node", "src"), "src").select("node", (F.col("level") + F.col("place")).alias("level")))
    known = stored(known)
    if known.count() != nodes.count():
        raise ValueError("the edges have a cycle")
    leaves = tagged.where("inner IS NULL").select("src", F.col("dst").alias("node")).join(known.withColumnRenamed("node", "src"), "src").groupBy("node").agg((F.max("level") + 1).alias("level"))
    out = stored(known.unionByName(leaves).select("node", F.col("level").cast("int").alias("level")))
    discard(nodes, tagged, inner, known)
    return out


def order_nodes(level: DataFrame, mode: str = "breadth") -> DataFrame:
    """Nodes in an order in which parents come first (``breadth``), children come first (``depth``), or in any (``arbitrary``, no sort)."""
    if mode not in ("breadth", "depth", "arbitrary"):
        raise ValueError("mode is breadth, depth or arbitrary")
    return level if mode == "arbitrary" else level.orderBy(F.col("level") if mode == "breadth" else F.col("level").desc(), "node")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def check_acyclic(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle or between cycles; empty if there is none.

    Roots are peeled off level by level, then leaves likewise, so every edge is looked at a few times and no pairs of nodes are made.
    """
    def left(e: DataFrame) -> DataFrame:
        gone = reduce(DataFrame.union, (x.select("node") for x in _peeled(e)))
        return stored(e.join(gone.select(F.col("node").alias("parent")), "parent", "left_anti").select("parent", "child"))

    back = lambda e: e.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    rest = left(back(left(edges.select("parent", "child").distinct())))
    return rest.select(F.col("parent").alias("node")).union(rest.select("child")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """The strongly connected components with a cycle: node, component, named after its smallest node. A node on no cycle has no row.

    Nonbranching paths are contracted first. Then, as long as edges are left, every node takes the largest node that leads to it as its
    colour; those that also lead back to it, by edges of one colour, are its component and go, and so do nodes without edges in or out. Both are closures with one table for
    a round, so the rounds follow the longest way between branching nodes. No pairs of nodes are made.
    """
    each = _straight(edges).distinct()
    inner, short, loops = paths(each)
    found = [loops.select("node", F.col("loop").alias("component")), each.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))]
    own = short.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found.append(own)
    rest = stored(short.where("src <> dst").select("src", "dst").distinct().join(loops.select(F.col("node").alias("src")), "src", "left_anti"))
    while not rest.isEmpty():
        rest = _with_both_ends(rest)
        if rest.isEmpty():
            break
        colour = _colours(rest)
        there = colour.select(F.col("node").alias("src"), F.col("colour").alias("from_")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("to_"))
        joined = rest.join(there[0], "src").join(there[1], "dst")
        one = stored(joined.where("from_ = to_").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        same = reach(one, colour.where("node = colour").select("node"))
        part = same.join(colour, "node")
        least = part.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n_"))
        found.append(stored(part.join(least.where("n_ > 1"), "colour").select("node", "component")))
        gone = part.select("node")
        left = rest.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
        before, rest = rest, stored(left)
        discard(before, one, colour, same)
    # A component has one name, the smallest of all its nodes, those on paths between its nodes included.
    some = stored(reduce(DataFrame.union, found).groupBy("node").agg(F.min("component").alias("component")))
    ends = lambda c: some.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    within = short.where("path IS NOT NULL").join(ends("src"), "src").join(ends("dst"), "dst").where("src_ = dst_").select("path", F.col("src_").alias("component"))
    nodes = some.unionByName(inner.join(within, "path").select("node", "component"))
    names = nodes.groupBy("component").agg(F.min("node").alias("name"))
    out = stored(nodes.join(names, "component").groupBy("node").agg(F.min("name").alias("component")))
    discard(inner, short, loops, some)
    return out


def _with_both_ends(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) after a few rounds that take away nodes without an edge in or without one out, which are on no cycle."""
    for _ in range(3):
        has = lambda c, other: edges.select(F.col(other).alias(c)).distinct()
        before, edges = edges, stored(edges.join(has("src", "dst"), "src", "left_semi").join(has("dst", "src"), "dst", "left_semi").select("src", "dst"))
        discard(before)
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest node from which edges (src, dst) lead to it, itself included."""
    colour = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")).withColumn("new", F.lit(True)))
    while not colour.where("new").isEmpty():
        sent = edges.join(colour.where("new").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        step = colour.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("new"))
        before, colour = colour, stored(step)
        discard(before)
    return colour


def collapse(edges: DataFrame, virtual: DataFrame) -> DataFrame:
    """Edges between real nodes, paths through virtual nodes (node) taken as one edge.

    Edges are told apart once; only those between virtual nodes are gone through in rounds, and real ends are met once.
    """
    v = virtual.select("node").distinct().withColumn("yes", F.lit(True))
    mark = lambda e, c: e.join(v.select(F.col("node").alias(c), F.col("yes").alias(f"{c}_")), c, "left").withColumn(f"{c}_", F.coalesce(f"{c}_", F.lit(False)))
    kinds = stored(mark(mark(edges.select("parent", "child"), "parent"), "child"))
    some = lambda parent, child: kinds.where(f"{'' if parent else 'NOT '}parent_ AND {'' if child else 'NOT '}child_").select("parent", "child")
    start, between = some(False, True).select("parent", F.col("child").alias("node")), some(True, True)
    through = start if between.isEmpty() else reach(_straight(between), start, ["parent"])
    last = through.join(some(True, False).select(F.col("parent").alias("node"), "child"), "node").select("parent", "child")
    out = stored(some(False, False).union(last).distinct())
    discard(kinds)
    return out


def edge_list(edges: DataFrame, level: str = "realization") -> DataFrame:
    """Distinct edges of results, or with level ``task`` of the steps they belong to (node names are task/realization)."""
    task = lambda c: F.substring_index(c, "/", 1).alias(c)
    return (edges.select(task("parent"), task("child")) if level == "task" else edges.select("parent", "child")).distinct()


def edge_labels(edges: DataFrame) -> DataFrame:
    """One row per edge with all its labels, sorted, one a line."""
    return edges.groupBy("parent", "child").agg(F.array_join(F.sort_array(F.collect_set("label")), "\n").alias("label"))


def goal_edges(outputs: DataFrame, goals: DataFrame) -> DataFrame:
    return outputs.join(goals, "task").select("task", "output_name")
