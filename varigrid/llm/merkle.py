"""Merkle manifests of tables: checkpointed levels, and proofs that recompute the levels between.

Rows are leaves of one tree per source; the trees' roots, in order of the sources, are the leaves of one more tree. A node is the
hash of up to ``arity`` consecutive nodes below it. Only every ``every``-th level is written: a stored row is one *aligned subtree*, the
nodes of a stored level below one node of the next stored level, at most arity ** every of them. Proof extraction
goes from the root down. It takes each stored row, recomputes the levels that lie between from the nodes it holds, emits the
siblings on the way up from each node, and keeps none of the recomputed nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from varigrid.llm.common import discard, store

#: Levels that a tree can have at most.
_MOST = 62
_SIBLINGS = "array<struct<run:string,at:int>>"


def encoded(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the values one after the other, in lower-case hexadecimal."""
    return F.sha2(F.concat(*values), 256)


def leaf(values: Sequence[Column]) -> Column:
    return digest(*(encoded(c) for c in values))


@dataclass(frozen=True)
class Forest:
    """levels: (first level, stored rows) from the leaves up; a stored row has tree, part, height (of its tree) and nodes (a digest and the leaf's carried
    columns). roots: tree, height, root. arity and every as they were built."""

    levels: Sequence[tuple[int, DataFrame]]
    roots: DataFrame
    arity: int
    every: int


@dataclass(frozen=True)
class Manifest:
    """Trees of the sources, the tree of their roots, and the sources by the numbers of their trees; root is null without leaves."""

    sources: DataFrame
    trees: Forest
    top: Forest

    @property
    def root(self) -> str | None:
        row = self.top.roots.first()
        return row.root if row else None


def recomputed(nodes: Sequence[str], arity: int, steps: int) -> tuple[list[list[str]], list[str]]:
    """For each of ``steps`` levels the runs of nodes below it, each as one string; and the digests that come last."""
    levels = []
    for _ in range(steps):
        levels.append(["".join(nodes[i : i + arity]) for i in range(0, len(nodes), arity)])
        nodes = [sha256(run) for run in levels[-1]]
    return levels, list(nodes)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def path_of(levels: list[list[str]], i: int, arity: int) -> list[tuple[str, int]]:
    """The run and the place in it at each recomputed level, for the i-th node of a stored row."""
    return [(runs[i // arity ** (j + 1)], i // arity**j % arity) for j, runs in enumerate(levels)]


def _steps(level: int, every: int) -> Column:
    """Levels that a stored row spans: ``every``, or what its tree has left."""
    return F.least(F.lit(every), F.col("height") - level)


def height(n: Column, arity: int) -> Column:
    """Levels above n leaves: the smallest power of arity that is no smaller than n."""
    powers = [arity**i for i in range(_MOST) if arity**i < 2**62]
    return reduce(Column.__add__, ((n > p).cast("int") for p in powers))


def ranked(rows: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """Add ``at``, each row's place in its tree by ``order``, from 0, and ``n``, the rows of its tree; a tree of any size is sorted by ranges, in many tasks."""
    ordered = store(rows.repartitionByRange(F.asc_nulls_first(tree), *order).sortWithinPartitions(F.asc_nulls_first(tree), *order).withColumn("mid", F.monotonically_increasing_id()), "ordered")
    # The high bits of mid are the partition, the low 33 the place in it.
    part = F.shiftright("mid", 33)
    counts = ordered.groupBy(part.alias("part_"), F.col(tree).alias("tree_")).agg(F.count(F.lit(1)).alias("c_"), F.min("mid").alias("first_"))
    by = Window.partitionBy("tree_")
    before = F.sum("c_").over(by.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c_")
    starts = store(counts.select("part_", "tree_", (before - F.col("first_")).alias("shift_"), F.sum("c_").over(by).alias("n")), "starts")
    out = ordered.join(starts, (part == F.col("part_")) & F.col(tree).eqNullSafe(F.col("tree_")))
    return out.withColumn("at", F.col("mid") + F.col("shift_")).drop("part_", "tree_", "shift_", "mid")


def forest(leaves: DataFrame, arity: int, every: int) -> Forest:
    """Trees over leaves (tree, at, n, h, and any columns to carry); all levels but every ``every``-th are computed and not kept."""
    carried = [c for c in leaves.columns if c not in ("tree", "at", "n")]
    span, levels, roots = arity**every, [], []
    nodes = leaves.select("tree", "at", height(F.col("n"), arity).alias("height"), *carried)
    level, tall = 0, True

    @F.pandas_udf("string")
    def top(digests: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([recomputed(d, arity, n)[1][0] for d, n in zip(digests, steps, strict=True)], dtype=object)

    while tall:
        node = F.struct("at", *carried)
        # A single leaf is a stored row as well, of no levels.
        rows = nodes.where(F.col("height") > level) if level else nodes
        rows = rows.groupBy("tree", F.floor(F.col("at") / span).alias("part"), "height").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        stored = store(rows, f"level-{level}")
        levels.append((level, stored))
        if not level:
            roots.append(stored.where("height = 0").select("tree", "height", F.col("nodes")[0]["h"].alias("root")))
        up = stored.where("height > 0").select("tree", F.col("part").alias("at"), "height", top("nodes.h", _steps(level, every)).alias("h"))
        nodes = store(up, f"nodes-{level + every}")
        roots.append(nodes.where(F.col("height") <= level + every).select("tree", "height", F.col("h").alias("root")))
        level, carried = level + every, ["h"]
        tall = not nodes.where(F.col("height") > level).isEmpty()
    return Forest(levels, store(reduce(DataFrame.union, roots), "roots"), arity, every)


def build(docs: DataFrame, source: str, order: Sequence[Column], leaf_: Column, carry: Mapping[str, Column] | None = None, arity: int = 16, every: int = 2) -> Manifest:
    """The manifest of a table: a leaf for every row, trees by ``source`` (null is one), leaves in ``order``.

    ``carry`` names columns to keep beside the leaf, which proofs return. Rows that tie in ``order`` follow by their leaf and carried
    columns, so the tree is the same in every run. Texts of any length are one leaf; other columns are ignored whatever their names; an
    empty table has no trees and the root null. The table is read once; from there on a leaf takes about 200 bytes.
    """
    keep = {f"c_{k}": v for k, v in (carry or {}).items()}
    names = [f"o_{i}" for i in range(len(order))]
    rows = docs.select(F.col(source).alias("source"), *(c.alias(n) for c, n in zip(order, names, strict=True)), leaf_.alias("h"), *(v.alias(k) for k, v in keep.items()))
    rows = store(rows, "leaves")
    by = [F.asc_nulls_first(n) for n in names]
    sources = ranked(rows.select("source").distinct().withColumn("all_", F.lit(0)), "all_", [F.asc_nulls_first("source")]).select("source", F.col("at").alias("tree"))
    sources = store(sources, "sources")
    placed = ranked(rows, "source", [*by, F.asc("h"), *(F.asc_nulls_first(k) for k in keep)])
    s = sources.withColumnRenamed("source", "source_")
    placed = placed.join(s, F.col("source").eqNullSafe(F.col("source_"))).select("tree", "at", "n", "h", *keep)
    trees = forest(placed, arity, every)
    discard(rows)
    n = trees.roots.count()
    top = forest(trees.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.lit(n).cast("long").alias("n"), F.col("root").alias("h")), arity, every)
    return Manifest(sources, trees, top)


def _expanded(rows: DataFrame, level: int, f: Forest, made: Callable[[dict, list], dict], schema: str) -> DataFrame:
    """(tree, and what ``made`` gives for each node and its path) of stored rows that have their own path (``above``); the levels between are recomputed and dropped here."""
    arity = f.arity

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                levels, _ = recomputed([x["h"] for x in row["nodes"]], arity, row["steps"])
                above = [(x["run"], x["at"]) for x in row["above"]]
                out = [{"tree": row["tree"], "height": row["height"]} | made(x, path_of(levels, k, arity) + above) for k, x in enumerate(row["nodes"])]
                yield pa.RecordBatch.from_pylist(out, schema=types)

    rows = rows.select("tree", "height", _steps(level, f.every).alias("steps"), "nodes", "above")
    types = to_arrow_schema(StructType.fromDDL(f"tree long, height int, {schema}"))
    return rows.mapInArrow(work, f"tree long, height int, {schema}")


def _down(f: Forest, above: DataFrame, last: int = 0) -> DataFrame:
    """The stored rows of level ``last`` with ``above``, the path from their top to the end; above: tree, path of each tree's root."""
    paths = None
    for level, stored in reversed(f.levels):
        if level < last:
            break
        ends = stored.where(F.col("height") <= level + f.every).join(above.select("tree", F.col("path").alias("above")), "tree")
        rows = ends
        if paths is not None:
            through = stored.where(F.col("height") > level + f.every).join(paths, ["tree", "part"])
            rows = ends.unionByName(through)
        if level == last:
            return rows
        up = _expanded(rows, level, f, _kept_path, f"part long, above {_SIBLINGS}").drop("height")
        paths = store(up, f"paths-{level}")
    raise ValueError(f"level {last} is not stored")


def _kept_path(node: dict, path: list) -> dict:
    return {"part": node["at"], "above": [{"run": run, "at": at} for run, at in path]}


def siblings(path: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """At each level the digests before and after one's own."""
    return [(run[: at * 64], run[at * 64 + 64 :]) for run, at in path]


def folded(leaf_: str, path: list[tuple[str, int]]) -> str:
    """The root that a leaf and the siblings of its path give."""
    return reduce(lambda h, s: sha256(s[0] + h + s[1]), siblings(path), leaf_)


def proof_digest(path: list[tuple[str, int]]) -> str:
    """SHA-256 of all siblings, level by level, left to right."""
    return sha256("".join(a + b for a, b in siblings(path)))


def proofs(m: Manifest, made: Callable[[str, list, dict], dict], schema: str) -> DataFrame:
    """One row per leaf: source, leaf, subroot, root, and the columns of ``schema`` that ``made`` gives for the leaf, its path and its carried columns.

    A path goes from the leaf up: (run, at), the digests of the leaf's run, its own among them, as one string, and its own place in
    it. Paths are long, so what is made of them is made beside the aligned subtree and only that leaves it. Levels that were not stored are
    recomputed there and go with it. A lone leaf of a lone source has an empty path.
    """
    def leaf_row(node: dict, path: list) -> dict:
        return {"leaf": node["h"]} | made(node["h"], path, {k.removeprefix("c_"): v for k, v in node.items() if k.startswith("c_")})

    ends = m.top.roots.select("tree", F.array().cast(_SIBLINGS).alias("path"))
    top = _expanded(_down(m.top, ends), 0, m.top, lambda node, path: _kept_path(node, path) | {"subroot": node["h"]}, f"part long, above {_SIBLINGS}, subroot string")
    trees = store(top.select(F.col("part").alias("tree"), "subroot", F.col("above").alias("path")), "top-paths")
    each = _expanded(_down(m.trees, trees), 0, m.trees, leaf_row, f"leaf string, {schema}").drop("height")
    facts = m.sources.join(trees.select("tree", "subroot"), "tree").withColumn("root", F.lit(m.root).cast("string"))
    return each.join(facts, "tree").drop("tree")
