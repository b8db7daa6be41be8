"""Manifests against a tree that plain Python builds level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, empty
from varigrid.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, arity):
    """The root, and for each leaf its siblings level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append((run[: i % arity], run[i % arity + 1 :]))
        nodes, at = [H(*r) for r in runs], [i // arity for i in at]
    return (nodes[0] if nodes else None), paths


def expected(rows, arity):
    groups = {}
    for r in sorted(((s, d, H(enc(d), enc(s), enc(t))) for d, t, s in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    roots, out = [], []
    for g in groups.values():
        root, paths = tree([r[2] for r in g], arity)
        roots.append(root)
        out.append((g, root, paths))
    root, tops = tree(roots, arity)
    return root, sorted(str((s, d, h, sub, root, p + top)) for (g, sub, paths), top in zip(out, tops, strict=True) for (s, d, h), p in zip(g, paths, strict=True))


def got(docs, arity, every):
    leaf = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("text")])
    m = merkle.build(docs, "source", [F.col("doc_id")], leaf, {"doc_id": F.col("doc_id")}, arity, every)

    def made(leaf, path, carried):
        cut = lambda x: [x[i : i + 64] for i in range(0, len(x), 64)]
        return {"doc_id": carried["doc_id"], "siblings": str([(cut(a), cut(b)) for a, b in merkle.siblings(path)]), "folds": merkle.folded(leaf, path), "wrong": merkle.folded("0" * 64, path)}

    rows = merkle.proofs(m, made, "doc_id long, siblings string, folds string, wrong string").collect()
    assert all(r.folds == r.root for r in rows) and not any(r.wrong == r.root for r in rows)
    assert not any(c for level, df in m.trees.levels for c in df.columns if c not in ("tree", "part", "height", "nodes")) and [level for level, _ in m.trees.levels] == [every * i for i in range(len(m.trees.levels))]
    return m.root, sorted(f"({r.source!r}, {r.doc_id}, {r.leaf!r}, {r.subroot!r}, {r.root!r}, {r.siblings})" for r in rows)


@pytest.mark.parametrize(("arity", "every"), [(2, 2), (3, 1), (2, 3), (16, 2)])
def test_trees_and_proofs(spark, arity, every):
    docs = documents(spark, n=40).select("doc_id", "text", "source", "node", F.lit(1).alias("tree"), F.lit("x").alias("h"))
    docs = docs.unionByName(spark.createDataFrame([(1, "a", "alone", "n", 1, "x"), (None, "b", "two", "n", 1, "x"), (None, None, "two", "n", 1, "x"), (7, "é" * 5000, "", "n", 1, "x")], docs.schema))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got(docs.repartition(3), arity, every) == expected(rows, arity)


def test_empty_and_single(spark):
    assert got(empty(spark), 16, 2) == (None, [])
    one = spark.createDataFrame([(5, "t", None)], "doc_id long, text string, source string")
    assert got(one, 16, 2) == expected([(5, "t", None)], 16)
