"""Variant frames: DataFrames whose rows carry the branches that made them, one nullable column per branch point."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.functions import realization, realization_full
from varigrid.plans import BranchPoint, sequence


@dataclass(frozen=True)
class VariantFrame:
    """df with a bp_ column for each of points; masks: the sets of points that can be present together in a row."""

    df: DataFrame
    points: Mapping[str, BranchPoint]
    masks: frozenset[frozenset[str]] = frozenset([frozenset()])

    @property
    def columns(self) -> list[str]:
        return [self.points[p].column for p in sorted(self.points)]

    def named(self, full: bool = False) -> DataFrame:
        cols = {p: F.col(b.column) for p, b in self.points.items()}
        name = realization_full(cols) if full else realization(cols, {p: b.baseline for p, b in self.points.items()})
        return self.df.withColumn("realization_full" if full else "realization", name)

    def where(self, condition: Column) -> VariantFrame:
        return replace(self, df=self.df.where(condition))


def variants(df: DataFrame) -> VariantFrame:
    """A frame without branch points."""
    return VariantFrame(df, {})


def branch(vf: VariantFrame, point: BranchPoint, into: str | None = None, pinned: Sequence[str] | None = None) -> VariantFrame:
    """Every row once per branch; ``into`` takes the value, or a dict value sets several columns. ``pinned`` keeps only these branches."""
    if point.name in vf.points:
        raise ValueError(f"{point.name} is already chosen; pin it first")
    kept = {b: v for b, v in point.branches.items() if pinned is None or b in pinned}
    fields = lambda b, v: [F.lit(b).alias(point.column), *((F.lit(x).alias(c) for c, x in v.items()) if isinstance(v, Mapping) else [F.lit(v).alias(into)] if into else [])]
    made = F.explode(F.array(*(F.struct(*fields(b, v)) for b, v in kept.items())))
    df = vf.df.withColumn("branch_", made).select(*vf.df.columns, "branch_.*")
    return VariantFrame(df, {**vf.points, point.name: point}, frozenset(m | {point.name} for m in vf.masks))


def branch_seq(vf: VariantFrame, name: str, start: object, end: object, step: object = 1, into: str | None = None) -> VariantFrame:
    p = sequence(name, start, end, step)
    return branch(vf, BranchPoint(name, {b: float(v) for b, v in p.branches.items()}), into)


def replicate(vf: VariantFrame, n: int, name: str = "Trial") -> VariantFrame:
    """n repeated trials, numbered from 1; the number is column ``trial``."""
    return branch(vf, BranchPoint(name, {str(i): i for i in range(1, n + 1)}), "trial")


def branch_nested(vf: VariantFrame, point: BranchPoint, inner: Mapping[str, Callable[[VariantFrame], VariantFrame]]) -> VariantFrame:
    """A branch point whose branches may open points of their own; those are null under the other branches."""
    parts = [inner.get(b, lambda x: x)(branch(vf, point, pinned=[b])) for b in point.branches]
    return union_variants(parts)


def union_variants(parts: Sequence[VariantFrame]) -> VariantFrame:
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.df for p in parts))
    return VariantFrame(df, reduce(lambda a, b: {**a, **b}, (p.points for p in parts)), frozenset().union(*(p.masks for p in parts)))


def graft(vf: VariantFrame, **pins: str) -> VariantFrame:
    """Rows of the pinned branches, with these points hidden; rows without the point do not match."""
    for p, b in pins.items():
        if p not in vf.points or b not in vf.points[p].branches:
            raise KeyError(f"no branch {p}.{b}")
    df = vf.df.where(reduce(Column.__and__, (F.col(vf.points[p].column) == b for p, b in pins.items()))).drop(*(vf.points[p].column for p in pins))
    return VariantFrame(df, {p: b for p, b in vf.points.items() if p not in pins}, frozenset(m - set(pins) for m in vf.masks if set(pins) <= m) or frozenset([frozenset()]))


def vjoin(left: VariantFrame, right: VariantFrame, on: Sequence[str] = ()) -> VariantFrame:
    """Combine rows whose shared branch points agree, an absent point agreeing with anything.

    The declared masks say which points can be absent; each pair of presence patterns is one equi-join, so no pattern needs a
    nested-loop join unless nothing at all is shared.
    """
    shared = sorted(set(left.points) & set(right.points))
    cols = [left.points[p].column for p in shared]
    parts = lambda vf: sorted({tuple(p for p in shared if p in m) for m in vf.masks})

    def having(vf: VariantFrame, present: Sequence[str], suffix: str) -> DataFrame:
        df = vf.df
        if len(parts(vf)) > 1:
            df = df.where(reduce(Column.__and__, (F.col(vf.points[p].column).isNotNull() == (p in present) for p in shared), F.lit(True)))
        return df.withColumnsRenamed({c: c + suffix for c in cols})

    out = []
    for pl in parts(left):
        for pr in parts(right):
            a, b = having(left, pl, "_l"), having(right, pr, "_r")
            keys = [F.col(f"{left.points[p].column}_l") == F.col(f"{left.points[p].column}_r") for p in shared if p in pl and p in pr]
            if on:
                b = b.withColumnsRenamed({c: c + "__r" for c in on})
                keys += [F.col(c) == F.col(c + "__r") for c in on]
            j = a.join(b, reduce(Column.__and__, keys)) if keys else a.crossJoin(b)
            j = j.withColumns({c: F.coalesce(c + "_l", c + "_r") for c in cols}).drop(*(c + x for c in cols for x in ("_l", "_r")), *(c + "__r" for c in on))
            out.append(j)
    df = reduce(DataFrame.unionByName, out)
    masks = frozenset(a | b for a in left.masks for b in right.masks)
    return VariantFrame(df, {**left.points, **right.points}, masks)


def vjoin_theta(left: VariantFrame, right: VariantFrame, on: Sequence[str] = ()) -> VariantFrame:
    """The same join by one null-compatible condition; for comparison and tiny inputs."""
    shared = sorted(set(left.points) & set(right.points))
    a = left.df.withColumnsRenamed({left.points[p].column: f"{left.points[p].column}_l" for p in shared})
    b = right.df.withColumnsRenamed({left.points[p].column: f"{left.points[p].column}_r" for p in shared} | {c: c + "__r" for c in on})
    cond = F.lit(True)
    for p in shared:
        x, y = F.col(f"{left.points[p].column}_l"), F.col(f"{left.points[p].column}_r")
        cond &= x.isNull() | y.isNull() | (x == y)
    for c in on:
        cond &= F.col(c) == F.col(c + "__r")
    j = a.join(b, cond)
    for p in shared:
        c = left.points[p].column
        j = j.withColumn(c, F.coalesce(c + "_l", c + "_r")).drop(c + "_l", c + "_r")
    return VariantFrame(j.drop(*(c + "__r" for c in on)), {**left.points, **right.points}, frozenset(x | y for x in left.masks for y in right.masks))


def vjoin_delta(l_old: VariantFrame, l_new: VariantFrame, r_old: VariantFrame, r_new: VariantFrame, on: Sequence[str] = ()) -> VariantFrame:
    """Only the combinations that hold a new row of either side."""
    return union_variants([vjoin(l_new, union_variants([r_old, r_new]), on), vjoin(l_old, r_new, on)])


def vjoin_new(old: Sequence[VariantFrame], new: Sequence[VariantFrame], on: Sequence[str] = ()) -> VariantFrame:
    """Only the combinations of any number of parents that hold a new row, each once: the first parent whose row is new tells them apart.

    For each parent: its new rows, with the old rows of those before it and all rows of those after it. The new rows, which are few, come first in each join.
    """
    parts = []
    for i, rows in enumerate(new):
        others = [*old[:i], *(union_variants([a, b]) for a, b in zip(old[i + 1 :], new[i + 1 :], strict=True))]
        parts.append(reduce(lambda a, b: vjoin(a, b, on), others, rows))
    return union_variants(parts)


def dedupe(vf: VariantFrame, keys: Sequence[str], order: str) -> VariantFrame:
    """One row of those with equal keys, that with the smallest ``order``."""
    first = vf.df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in vf.df.columns if c not in keys)), order).alias("r_"))
    return replace(vf, df=first.select(*keys, "r_.*"))


def per_variant(vf: VariantFrame, fn, schema: str, by: Sequence[str] = (), buckets: int = 1) -> DataFrame:
    """Run opaque pandas code once per realization; a realization must fit one task. Prefer DataFrame expressions.

    With ``buckets`` the rows of a realization are dealt by the hash of the columns ``by`` and the code runs once per realization and bucket, so that a
    realization of any size is many tasks' work; what it gives for the buckets is merged by an aggregate of the caller's.
    """
    if buckets == 1:
        return vf.df.groupBy(*vf.columns).applyInPandas(fn, schema)
    return vf.df.groupBy(*vf.columns, F.pmod(F.hash(*by), F.lit(buckets)).alias("bucket_")).applyInPandas(fn, schema)


def bind(df: DataFrame, name: str, value: Column | object) -> DataFrame:
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def with_globals(df: DataFrame, conf: Mapping[str, object]) -> DataFrame:
    """Named values of a run as columns of every row."""
    return df.withColumns({k: F.lit(v) for k, v in conf.items()})
