"""Branch points, grids of realizations, plans and globs: small driver-side declarations that become DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.functions import glob_to_regex

ANY = "*"
#: Longest sequence that a branch point may have.
LONGEST_SEQUENCE = 100_000


@dataclass(frozen=True)
class BranchPoint:
    """A named choice; the first branch is the baseline. Values are literals, or dicts that set several columns at once."""

    name: str
    branches: Mapping[str, object]

    @property
    def column(self) -> str:
        return f"bp_{self.name}"

    @property
    def baseline(self) -> str:
        return next(iter(self.branches))


@dataclass(frozen=True)
class Plan:
    """Steps to reach, in the realizations that a clause accepts; several plans add up."""

    name: str
    goals: Sequence[str]
    clause: Mapping[str, Sequence[str] | str]


def sequence(name: str, start: object, end: object, step: object = 1) -> BranchPoint:
    """Decimal steps from start to end, both included; labels have no zeros at the end."""
    a, z, by = (Decimal(str(x)) for x in (start, end, step))
    if by <= 0:
        raise ValueError("the step of a sequence must be positive")
    n = int((z - a) // by) + 1
    if n > LONGEST_SEQUENCE:
        raise ValueError(f"a sequence of {n} branches is too long")
    label = lambda d: (f"{d:f}".rstrip("0").rstrip(".") or "0") if "." in f"{d:f}" else f"{d:f}"
    return BranchPoint(name, {label(a + i * by): a + i * by for i in range(n)})


def dimension(spark: SparkSession, points: Iterable[BranchPoint]) -> DataFrame:
    """branch_dim: branch_point, branch, value, ord, is_baseline."""
    rows = [(p.name, b, str(v), i, i == 0) for p in points for i, (b, v) in enumerate(p.branches.items())]
    return spark.createDataFrame(rows, "branch_point string, branch string, value string, ord int, is_baseline boolean")


def baselines(dim: DataFrame) -> DataFrame:
    """The first branch of every point."""
    return dim.groupBy("branch_point").agg(F.min_by("branch", "ord").alias("branch"))


def cross(points: Sequence[BranchPoint]) -> list[dict[str, str]]:
    """All realizations."""
    return reduce(lambda rows, p: [r | {p.name: b} for r in rows for b in p.branches], points, [{}])


def one_off(points: Sequence[BranchPoint]) -> list[dict[str, str]]:
    """Realizations with at most one branch that is no baseline, made directly."""
    base = {p.name: p.baseline for p in points}
    return [base, *(base | {p.name: b} for p in points for b in p.branches if b != p.baseline)]


def grid(spark: SparkSession, points: Sequence[BranchPoint], rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Realizations as a table: bp_ columns and, for each point, its value as val_ column (null where absent)."""
    literal = lambda x: F.lit(x if not isinstance(x, Decimal) else float(x))
    made = [F.struct(*(f for p in points for f in (F.lit(r.get(p.name)).cast("string").alias(p.column), literal(p.branches[r[p.name]] if r.get(p.name) is not None else None).alias(f"val_{p.name}")))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def in_clause(points: Sequence[BranchPoint], clause: Mapping[str, Sequence[str] | str], relax: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a row's branches fit a clause: named points must be listed (or ``*``), all others at baseline; absent points fit.

    ``relax`` lists branches that some consumer pins; they are accepted as well.
    """
    ok = F.lit(True)
    for p in points:
        c, want = F.col(p.column), clause.get(p.name)
        if want != ANY and (want is None or ANY not in want):
            names = [p.baseline if b == "baseline" else b for b in (want or [p.baseline])]
            ok &= c.isNull() | c.isin(*names, *(relax or {}).get(p.name, ()))
    return ok


def is_one_off(points: Sequence[BranchPoint], relax: Mapping[str, Sequence[str]] | None = None) -> Column:
    off = [F.coalesce((F.col(p.column) != p.baseline) & ~F.col(p.column).isin(*(relax or {}).get(p.name, ("",))), F.lit(False)).cast("int") for p in points]
    return reduce(Column.__add__, off, F.lit(0)) <= 1


def is_relaxed(column: Column, branches: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*branches), F.lit(False))


def plan_union(grid_: DataFrame, points: Sequence[BranchPoint], plans: Mapping[str, Sequence[Mapping]], names: Sequence[str]) -> DataFrame:
    """Realizations that a clause of a chosen plan accepts."""
    if unknown := [n for n in names if n not in plans]:
        raise KeyError(f"no plan {unknown}; there are {sorted(plans)}")
    tests = [in_clause(points, c) for n in names for c in plans[n]]
    return grid_.where(reduce(Column.__or__, tests, F.lit(False))).distinct()


def explain_plan(grid_: DataFrame, points: Sequence[BranchPoint], plans: Mapping[str, Sequence[Mapping]]) -> DataFrame:
    """Every realization under every clause: plan, clause, accepted, reason (the first point that does not fit)."""
    out = []
    for name, clauses in plans.items():
        for i, clause in enumerate(clauses):
            reasons = [F.when(~in_clause([p], clause), F.concat(F.lit(f"{p.name}."), F.col(p.column), F.lit(" not in plan"))) for p in points]
            why = F.coalesce(*reasons)
            out.append(grid_.withColumns({"plan": F.lit(name), "clause": F.lit(i), "accepted": why.isNull(), "reason": why}))
    return reduce(DataFrame.unionByName, out)


def match_realization(points: Sequence[BranchPoint], glob: str) -> Column:
    """``A.x*+B.?`` : named points must be present and match, others at baseline; with ``*`` as a part others are free."""
    parts = glob.split("+")
    named = dict(p.split(".", 1) for p in parts if p != ANY)
    ok = F.lit(True)
    for p in points:
        c = F.col(p.column)
        if p.name in named:
            ok &= c.isNotNull() & c.rlike(glob_to_regex(named[p.name]))
        elif ANY not in parts:
            ok &= c.isNull() | (c == p.baseline)
    return ok & F.lit(set(named) <= {p.name for p in points})


def in_planned(df: DataFrame, planned: DataFrame) -> DataFrame:
    return df.join(planned, ["task", "realization"], "left_semi")


def list_realizations(df: DataFrame) -> DataFrame:
    return df.select("task", "realization").distinct()
