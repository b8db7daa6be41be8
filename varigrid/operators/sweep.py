"""One analysis under many settings in one job: three forms with equal results."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varigrid.plans import BranchPoint, grid

#: Realizations of a grid that is sent to all tasks.
MOST_BROADCAST = 100_000


def sweep(facts: DataFrame, points: Sequence[BranchPoint], rows: Sequence[Mapping[str, str]], holds: Callable[[], Column], aggs: Sequence[Column]) -> DataFrame:
    """General form: facts joined with the declared grid under any condition over fact columns and val_ columns.

    The grid is declared on the driver, so its size is known; up to ``MOST_BROADCAST`` realizations it is broadcast, beyond that Spark chooses.
    """
    g = grid(facts.sparkSession, points, rows)
    g = F.broadcast(g) if len(rows) <= MOST_BROADCAST else g
    return facts.join(g, holds()).groupBy(*(p.column for p in points)).agg(*aggs)


def sweep_conditional(facts: DataFrame, points: Sequence[BranchPoint], rows: Sequence[Mapping[str, str]], holds: Callable[[Mapping[str, object]], Column], sums: Mapping[str, Column]) -> DataFrame:
    """One scan with a conditional sum per realization; for about ten realizations or fewer."""
    names = list(sums)
    aggs = [F.sum(F.when(holds({p.name: p.branches[r[p.name]] for p in points}), v)).alias(f"{n}_{i}") for i, r in enumerate(rows) for n, v in sums.items()]
    wide = facts.agg(*aggs)
    each = [F.struct(*(F.lit(r[p.name]).alias(p.column) for p in points), *(F.col(f"{n}_{i}").alias(n) for n in names)) for i, r in enumerate(rows)]
    return wide.select(F.explode(F.array(*each)).alias("r")).select("r.*").where(reduce(Column.__or__, (F.col(n).isNotNull() for n in names)))


def _rank(c: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds c reaches, by halving, so a row costs their logarithm; null reaches none."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(c >= bounds[mid - 1], among(mid, high)).otherwise(among(low, mid - 1))

    return among(0, len(bounds))


@dataclass(frozen=True)
class _Dimension:
    """A point as a dimension of cells: the cell of a fact, and the branches that hold for a cell (or, cumulative, from it downwards)."""

    point: BranchPoint
    cell: Column
    branches: list[list[str]]
    cumulative: bool


def _dimension(p: BranchPoint, column: str) -> _Dimension:
    c = F.col(column)
    if all(isinstance(v, (set, frozenset, list, tuple)) for v in p.branches.values()):
        values = {x for v in p.branches.values() for x in v}
        kinds: dict[tuple[str, ...], list] = {}
        for x in values:
            kinds.setdefault(tuple(b for b, v in p.branches.items() if x in v), []).append(x)
        cell = reduce(lambda done, i: F.when(c.isin(*list(kinds.values())[i]), F.lit(i + 1)).otherwise(done), range(len(kinds)), F.lit(0))
        return _Dimension(p, cell, [list(k) for k in kinds], False)
    bounds = sorted({float(v) for v in p.branches.values()})
    return _Dimension(p, _rank(c, bounds), [[b for b, v in p.branches.items() if float(v) == t] for t in bounds], True)


def _unrolled(cells: DataFrame, d: _Dimension, keys: Sequence[str], merge: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """The cells with the dimension replaced by its branches; what is merged is merged over the cells of each."""
    name = f"cell_{d.point.name}"
    names = F.array(*(F.array(*(F.lit(b) for b in bs)) for bs in d.branches))
    cells = cells.where(F.col(name) > 0)
    if not d.cumulative:
        rows = cells.select(*keys, *merge, F.explode(names[F.col(name) - 1]).alias(d.point.column))
        return rows.groupBy(*keys, d.point.column).agg(*(f(c).alias(c) for c, f in merge.items()))
    order = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc(name))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # A cell answers for the thresholds from its own down to the one above the next lower cell.
    below = F.coalesce(F.lead(name).over(order), F.lit(0))
    rows = cells.select(*keys, name, below.alias("below_"), *(f(c).over(so_far).alias(c) for c, f in merge.items()))
    rows = rows.select(*keys, *merge, F.explode(F.sequence(F.col("below_") + 1, F.col(name))).alias("rank_"))
    return rows.select(*keys, *merge, F.explode(names[F.col("rank_") - 1]).alias(d.point.column))


def sweep_cells(facts: DataFrame, points: Sequence[BranchPoint], rows: Sequence[Mapping[str, str]], on: Mapping[str, str], sums: Mapping[str, Column] | None = None, mins: Mapping[str, Column] | None = None, maxs: Mapping[str, Column] | None = None, distinct: Mapping[str, Column] | None = None) -> DataFrame:
    """Points that ask ``column >= value``, or, where branches have sets of values, ``column`` in the set.

    Facts are reduced to one cell for each combination of what they pass. Then one point after the other is unrolled: sets by their
    branches, thresholds by one cumulative window, in which sums, minima, maxima and distinct counts are carried on. So neither the pass over the
    facts nor what follows compares cells with realizations. Only realizations of ``rows`` go on, so a one-off set of many points stays small.
    ``distinct`` counts distinct whole numbers from 0 on exactly, by bitmaps of 32,768 of them. A realization without facts has no row; a null passes nothing.
    """
    dims = sorted((_dimension(p, on[p.name]) for p in points), key=lambda d: d.cumulative)
    cell = [f"cell_{d.point.name}" for d in dims]
    some = facts.withColumns(dict(zip(cell, (d.cell for d in dims), strict=True))).where(reduce(Column.__and__, (F.col(c) > 0 for c in cell)))
    whole = len(rows) == math.prod(len(p.branches) for p in points)

    def unrolled(cells: DataFrame, merge: Mapping[str, Callable[[str], Column]], extra: Sequence[str] = ()) -> DataFrame:
        done: list[str] = []
        for i, d in enumerate(dims):
            cells = _unrolled(cells, d, [*done, *cell[i + 1 :], *extra], merge)
            done.append(d.point.column)
            if not whole:
                names = [x.point.name for x in dims[: i + 1]]
                kept = sorted({tuple(r[n] for n in names) for r in rows})
                wanted = facts.sparkSession.createDataFrame(kept, ", ".join(f"`{c}` string" for c in done))
                cells = cells.join(wanted, done, "left_semi")
        return cells

    columns = [p.column for p in points]
    plain = [(F.sum, sums), (F.min, mins), (F.max, maxs)]
    parts = []
    if given := {n: (f, v) for f, of in plain for n, v in (of or {}).items()}:
        cells = some.groupBy(*cell).agg(*(f(v).alias(n) for n, (f, v) in given.items()))
        parts.append(unrolled(cells, {n: f for n, (f, _) in given.items()}).select(*columns, *given))
    for n, v in (distinct or {}).items():
        value = v.cast("long")
        bits = some.where(v.isNotNull()).groupBy(*cell, F.floor(value / 32768).alias("bucket_")).agg(F.bitmap_construct_agg(F.pmod(value, F.lit(32768))).alias(n))
        parts.append(unrolled(bits, {n: F.bitmap_or_agg}, ["bucket_"]).groupBy(*columns).agg(F.sum(F.bitmap_count(n)).alias(n)))
    return reduce(lambda a, b: a.join(b, columns, "left"), parts)


def sweep_thresholds(facts: DataFrame, points: Sequence[BranchPoint], rows: Sequence[Mapping[str, str]], on: Mapping[str, str], sums: Mapping[str, Column]) -> DataFrame:
    """Points that all ask ``column >= value``, and sums: ``sweep_cells``."""
    return sweep_cells(facts, points, rows, on, sums)
