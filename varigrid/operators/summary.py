"""Gathering over branches and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varigrid.operators.variants import VariantFrame
from varigrid.sources import stored

MISSING = "--"


def gather(vf: VariantFrame, points: Sequence[str], value: str, sep: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per realization of the other points with the values of all branches of ``points``, in branch order."""
    order = []
    for p in points:
        names = F.array(*(F.lit(b) for b in vf.points[p].branches))
        order.append(F.array_position(names, F.col(vf.points[p].column)).alias(f"o_{p}"))
    rest = [b.column for n, b in sorted(vf.points.items()) if n not in points]
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    values = F.transform(rows, lambda x: x["v"])
    return vf.df.groupBy(*rest, *keys).agg((F.array_join(values, sep) if sep is not None else values).alias(value))


def summarize(metrics: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per realization and one column per metric label, in label order, ``--`` where missing."""
    labels = sorted(labels)
    wide = metrics.groupBy(*by).pivot("label", labels).agg(F.first("value"))
    return wide.select(*by, *(F.coalesce(F.col(f"`{x}`"), F.lit(MISSING)).alias(x) for x in labels))


def branch_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct branches of each point, one row per point, and whether it is constant."""
    wide = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c.removeprefix("bp_")).alias("branch_point"), F.col(c).alias("n_branches")) for c in columns)))
    return wide.select(rows.alias("r")).select("r.*").withColumn("constant", F.col("n_branches") <= 1)


def split_constant(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame without points that have one branch only, and their columns. The driver gets one number per point."""
    constant = [f"bp_{r.branch_point}" for r in branch_counts(df, columns).collect() if r.constant]
    return df.drop(*constant), constant


def check_cells(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells that were written more than once."""
    return metrics.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("writes")).where("writes > 1")


def completed_only(metrics: DataFrame, completed: DataFrame) -> DataFrame:
    return metrics.join(completed, ["task", "realization"], "left_semi")


def metric(df: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    """Aggregates of each realization as long rows (by, label, value)."""
    wide = df.groupBy(*by).agg(*(v.alias(k) for k, v in values.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).cast("string").alias("value")) for k in values)))
    return wide.select(*by, rows.alias("m")).select(*by, "m.*")


def first_row(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first row in the order of some columns, of all or of each group; an empty table has none."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r_"))
    return first.where("r_ IS NOT NULL").select(*by, "r_.*")


def _sort_keys(keys: Sequence[tuple[str, str, bool]]) -> list[Column]:
    cols = [F.col(c).cast("double") if kind == "number" else F.col(c).cast("string") for c, kind, _ in keys]
    return [c.desc() if down else c.asc() for c, (_, _, down) in zip(cols, keys, strict=True)]


def tabular(df: DataFrame, keys: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Sort by several keys (column, ``text`` or ``number``, descending). Text sorts by its UTF-8 bytes."""
    return df.orderBy(*_sort_keys(keys))


def ranked(df: DataFrame, keys: Sequence[tuple[str, str, bool]], name: str = "rank") -> DataFrame:
    """Add each row's place in the order of some keys, from 1, as the column ``name``; rows that tie in all keys follow by all their columns.

    Rows are dealt by ranges of the keys and sorted in many tasks; a row's place is that in its range plus the rows of the ranges before, of
    which there is one number each. The sorted rows are written as a table of the shared folder, so that the ranges stay what they are.
    """
    order = [*_sort_keys(keys), *(F.col(c).asc() for c in df.columns)]
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33).alias("part_")  # the high bits are the range, the low 33 the place in it
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n_")).withColumn("all_", F.lit(0))
    before = F.sum("n_").over(Window.partitionBy("all_").orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    starts = stored(counts.select("part_", before.alias("before_")))
    place = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("part_", F.shiftright("at_", 33)).join(starts, "part_").select(*df.columns, place.alias(name))


def tabular_lines(lines: DataFrame, keys: Sequence[tuple[int, str, bool]], sep: str = r"\s+") -> DataFrame:
    """Lines (line, at: their order in the file) as part, place and line: ``comment`` lines begin with #, in file order; the first other line is the ``header``; ``row`` lines
    are sorted by keys (column from 1, ``text`` or ``number``, descending), then by the line, all in byte order. A field that a line lacks is empty; one that is no number counts as 0.
    """
    rest = lines.where(~F.startswith("line", F.lit("#")))
    first = rest.agg(F.min("at").alias("at")).first().at
    fields = F.split(F.trim("line"), sep)
    text = lambda n: F.coalesce(F.get(fields, F.lit(n - 1)), F.lit(""))
    number = lambda n: F.coalesce(text(n).try_cast("double"), F.lit(0.0))
    body = rest.where(F.col("at") > F.lit(first)).select("line", *((number(n) if kind == "number" else text(n)).alias(f"k{i}") for i, (n, kind, _) in enumerate(keys)))
    rows = ranked(body, [(f"k{i}", kind, down) for i, (_, kind, down) in enumerate(keys)] + [("line", "text", False)], "place")
    comments = ranked(lines.where(F.startswith("line", F.lit("#"))).select("at", "line"), [("at", "number", False)], "place")
    tagged = lambda df, part: df.select(F.lit(part).alias("part"), "place", "line")
    header = rest.where(F.col("at") == F.lit(first)).withColumn("place", F.lit(1).cast("long"))
    return tagged(comments, "comment").unionByName(tagged(header, "header")).unionByName(tagged(rows, "row"))
