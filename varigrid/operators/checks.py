"""Checks of keys, references and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task groups by key at most, about.
ROWS = 2_000_000


def check_branch_sets(defs: DataFrame) -> DataFrame:
    """Branch points whose definitions (branch_point, definition, branch, ord) differ in branches or baseline."""
    each = defs.groupBy("branch_point", "definition").agg(F.array_sort(F.collect_set("branch")).alias("branches"), F.min_by("branch", "ord").alias("baseline"))
    return each.groupBy("branch_point").agg(F.count_distinct("branches").alias("n_sets"), F.count_distinct("baseline").alias("n_baselines")).where("n_sets > 1 OR n_baselines > 1")


def missing_keys(facts: DataFrame, required: DataFrame, by: str, key: str) -> DataFrame:
    """Required keys that a group lacks. Groups that have as many of them as there are end after a count; the others alone meet the list of keys, of which they lack some."""
    keys, each = required.select(key).distinct(), facts.select(by, key).distinct()
    have = each.join(keys, key, "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    short = facts.select(by).distinct().join(have, by, "left").where(F.coalesce("n_", F.lit(0)) < F.lit(keys.count())).select(by)
    return short.crossJoin(keys).join(each, [by, key], "left_anti")


def check_keys(fact: DataFrame, dim: DataFrame, key: str, mode: str = "warn") -> DataFrame:
    """Fact keys without a dimension row (undeclared) and dimension keys without facts (unused), tagged with the severity."""
    if mode not in ("ignore", "warn", "error"):
        raise ValueError("mode is ignore, warn or error")
    rows = fact.select(key, F.lit(True).alias("f_"), F.lit(False).alias("d_")).unionAll(dim.select(key, F.lit(False), F.lit(True)))
    # Keys are so small in a shuffle that Spark would put many millions of them into one task.
    n = max(int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
    each = rows.repartition(n, key).groupBy(key).agg(F.bool_or("f_").alias("f_"), F.bool_or("d_").alias("d_"))
    alone = F.col(key).isNull()  # null equals nothing
    problems = F.filter(F.array(F.when(F.col("f_") & (~F.col("d_") | alone), "undeclared"), F.when(F.col("d_") & (~F.col("f_") | alone), "unused")), lambda x: x.isNotNull())
    both = each.select(key, F.explode(problems).alias("problem"))
    return both.withColumn("severity", F.lit(mode)).where(F.lit(mode != "ignore"))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve_refs(refs: DataFrame, defs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """References with exactly one definition, and the others with the number they found."""
    n = defs.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    counted = refs.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return counted.where("found = 1").drop("found").join(defs, key), counted.where("found <> 1")


def multiset(deltas: DataFrame, *key: str) -> DataFrame:
    """Counts after additions and removals (delta); a negative count is tagged as an error."""
    return deltas.groupBy(*key).agg(F.sum("delta").alias("n")).where("n <> 0").withColumn("error", F.col("n") < 0)


def multiset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def multiset_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def missing_inputs(required: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return required.join(listing, key, "left_anti")
