"""The run ledger: states of results, reuse, versions, changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.functions import exit_ok
from varigrid.operators import summary

KEY = ["task", "realization"]


def incomplete_reason() -> Column:
    """Why a ledger row is not complete, the first of the checks that fails; null if it is complete."""
    checks = [(F.col("has_dir"), "no output folder"), (F.col("exit_code").isNotNull(), "no exit code"), (exit_ok(F.col("exit_code")), "bad exit code"), (F.col("has_stdout"), "no stdout"), (F.col("has_stderr"), "no stderr"), (~F.col("invalidated"), "invalidated"), (F.col("outputs_exist"), "an output is missing")]
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks))


def classify(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """planned (task, realization) with state: complete, else locked, broken, partial or fresh, in this order."""
    state = (
        F.when(F.col("has_dir").isNotNull() & incomplete_reason().isNull(), "complete")
        .when(F.coalesce("locked", F.lit(False)), "locked")
        .when(F.coalesce(F.col("has_dir") & ~F.col("has_version_file"), F.lit(False)), "broken")
        .when(F.coalesce("has_dir", F.lit(False)), "partial")
        .otherwise("fresh")
    )
    return planned.join(ledger, KEY, "left").select(*planned.columns, state.alias("state"), *(["version"] if "version" in ledger.columns else []))


def todo(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.join(completed, KEY, "left_anti")


def reused(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.join(completed, KEY, "left_semi")


def work_plan(classified: DataFrame) -> DataFrame:
    """How many results to reuse, wait for, delete, archive or run."""
    action = F.create_map(*(F.lit(x) for kv in {"complete": "reuse", "locked": "wait", "broken": "delete", "partial": "archive", "fresh": "run"}.items() for x in kv))
    return classified.groupBy(action[F.col("state")].alias("action")).agg(F.count(F.lit(1)).alias("n"))


def latest_version(history: DataFrame) -> DataFrame:
    """The row of the highest version of each result."""
    rest = [c for c in history.columns if c not in KEY]
    return history.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*KEY, "r.*")


def next_version(history: DataFrame) -> DataFrame:
    return history.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def assign_versions(classified: DataFrame, next_: int) -> DataFrame:
    return classified.withColumn("version", F.when(F.col("state") == "complete", F.col("version")).otherwise(F.lit(next_)))


def mark_done(keys: DataFrame, completed: DataFrame) -> DataFrame:
    """Rows to append for results that are to count as complete and do not yet."""
    return todo(keys, completed).withColumn("status", F.lit("done"))


def bind_versions(edges: DataFrame, versions: DataFrame, current: int) -> DataFrame:
    """Version that feeds each input; inputs without a source take the current one."""
    v = versions.select(F.col("task").alias("src_task"), F.col("realization").alias("src_realization"), F.col("version").alias("src_version"))
    return edges.join(v, ["src_task", "src_realization"], "left").withColumn("src_version", F.coalesce("src_version", F.lit(current)))


def package_deps(todo_: DataFrame, uses: DataFrame, versions: DataFrame) -> DataFrame:
    return todo_.join(uses, "task").join(versions, "package")


def tools_needed(todo_: DataFrame, uses: DataFrame) -> DataFrame:
    return todo_.select("task").distinct().join(uses, "task").select("package").distinct()


def stale_versions(required: DataFrame, built: DataFrame, refresh: bool = False) -> DataFrame:
    """Required (package, version) with status built or build, and head: the version built last."""
    head = built.groupBy("package").agg(F.max_by("version", "built_at").alias("head"))
    have = built.select("package", "version").distinct().withColumn("have", F.lit(True))
    status = F.when(F.col("have") & F.lit(not refresh), "built").otherwise("build")
    return required.join(have, ["package", "version"], "left").join(head, "package", "left").select("package", "version", status.alias("status"), "head")


def versions_by_tool(built: DataFrame) -> DataFrame:
    return built.groupBy("package").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def version_report(manifest: DataFrame) -> DataFrame:
    """Entries of each version and kind, sorted."""
    entry = F.concat_ws("/", "name", "realization", F.col("task_version").cast("string"))
    return manifest.groupBy("version", "kind").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def changed_files(listing: DataFrame, snapshot: DataFrame, digest: Column) -> DataFrame:
    """Files (path, size, modified, ...) that differ from the snapshot: change is new or changed.

    Only rows whose size or time differ are digested.
    """
    s = snapshot.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("digest").alias("old_digest"))
    rows = listing.join(s, "path", "left").where(F.col("old_size").isNull() | (F.col("size") != F.col("old_size")) | (F.col("modified") != F.col("old_modified")))
    rows = rows.withColumn("digest", digest).where(F.col("old_digest").isNull() | (F.col("digest") != F.col("old_digest")))
    return rows.withColumn("change", F.when(F.col("old_digest").isNull(), "new").otherwise("changed"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table: the sum of 60-bit row digests, exact whatever the order."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("decimal(38,0)").alias("digest"))


def listed_files(spark: SparkSession, *patterns: str) -> DataFrame:
    """Files (path, size, modified) that fit some patterns; no content is read."""
    return spark.read.format("binaryFile").load(list(patterns)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, *patterns: str, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Files (path, size, modified, digest) with the digest of their content, each read whole by one task; files of 2 GB and more are an error."""
    rows = spark.read.format("binaryFile").load(list(patterns))
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), digest(F.col("content")).alias("digest"))


def changed_on_disk(spark: SparkSession, snapshot: DataFrame, *patterns: str, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Files that differ from a snapshot (path, size, modified, digest): path, size, modified, digest, change (new, changed or gone).

    Sizes and times are compared first, on a listing without content. Only files for which they differ are read, as a list of their own, so the others do
    not come into that scan; a file with a new time and the old content has not changed. The driver gets the names of files to read.
    """
    before = snapshot.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("digest").alias("old_digest"))
    here = listed_files(spark, *patterns).join(before, "path", "full")
    stale = here.where(F.col("size").isNotNull() & ~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified"))))
    paths = sorted(r.path for r in stale.select("path").collect())
    gone = here.where("size IS NULL").select("path", F.col("old_size").alias("size"), F.col("old_modified").alias("modified"), F.col("old_digest").alias("digest"), F.lit("gone").alias("change"))
    if not paths:
        return gone
    read = file_digests(spark, *paths, digest=digest).join(before.select("path", "old_digest"), "path", "left")
    change = F.when(F.col("old_digest").isNull(), "new").otherwise("changed")
    return read.where("old_digest IS NULL OR digest <> old_digest").select("path", "size", "modified", "digest", change.alias("change")).unionByName(gone)


def version_rows(manifest: DataFrame) -> DataFrame:
    """Entries of each version and kind as rows in order: version, kind, place (from 1), entry."""
    entry = F.concat_ws("/", "name", "realization", F.col("task_version").cast("string"))
    # A version has few kinds, so places come from ranks over ranges of all rows, less the ranks before their kind's first.
    rows = summary.ranked(manifest.select("version", "kind", entry.alias("entry")), [("version", "text", False), ("kind", "text", False), ("entry", "text", False)])
    first = rows.groupBy("version", "kind").agg(F.min("rank").alias("first_")).select(F.col("version").alias("v_"), F.col("kind").alias("k_"), "first_")
    placed = rows.join(first, F.col("version").eqNullSafe(F.col("v_")) & F.col("kind").eqNullSafe(F.col("k_")))
    return placed.select("version", "kind", (F.col("rank") - F.col("first_") + 1).cast("int").alias("place"), "entry")
