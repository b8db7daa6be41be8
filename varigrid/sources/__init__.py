"""Sources and sinks: text, globs, manifests, variant tables, summaries, ledger tables, archives."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["task", "realization"]
MANIFEST = "version int, kind string, name string, realization string, task_version int, package_version string, packages array<string>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the plan by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the plan by a Parquet table in the shared folder, which later reads can prune. ``discard`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        fs, p = files(df.sparkSession, df.stored_at)
        fs.delete(p, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_glob(spark: SparkSession, pattern: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """All files that fit a glob, with the file each row came from."""
    return spark.read.format(fmt).options(**options).load(pattern).withColumn("source_file", F.col("_metadata.file_path"))


def write_manifest(df: DataFrame, path: str) -> None:
    """Write manifest rows (kind, name, ...) as tab-separated lines with the kind first."""
    result = F.concat_ws("/", "name", "realization", F.col("task_version").cast("string"))
    line = F.when(F.col("kind") == "package", F.concat_ws("\t", "kind", "name", "package_version")).when(F.col("kind") == "existing", F.concat_ws("\t", "kind", result)).otherwise(F.concat_ws("\t", F.col("kind"), result, F.array_join("packages", " ")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Manifest rows of one version; lines that begin with ``#`` are comments."""
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    r = F.split(F.col("f")[1], "/")
    is_package = F.col("f")[0] == "package"
    packages = F.when(F.col("f")[0] == "todo", F.filter(F.split(F.coalesce(F.get("f", F.lit(2)), F.lit("")), " "), lambda x: x != ""))
    return rows.select(F.lit(version).alias("version"), F.col("f")[0].alias("kind"), F.when(is_package, F.col("f")[1]).otherwise(r[0]).alias("name"), F.when(~is_package, F.get(r, F.lit(1))).alias("realization"), F.when(~is_package, F.get(r, F.lit(2)).try_cast("int")).alias("task_version"), F.when(is_package, F.get("f", F.lit(2))).alias("package_version"), packages.alias("packages"))


def read_history(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """History entries as JSON lines; a corrupt line keeps only what can be read and is counted as ``corrupt``."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    o = Observation("history")
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("corrupt")), o


def write_variants(df: DataFrame, path: str, task: str, version: int, mode: str = "append") -> None:
    """Store a step's rows (with column realization) partitioned by task, realization and version; only written partitions are replaced."""
    rows = df.withColumns({"task": F.lit(task), "version": F.lit(version)})
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("task", "realization", "version").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def ledger_append(path: str, **tables: DataFrame) -> None:
    """Append to the ledger tables tasks, inputs, outputs and params."""
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{path}/{name}")


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    return assemble(*(spark.read.parquet(f"{path}/{n}") for n in ("tasks", "inputs", "outputs", "params")))


def assemble(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, params: DataFrame) -> DataFrame:
    """Each result with its sorted inputs, outputs and parameters as arrays of structs."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c not in KEY)))).alias(name))

    return reduce(lambda a, b: a.join(b, KEY, "left"), [tasks, listed(inputs, "inputs"), listed(outputs, "outputs"), listed(params, "params")])


def ledger_save(name: str, path: str, buckets: int, **tables: DataFrame) -> None:
    """Append to ledger tables ``name_tasks``, ``name_inputs`` and so on of the catalog, kept below ``path`` in buckets by result, sorted: joins of them by result need no shuffle."""
    for kind, df in tables.items():
        df.write.bucketBy(buckets, *KEY).sortBy(*KEY).mode("append").option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")


def ledger_table(spark: SparkSession, name: str, kind: str) -> DataFrame:
    return spark.table(f"{name}_{kind}")


def status_lines(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, params: DataFrame) -> DataFrame:
    """The report of results as rows: task, realization, kind (inputs, outputs or params), place (in the order of the lines, from 1) and line.

    A result may have any number of inputs: they are rows of their own, sorted with spilling, and never one array.
    """
    def listed(df: DataFrame, kind: str) -> DataFrame:
        own = df.join(tasks.select(*KEY), KEY, "left_semi")
        return own.select(*KEY, F.lit(kind).alias("kind"), F.to_json(F.struct(*(c for c in df.columns if c not in KEY))).alias("line"))

    rows = reduce(DataFrame.unionByName, (listed(df, k) for k, df in (("inputs", inputs), ("outputs", outputs), ("params", params))))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy("line")))


def status_report(ledger: DataFrame) -> DataFrame:
    """Assembled results as lines (task, realization, kind, line)."""
    rows = lambda name: F.coalesce(F.transform(name, lambda x: F.struct(F.lit(name).alias("kind"), F.to_json(x).alias("line"))), F.array().cast("array<struct<kind:string,line:string>>"))
    return ledger.select(*KEY, F.explode(F.concat(rows("inputs"), rows("outputs"), rows("params"))).alias("r")).select(*KEY, "r.*")


def _uri(spark: SparkSession, path: str) -> str:
    """A path with its scheme and with signs encoded, as Spark names files."""
    fs, p = files(spark, path)
    return fs.makeQualified(p).toUri().toString().rstrip("/")


def _at(spark: SparkSession, uri: str):
    """The file system of an encoded name, and its path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _below(file: str, root: str) -> str:
    """The part of a file's name after its store's folder, however the two spell the scheme."""
    plain = lambda x: re.sub(r"^\w+:/+", "/", x)
    if not plain(file).startswith(f"{plain(root)}/"):
        raise ValueError(f"{file} is not below {root}")
    return plain(file)[len(plain(root)) :]


def _apply(spark: SparkSession, change: str) -> None:
    """What a prepared change says, new files before old ones. Each file is handled if it is still there, so this can be run again from any point."""
    for r in spark.read.schema("ord int, action string, file string, target string").json(f"{change}/steps").orderBy("ord").collect():
        fs, a = _at(spark, r.file)
        if r.action == "delete":
            fs.delete(a, False)
        elif fs.exists(a):
            _, b = _at(spark, r.target)
            fs.mkdirs(b.getParent())
            if not fs.rename(a, b):
                raise OSError(f"cannot move {r.file} to {r.target}")
    fs, p = files(spark, change)
    fs.delete(p, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish changes of a store that were prepared as a whole, and drop those that were not. ``archive`` and ``purge_store`` do so before they begin."""
    fs, p = files(spark, path)
    for s in fs.listStatus(p):
        change = s.getPath().toString()
        if s.getPath().getName().startswith("_change-"):
            if fs.exists(files(spark, f"{change}/steps/_SUCCESS")[1]):
                _apply(spark, change)
            else:
                fs.delete(s.getPath(), True)


def _take_out(df: DataFrame, keys: DataFrame, path: str, attic: str | None, partitions: Sequence[str]) -> DataFrame:
    """Take the rows of ``keys`` out of a store of partition folders; only files that hold such rows are touched.

    A file all of whose rows go is moved, or deleted; those that keep some are written anew beside the store. All moves and deletions are
    then written down, and only after that carried out, so that a run that was stopped is finished by the next. The driver gets the names of these files.
    """
    spark, on = df.sparkSession, list(keys.columns)
    recover(spark, path)
    spark.catalog.refreshByPath(path)
    read = lambda *where: spark.read.schema(df.schema).option("basePath", path).parquet(*where)
    root, change = _uri(spark, path), f"{path.rstrip('/')}/_change-{uuid.uuid4().hex}"
    to = _uri(spark, attic) if attic else None
    rows, keys = read(path).withColumn("file_", F.col("_metadata.file_path")), stored(keys.distinct())
    hit = rows.join(keys, on, "left_semi").groupBy("file_").agg(F.count(F.lit(1)).alias("gone_"))
    if not set(on) <= set(partitions):
        hit = rows.groupBy("file_").agg(F.count(F.lit(1)).alias("all_")).join(hit, "file_")
    found = [(r.file_, "all_" not in r or r.all_ == r.gone_) for r in hit.collect()]
    whole, split = sorted(f for f, all_ in found if all_), sorted(f for f, all_ in found if not all_)
    steps = [("move", f, to + _below(f, root)) if attic else ("delete", f, "") for f in whole]
    if split:
        some = read(*(_at(spark, f)[1].toString() for f in split))
        parts = {"rest": (some.join(keys, on, "left_anti"), root)} | ({"gone": (some.join(keys, on, "left_semi"), to)} if attic else {})
        for name, (part, into) in parts.items():
            part.write.partitionBy(*partitions).parquet(f"{change}/{name}")
            made = _uri(spark, f"{change}/{name}")
            steps += [("move", f, into + _below(f, made)) for f in spark.read.schema(df.schema).parquet(f"{change}/{name}").inputFiles()]
        steps += [("delete", f, "") for f in split]
    if steps:
        listed = [(i, *s) for i, s in enumerate(steps)]
        spark.createDataFrame(listed, "ord int, action string, file string, target string").coalesce(1).write.json(f"{change}/steps")
        _apply(spark, change)
    discard(keys)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def archive(df: DataFrame, keys: DataFrame, path: str, attic: str, partitions: Sequence[str] = ("task", "realization", "version")) -> DataFrame:
    """Move the rows of ``keys`` from the store at ``path`` to the attic, and return what the store still holds.

    Files without such rows stay as they are. A run after one that was stopped finishes that one first; nothing is moved twice.
    """
    return _take_out(df, keys, path, attic, partitions)


def purge_store(df: DataFrame, victims: DataFrame, path: str, partitions: Sequence[str] = ("task", "realization", "version")) -> DataFrame:
    """Delete the rows of ``victims`` (a closure of lineage) from the store at ``path``, as ``archive`` does but for keeping them, and return the rest."""
    return _take_out(df, victims, path, None, partitions)


def purge(df: DataFrame, victims: DataFrame) -> DataFrame:
    """Rows without the victims and all that depends on them (victims is a closure of lineage)."""
    return df.join(victims, victims.columns, "left_anti")


def concat_sources(dfs: Mapping[str, DataFrame]) -> DataFrame:
    """All rows with the name of their source."""
    return reduce(DataFrame.unionByName, (df.withColumn("source_name", F.lit(n)) for n, df in dfs.items()))


def union_versions(histories: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)
