"""A corpus from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm import jaccard_join, line_templates, mixing, packing, quality_rules
from varigrid.llm.common import new_path, store, table
from varigrid.llm.url_filter import divide

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines that too many documents of a host share go from the others.

    Null and empty texts are rejected; rows that repeat a doc_id are judged each, very long texts whole; an empty table stays empty. Columns beyond
    those of documents are left out.
    """
    return quality_rules.clean(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but no document does.

    A null text stays null and an empty one empty; rows that repeat a doc_id are handled each, very long texts line by line; an empty table stays
    empty. Columns beyond those of documents are left out.
    """
    out = line_templates.drop_recurring(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Of rows that repeat that doc_id with one text, the one with the smallest lang and source stays; a group without any doc_id stays whole. Null and empty
    texts are no duplicates of anything, though rows that repeat one doc_id without words become one; very long texts are compared whole; an
    empty table stays empty. Columns beyond those of documents are left out. Documents that go or repeat are few; a Bloom
    filter of bounded size passes them and a few others to the joins, and the rest needs none.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard_join.near_duplicates(docs, 5, 80, split_=1, sub=1)
    goes = F.coalesce((F.col("doc_id") != F.col("component_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNotNull()), F.lit(False))
    found = groups.groupBy("doc_id", "fp").agg(F.bool_or(goes).alias("goes"), F.count(F.lit(1)).alias("n"))
    found = found.where("goes OR (n > 1 AND doc_id IS NOT NULL)").select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "fp").alias("key"), F.col("doc_id").alias("id"), F.col("fp").alias("fp_"), "goes")
    found = store(found, "found")
    rows = docs.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "fp"))
    some, none = divide(rows, "key", found)
    some = some.join(found.withColumnRenamed("key", "key_"), (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("fp_")), "left").where("goes IS NULL OR NOT goes")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = some.where("goes IS NOT NULL").groupBy("doc_id", "fp").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", *(f"r.{c}" for c in rest))
    return none.select(*COLUMNS).unionByName(some.where("goes IS NULL").select(*COLUMNS)).unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often and as much as the mix takes of it: whole texts, and the text of the selected blocks.

    Null and empty texts have no words and are not taken; tied rows (one doc_id, text and source) share a place in the plan, of which the earliest stands
    for all; very long texts are cut by blocks of words like any other; an empty table stays empty. Columns beyond those of documents are left out.
    """
    block = 64
    docs = docs.select(*COLUMNS)
    plan = mixing.mix(docs, block=block).where("taken > 0").select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_"), F.col("source").alias("source_"), F.struct("low", "repeats", "once", "blocks", "shift").alias("p"))
    plan = plan.groupBy("id_", "fp_", "source_").agg(F.min("p").alias("p")).select("id_", "fp_", "source_", "p.*")
    keyed = docs.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_")) & F.col("source").eqNullSafe(F.col("source_")))
    rows = rows.select(*COLUMNS, F.explode(F.sequence(F.lit(0), "repeats")).alias("pass_"), "repeats", "low", "once", "blocks", "shift")
    rows = rows.where("pass_ < repeats OR once > 0")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from varigrid.llm.ragged import batches, split

        for b in batches(it):
            w = split(b.column("text"))
            out = b.column("text").to_pylist()
            for i, r in enumerate(b.select(["pass_", "repeats", "low", "once", "blocks", "shift"]).to_pylist()):
                if r["pass_"] < r["repeats"]:
                    continue
                a, z = int(w.first[i]), int(w.first[i + 1])
                at = (r["low"] + np.arange(z - a)) // block
                taken = ((at + 1) * r["once"] + r["shift"]) // r["blocks"] > (at * r["once"] + r["shift"]) // r["blocks"]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], taken, [False]])))
                parts = [w.data[w.starts[a + s] : w.ends[a + e - 1]].tobytes() for s, e in zip(edge[::2], edge[1::2], strict=True)]
                out[i] = b"\n".join(parts).decode() if parts else None
            keep = pa.array([x is not None for x in out])
            text = pa.array(out, pa.string())
            n = pa.array([len(x) if x is not None else None for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (b.column("doc_id"), text, b.column("lang"), b.column("source"), n)], names=COLUMNS)

    return rows.mapInArrow(work, "doc_id long, text string, lang string, source string, n_chars long")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 tokens: where each piece of each document goes, and its ids.

    Null and empty texts are the end id alone; rows that repeat are packed each; only texts of more than 1024 tokens are cut; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing_stage), ("packing", packed)]
#: Tokenizing and near-duplicate groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
