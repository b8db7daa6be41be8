"""One query per operator, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm import alignment, decontamination, jaccard_join, line_templates, merkle, mixing, order_minhash, packing, quality_rules, substring_dedup, token_files, url_filter, warc
from varigrid.llm.common import lower_ascii, table
from varigrid.llm.sql import ORACLES

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: Pages of fewer characters count as thin; their canonical URLs make the list.
THIN = 1500


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks the canonical URLs under which a thin page was seen, beside the fixed rules."""
    pages = table(spark, sf_dir, "pages")
    thin = pages.where(F.length(F.coalesce("html", F.lit(""))) < THIN)
    listed = thin.select(url_filter.canonical(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("canonical"))
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("ids")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.edit_report(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether it holds after some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, merkle.leaf(fields(lower_ascii(F.col("text")))))
    m = merkle.build(docs, "source", [F.col("doc_id")], merkle.leaf(fields(F.col("text"))), {"doc_id": F.col("doc_id"), "claim": claim})

    def made(leaf: str, path: list, carried: dict) -> dict:
        return {"doc_id": carried["doc_id"], "proof_sha256": merkle.proof_digest(path), "folded_root": merkle.folded(carried["claim"] or leaf, path)}

    rows = merkle.proofs(m, made, "doc_id long, proof_sha256 string, folded_root string")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_quality_rules, op3_jaccard_join, op4_token_files, op5_line_templates, op6_warc, op7_packing, op8_order_minhash, op9_mixing, op10_substring_dedup, op11_merkle_manifest, op12_token_alignment, op13_decontamination)}
__all__ = ["ORACLES", "QUERIES"]
