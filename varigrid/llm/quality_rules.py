"""Quality rules: counts over each whole text, and lines that too many documents of a host share.

Lines are normalised (lower case, single spaces) and hashed. A line is above the limit if it stands in more than
``least`` documents of a host and in more than ``share`` of its documents; documents with equal texts count once, so copies
do not make a line frequent. Lines above the limit are removed, and a document is rejected as depleted if less than ``left`` of its words remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import store
from varigrid.llm.ragged import batches, mix, split, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


def _repeated_words(words: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each text in k-word windows that the text holds twice or more."""
    n = len(words) - k + 1
    inside = np.zeros(len(words), bool)
    if n > 0:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ok = np.flatnonzero(np.arange(n) + k <= first[1:][text[:n]])
        keys = mix(windows(words, k)[ok] ^ mix(text[ok].astype(np.uint64)))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = ok[counts[inverse] > 1]
        for i in range(k):
            inside[twice + i] = True
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[first[1:]] - total[first[:-1]]


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normalised line."""
    x = xxhash.xxh64_intdigest(" ".join(line.lower().split()).encode())
    return x - (1 << 64) if x >= 1 << 63 else x


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, host, fp, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): lines has hash and words of each distinct line."""
    line_type = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = split(b.column("text"))
            off = w.offsets
            points = np.concatenate([[0], np.cumsum(((w.data & 0xC0) != 0x80) & ~np.isin(w.data, list(b" \t\n\x0b\x0c\r")))])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
            dup, lines = [], []
            for text in b.column("text").to_pylist():
                raw = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
                dup.append(len(raw) - len(set(raw)))
                own: dict[int, int] = {}
                for x in raw:
                    h = line_hash(x)
                    own[h] = own.get(h, 0) + len(x.encode().split())
                lines.append([{"h": h, "words": n} for h, n in own.items()])
            counts = [np.diff(w.first), points[off[1:]] - points[off[:-1]], symbols[off[1:]] - symbols[off[:-1]], dup, _repeated_words(w.hashes(), w.first)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "host", "fp")), *(pa.array(x, pa.int64()) for x in counts), pa.array(lines, line_type)], names=["doc_id", "host", "fp", *_STATS, "lines"])

    rows = docs.select("doc_id", F.xxhash64(F.col("source").isNull(), "source").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    return rows.mapInArrow(work, f"doc_id long, host long, fp long, {', '.join(f'{x} long' for x in _STATS)}, lines array<struct<h:long,words:long>>")


def judge(docs: DataFrame, least: int = 5, share: float = 0.01, left: float = 0.3) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, source, text).

    Returns doc_id, fp (hash of the text), the five counts, base_failed (fewer than 50 words, or more than half of them in
    repeated 3-word windows), frequent (hashes of its lines above the limit), n_frequent_words, depleted and kept. A null or empty text has
    no words and fails the base. Null sources are one host. Rows that repeat a doc_id are judged each; very long texts are counted whole; other columns
    are ignored; an empty table gives no rows.
    """
    base = store(text_counts(docs), "counts")
    lines = base.select("doc_id", "host", "fp", F.explode("lines").alias("l")).select("doc_id", "host", "fp", "l.h", "l.words")
    counts = lines.select("host", "h", "fp").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    hosts = base.select("host", "fp").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    frequent = store(counts.join(hosts, "host").where(F.col("n") > share * F.col("documents")).select("host", "h"), "frequent")
    hit = lines.join(frequent, ["host", "h"]).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("fp").alias("fp_"), F.col("host").alias("host_"), F.struct("h", "words").alias("line"))
    hit = hit.groupBy("id", "fp_", "host_").agg(F.collect_set("line").alias("set"))
    rows = base.drop("lines").join(hit, (F.coalesce(base.doc_id, F.lit(0)) == hit.id) & (base.fp == hit.fp_) & (base.host == hit.host_), "left")
    rows = rows.withColumn("frequent", F.coalesce(F.col("set.h"), F.array().cast("array<long>"))).withColumn("n_frequent_words", F.aggregate(F.coalesce(F.col("set.words"), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("depleted", (F.col("n_frequent_words") > 0) & (F.col("n_words") - F.col("n_frequent_words") < left * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).select("doc_id", "fp", *_STATS, "base_failed", "frequent", "n_frequent_words", "depleted", "kept")


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, without their lines above the limit; n_chars follows the text.

    Null and empty texts fail the base and go. Rows that repeat a doc_id are judged each. An empty table gives no rows, very long texts are judged whole, and
    columns of any name are carried along.
    """
    kept = judge(docs, **limits).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", "frequent").dropDuplicates(["id", "fp"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    rows = rows.join(kept, ["id", "fp"])

    @F.pandas_udf("string")
    def without(texts, frequent):
        def keep(text: str, hashes: np.ndarray) -> str:
            gone = set(hashes.tolist())
            return "\n".join(x for x in text.split("\n") if not x.strip(_BLANK) or line_hash(x) not in gone)

        return texts.combine(frequent, lambda t, f: keep(t, f) if len(f) else t)

    rows = rows.select("row", F.when(F.size("frequent") > 0, without("row.text", "frequent")).otherwise(F.col("row.text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
