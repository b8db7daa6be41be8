"""Order MinHash fingerprints: sketches whose likeness follows the edit distance of texts.

A text's words are cut to k-mers, and the copies of a k-mer are numbered in text order. Each of ``m`` hash functions
selects the ``l`` smallest numbered k-mers; these are put back into text order and hashed as a tuple. Two texts agree
in an entry if the same k-mers are smallest and stand in the same order, so moved text lowers the likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.ragged import mix, spans, split, windows

_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 11


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the number of equal ones before them."""
    order = np.argsort(kmers, kind="stable")
    new = np.concatenate([[True], kmers[order][1:] != kmers[order][:-1]])
    starts = np.flatnonzero(new)
    number = np.empty(len(kmers), np.uint64)
    number[order] = np.arange(len(kmers)) - np.repeat(starts, np.diff(np.append(starts, len(kmers))))
    return mix(kmers + number * np.uint64(0xA24BAED4963EE407))


def sketch(kmers: np.ndarray, m: int, l: int) -> np.ndarray:
    """m 32-bit entries for the k-mer hashes of a text in text order; all alike for a text without any."""
    if not len(kmers):
        return np.zeros(m, np.uint32)
    x = _numbered(kmers)
    rows = np.arange(m)
    value, at = np.full((m, l), 2**64 - 1, np.uint64), np.full((m, l), -1, np.int64)
    for lo in range(0, len(x), _BLOCK):
        h = x[None, lo : lo + _BLOCK] ^ _SEEDS[:m, None]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        for _ in range(min(l, h.shape[1])):
            a = h.argmin(axis=1)
            value, at = np.column_stack([value, h[rows, a]]), np.column_stack([at, lo + a])
            h[rows, a] = 2**64 - 1
        if lo:
            order = np.argsort(value, axis=1, kind="stable")[:, :l]
            value, at = np.take_along_axis(value, order, 1), np.take_along_axis(at, order, 1)
        else:
            value, at = value[:, l:], at[:, l:]
    best = np.full((m, l), -1, np.int64)
    best[:, : at.shape[1]] = np.sort(at, axis=1)
    some = np.where(best >= 0, x[best], np.uint64(0))
    out = _SEEDS[:m].copy()
    for j in range(l):
        out = mix(out ^ some[:, j] + np.uint64(j))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(texts: list[str], m: int, l: int, k: int) -> list[np.ndarray]:
    """Sketches of texts; a text with fewer than k words has one k-mer, all its words."""
    w = split(pa.array(texts, pa.large_string()))
    words, first = w.hashes(), w.first
    all_ = windows(words, k)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        out.append(sketch(all_[a : z - k + 1] if z - a >= k else spans(words, np.array([a]), np.array([z])) if z > a else all_[:0], m, l))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((x == y).mean())


def fingerprints(docs: DataFrame, m: int = 64, l: int = 2, k: int = 2) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint) for every row of ``docs`` (doc_id, text); null counts as the empty text.

    The fingerprint is the sketch in hexadecimal, 8 digits an entry. Equal texts have equal fingerprints. Very long texts are sketched whole; rows
    that repeat have a row each; an empty table gives none; other columns are ignored.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [x or "" for x in part.column("text").to_pylist()]
                prints = [s.astype(">u4").tobytes().hex() for s in sketches(texts, m, l, k)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(prints)], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents dealt so that each part holds a range of doc_ids in descending order and, last, the document after it.

    Columns: part, extra (true for the document that belongs to the next part), doc_id, text. Ranges are cut at approximate
    quantiles of the ids, ``parts`` numbers that the driver holds; only one document for each part is sent twice. A
    null doc_id comes last; rows that repeat a doc_id are ordered by text.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    array = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(array, lambda c: c > F.col("doc_id")))).cast("int")
    dealt = docs.withColumn("part", part)
    firsts = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy("part").collect()
    before = {r.part: firsts[i - 1].part for i, r in enumerate(firsts)}
    tops = F.array(*(F.struct(F.lit(r.part).alias("p"), F.lit(r.top).cast("long").alias("top"), F.lit(before[r.part]).alias("to")) for r in firsts)) if firsts else None
    if tops is None:
        return dealt.select("part", F.lit(False).alias("extra"), "doc_id", "text")
    mine = F.filter(tops, lambda t: (t["p"] == F.col("part")) & t["top"].eqNullSafe(F.col("doc_id")))
    copies = F.when(F.size(mine) > 0, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")), F.struct(mine[0]["to"].alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))))
    rows = dealt.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.part", "c.extra", "doc_id", "text")
    return rows.repartition(len(firsts), "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("text"))


def edit_report(docs: DataFrame, m: int = 64, l: int = 2, k: int = 2) -> DataFrame:
    """Fingerprints of every text and of an edited copy, and how alike they are.

    The edited text has its last floor(n_chars / 2) characters replaced by as many (or all there are) from the start of
    the next document in descending order of doc_id; the last document is followed by the first. Columns: doc_id, n_chars,
    edited_text, fingerprint, edited_fingerprint, near_edited, near_next. Null and empty texts count as ''.
    Very long texts are edited and sketched whole. Rows that repeat a doc_id follow each other by text; a table of one row is its own next; an empty
    one gives no rows; other columns are ignored.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        rows: list[tuple] = []
        waiting: tuple | None = None

        def flush() -> pa.RecordBatch:
            hexed = lambda s: s.astype(">u4").tobytes().hex()
            out = [(d, len(t), e, hexed(s), hexed(es), likeness(s, es), likeness(s, ns)) for (d, t, e, s, ns), es in zip(rows, sketches([r[2] for r in rows], m, l, k), strict=True)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for big in it:
            for lo in range(0, big.num_rows, 64):
                b = big.slice(lo, 64)
                texts = [x or "" for x in b.column("text").to_pylist()]
                meta = zip(b.column("part").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), strict=True)
                for (part, extra, doc_id), text, s in zip(meta, texts, sketches(texts, m, l, k), strict=True):
                    if waiting is not None and waiting[0] == part:
                        _, d, t, own = waiting
                        half = len(t) // 2
                        rows.append((d, t, t[: len(t) - half] + text[:half], own, s))
                    waiting = None if extra else (part, doc_id, text, s)
                if len(rows) >= 64:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(work, schema)
