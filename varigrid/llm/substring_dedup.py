"""Removal of long repeated passages by compaction of a de Bruijn graph over words.

Edges of the graph are windows of ``length`` consecutive words (its nodes are windows one word shorter). A window is
dealt by its minimizer, the smallest hash among its ``seed``-word parts, so that equal windows meet. Consecutive
windows of one document with the same minimizer form a run, a nonbranching stretch of that document's walk through
the graph. Three joins compact the runs:

1. a minimizer that occurs once starts no repeated path; its run is done;
2. if every occurrence of a minimizer lies in the same run of words, the whole run is one repeated nonbranching path;
   so is a run whose words occur twice as a whole;
3. only where paths branch are the runs unpacked to single edges, which are counted one by one.

Source coordinates (document, word position) carried by every run turn repeated edges back into spans of the
documents, and overlapping spans join to the long repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import discard, store
from varigrid.llm.ragged import batches, spans, split, windows

SEED = 6


def _leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of every w consecutive values, the first of equals."""
    n = len(x) - w + 1
    value, at, width = x, np.arange(len(x)), 1
    while width < w:
        step = min(width, w - width)
        left = value[:-step] <= value[step:]
        value, at = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:])
        width += step
    return at[:n]


def runs(words: np.ndarray, first: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Text index, start, number of windows, minimizer and whole hash of every run of windows that share a minimizer."""
    n = len(words) - length + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    part = windows(words, seed)
    at = _leftmost_min(part, length - seed + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + length <= first[1:][text]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    end = np.flatnonzero(last) + 1
    return text[start], start, end - start, part[at[start]], spans(words, start, end + length - 1)


def document_runs(docs: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """One row per run: id and fp of the document, at (first word), n (windows), minimizer, run (hash of all its words)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = split(b.column("text"))
            text, start, n, minimizer, run = runs(w.hashes(), w.first, length, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(text)), b.column("fp").take(pa.array(text)), pa.array(start - w.first[text], pa.int32()), pa.array(n, pa.int32()), pa.array(minimizer.view(np.int64)), pa.array(run.view(np.int64))],
                names=["id", "fp", "at", "n", "minimizer", "run"],
            )

    return docs.mapInArrow(work, "id long, fp long, at int, n int, minimizer long, run long")


def _single_edges(texts: DataFrame, length: int) -> DataFrame:
    """Unpack the runs in ``open`` to one row per window: its hash and where it starts."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = split(b.column("text"))
            edge = windows(w.hashes(), length)
            lists = b.column("open")
            off, flat = np.asarray(lists.offsets), lists.values
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            inner = slice(int(off[0]), int(off[-1]))
            at, n = np.asarray(flat.field("at"))[inner].astype(np.int64), np.asarray(flat.field("n"))[inner].astype(np.int64)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos, row = np.repeat(at, n) + step, np.repeat(row, n)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("fp").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(edge[w.first[row] + pos].view(np.int64))], names=["id", "fp", "at", "edge"])

    return texts.mapInArrow(work, "id long, fp long, at int, edge long")


def _without_spans(texts: DataFrame, length: int) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = [[], [], [], []]
            for text, cover in zip(b.column("text"), b.column("cover"), strict=True):
                words = (text.as_py() or "").encode().split()
                spans_, gone = [], np.zeros(len(words) + 1, np.int32)
                for c in cover.as_py() or ():
                    gone[c["at"]] += 1
                    gone[c["at"] + c["n"] - 1 + length] -= 1
                gone = gone[:-1].cumsum() > 0
                if gone.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    spans_ = [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]
                    words = [words[i] for i in np.flatnonzero(~gone)]
                for column, x in zip(out, (len(gone), int(gone.sum()), spans_, b" ".join(words).decode()), strict=True):
                    column.append(x)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(span), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return texts.mapInArrow(work, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")


def remove_repeated_passages(docs: DataFrame, length: int = 35, seed: int = SEED) -> DataFrame:
    """Remove every word that lies in a window of ``length`` words whose words also start anywhere else.

    Returns, for every row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans (removed word ranges, end
    exclusive) and kept_text (the kept words joined by one space). Windows are judged on the input. Null and empty
    texts have no words and give 0, 0, [] and ''. Rows that repeat a text, with the same doc_id or another, are
    occurrences of their own, so all their windows repeat. An empty table gives no rows, other columns are ignored, and very long texts are cut
    nowhere. Windows are compared by 64-bit hashes of their words, and the hash decides: words are not looked at again. Shuffled data: about one row of 30 bytes for 12 words, then the texts once.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    found = document_runs(keyed.select("id", "fp", "text"), length, seed)
    paths = found.groupBy("minimizer").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("a"), F.max("run").alias("z")).where("c > 1").select("minimizer", (F.col("a") != F.col("z")).alias("branches"))
    paths = store(paths, "minimizers")  # as a table, so that a frequent minimizer is split in the join
    repeated = store(found.join(paths, "minimizer").select("id", "fp", "at", "n", "run", "branches"), "paths")
    discard(paths)
    here = F.struct("id", "fp", "at")
    whole = store(repeated.where("branches").groupBy("run").agg(F.count(F.lit(1)).alias("times"), F.min(here).alias("one")), "whole")  # a frequent run likewise
    branching = repeated.where("branches").join(whole, "run").select("id", "fp", "at", "n", (F.col("times") > 1).alias("sure"), ((F.col("times") == 1) | (F.col("one") == here)).alias("unpack"))
    plain = repeated.where("NOT branches").select("id", "fp", "at", "n", F.lit(True).alias("sure"), F.lit(False).alias("unpack"))
    marked = store(plain.unionByName(branching), "marked")
    discard(repeated, whole)
    run = F.struct("at", "n")
    # Rows that repeat an id and a text have the same runs, so a set holds them once and no more than the text has.
    unpack = store(marked.where("unpack").groupBy("id", "fp").agg(F.collect_set(run).alias("open")), "unpack")
    edges = _single_edges(keyed.join(unpack, ["id", "fp"]).select("doc_id", "id", "fp", "text", "open"), length)
    again = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("edge")
    single = edges.join(again, "edge").select("id", "fp", "at", F.lit(1).alias("n"))
    cover = marked.where("sure").select("id", "fp", "at", "n").unionByName(single).groupBy("id", "fp").agg(F.collect_set(run).alias("cover"))
    cover = store(cover, "cover")
    discard(marked, unpack)
    return _without_spans(keyed.join(cover, ["id", "fp"], "left").select("doc_id", "text", "cover"), length)
