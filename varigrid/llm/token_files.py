"""Token files: shards of documents in doc_id order, each compressed by a Re-Pair grammar of its own.

A shard is one row of a Parquet table: part and inside (ids before the shard in its part), tokens (ids in it), doc_ids, lengths (ids per document), ends
(end of each document in the compressed sequence), rules (pairs of symbols), sizes (expansion length of each rule) and
sequence. All arrays are little-endian. Symbols under ``BASE`` are token ids, symbol BASE + i is rule i. The sequence
is compressed without pairs across documents, so a document is decoded from its own part of it alone; the expansion
lengths lead to any token within it without expanding what lies before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import new_path
from varigrid.llm.tokens import documents

#: Symbols from here on are rules.
BASE = 1 << 24
#: Pairs are counted by 2 ** _CELLS cells of their hashes before they are counted one by one.
_CELLS = 18


def re_pair(ids: np.ndarray, ends: np.ndarray, least: int = 4, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their expansion lengths, the compressed sequence and the documents' ends in it.

    Each round counts all pairs of neighbours within documents and replaces, from the left, the most frequent ones (``most`` at a time, each
    seen ``least`` times or more) by new symbols. It goes on until no pair is that frequent; every round shortens the sequence.
    Overlapping pairs of a round take occurrences from each other, so at last rules are taken back that no rule and at most one place of the sequence uses.
    """
    seq, rules, rounds = ids.astype(np.int64), np.empty((0, 2), np.int64), [0]
    ends = ends.astype(np.int64)
    while len(seq) > 1:
        pair = (seq[:-1] << 32) | seq[1:]
        cell = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _CELLS)).view(np.int64)
        borders = ends[(ends > 0) & (ends < len(seq))] - 1
        pair[borders] = -1
        maybe = np.bincount(cell, minlength=1 << _CELLS)[cell] >= least
        maybe[borders] = False
        kinds, counts = np.unique(pair[maybe], return_counts=True)
        kinds, counts = kinds[counts >= least], counts[counts >= least]
        if not len(kinds):
            break
        top = kinds[np.argsort(-counts, kind="stable")[:most]]
        # Of pairs in one cell, the most frequent goes now and the others in later rounds.
        top_cell = (top.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _CELLS)).view(np.int64)
        top_cell, first = np.unique(top_cell, return_index=True)
        new = top[first]
        at = np.zeros(1 << _CELLS, np.int32)
        at[top_cell] = np.arange(len(new))
        at = at[cell]
        hit = np.flatnonzero(new[at] == pair)
        run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
        symbol = BASE + len(rules) + at[hit]
        rules = np.concatenate([rules, np.column_stack([new >> 32, new & 0xFFFFFFFF])])
        rounds.append(len(rules))
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq[hit] = symbol
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        seq = seq[keep]
    return _without_idle_rules(rules, rounds, seq, ends)


def _without_idle_rules(rules: np.ndarray, rounds: list[int], seq: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take back rules that no rule and at most one place of the sequence uses, number the others anew and add the expansion lengths."""
    n = len(rules)
    if not n:
        return rules, np.empty(0, np.int64), seq, ends
    uses = lambda x, weights=None: np.bincount(x[x >= BASE] - BASE, weights, n).astype(np.int64)
    placed, inner, idle, sizes = uses(seq), uses(rules.ravel()), np.zeros(n, bool), np.empty(n, np.int64)
    for lo, hi in zip(rounds[-2::-1], rounds[:0:-1], strict=True):  # a rule is used by those of later rounds alone
        idle[lo:hi] = (inner[lo:hi] == 0) & (placed[lo:hi] < 2)
        back = rules[lo:hi][idle[lo:hi]].ravel()
        inner -= uses(back)
        placed += uses(back, np.repeat(placed[lo:hi][idle[lo:hi]], 2)[back >= BASE])
    for lo, hi in zip(rounds, rounds[1:], strict=False):
        inside = rules[lo:hi]
        sizes[lo:hi] = np.where(inside >= BASE, sizes[np.maximum(inside - BASE, 0)], 1).sum(axis=1) if lo else 2
    rule = lambda: np.maximum(seq - BASE, 0)
    while (gone := (seq >= BASE) & idle[rule()]).any():
        ends = np.concatenate([[0], np.cumsum(1 + gone)])[ends]
        at = np.cumsum(1 + gone) - 1 - gone
        out = np.empty(len(seq) + gone.sum(), np.int64)
        out[at] = np.where(gone, rules[rule(), 0], seq)
        out[at[gone] + 1] = rules[seq[gone] - BASE, 1]
        seq = out
    number = BASE + np.cumsum(~idle) - 1
    renumber = lambda x: np.where(x >= BASE, number[np.maximum(x - BASE, 0)], x)
    return renumber(rules[~idle]), sizes[~idle], renumber(seq), ends


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Token ids of compressed symbols."""
    flat, owner = rules.astype(np.int64).ravel(), np.repeat(np.arange(len(rules)), 2)
    while (big := flat >= BASE).any():
        width = np.where(big, 2, 1)
        at = np.cumsum(width) - width
        new = np.empty(int(width.sum()), np.int64)
        new[at[~big]] = flat[~big]
        new[at[big]], new[at[big] + 1] = rules[flat[big] - BASE].T
        flat, owner = new, np.repeat(owner, width)
    sizes = np.bincount(owner, minlength=len(rules))
    # Every symbol is a stretch of this array: its rule's expansion, or itself.
    source = np.concatenate([flat, symbols])
    start, count = len(flat) + np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    big = np.flatnonzero(symbols >= BASE)
    rule = symbols[big].astype(np.int64) - BASE
    start[big], count[big] = (np.cumsum(sizes) - sizes)[rule], sizes[rule]
    after = np.cumsum(count)
    return source[np.arange(after[-1] if len(after) else 0) + np.repeat(start - after + count, count)]


def decode(shard: dict, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a document of a shard; symbols outside are skipped by their expansion lengths."""
    read = lambda name, kind: np.frombuffer(shard[name], kind).astype(np.int64)
    ends, rules, sizes = read("ends", "<u4"), read("rules", "<u4").reshape(-1, 2), read("sizes", "<u4")
    part = read("sequence", "<u4")[ends[document - 1] if document else 0 : ends[document]]
    size = np.ones(len(part), np.int64)
    size[part >= BASE] = sizes[part[part >= BASE] - BASE]
    after = np.cumsum(size)
    stop = int(after[-1]) if stop is None else min(stop, int(after[-1]))
    if start >= stop:
        return np.empty(0, np.int64)
    a, z = int(np.searchsorted(after, start, "right")), int(np.searchsorted(after, stop, "left")) + 1
    skipped = int(after[a - 1]) if a else 0
    return expand(part[a:z], rules)[start - skipped : stop - skipped]


_FILE = "part int, inside long, tokens long, doc_ids binary, nulls binary, lengths binary, ends binary, rules binary, sizes binary, sequence binary"


def write(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = 1 << 18, **re_pair_options: int) -> None:
    """Encode every document of ``docs`` (doc_id, text) and write the token files to ``path``, in ascending doc_id order.

    A null text counts as empty: the end id alone. Documents without an id come first; rows that repeat a doc_id follow each other, in one task
    in the order of their texts. An empty table writes no shard; other columns are ignored. A very long text is one document of its shard: a
    shard ends with the document that brings it to ``shard_tokens`` ids.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, part, ids, doc_ids, total = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], np.int64)
            rules, sizes, seq, ends = re_pair(np.concatenate(ids), np.cumsum(lengths), **re_pair_options)
            known = np.array([0 if x is None else x for x in doc_ids], "<i8")
            binary = [known.tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), *(x.astype("<u4").tobytes() for x in (lengths, ends, rules, sizes, seq))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([inside], pa.int64()), pa.array([total], pa.int64()), *(pa.array([x], pa.binary()) for x in binary)], names=["part", "inside", "tokens", "doc_ids", "nulls", "lengths", "ends", "rules", "sizes", "sequence"])

        for b, i, tokens in documents(it, tokenizer):
            part = b.column("part")[i].as_py()
            ids.append(tokens)
            doc_ids.append(b.column("doc_id")[i].as_py())
            total += len(tokens)
            if total >= shard_tokens:
                yield flush()
                inside, ids, doc_ids, total = inside + total, [], [], 0
        if ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(work, _FILE).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Every document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    Only the number of ids of each written partition, one row per file, reaches the driver.
    """
    files = spark.read.schema(_FILE).parquet(path)
    before, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                ids = np.frombuffer(r["doc_ids"], "<i8")
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                tokens = expand(np.frombuffer(r["sequence"], "<u4"), np.frombuffer(r["rules"], "<u4").reshape(-1, 2).astype(np.int64)).astype("<u4")
                ends = np.cumsum(lengths)
                start = before[r["part"]] + r["inside"] + ends - lengths
                raw = [tokens[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=np.frombuffer(r["nulls"], np.uint8) > 0), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary()), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    rows = files.select("part", "inside", "doc_ids", "nulls", "lengths", "rules", "sequence")
    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """Chosen stretches of documents of the token files: rows (doc_id, start, stop, ids) for the rows of ``wanted`` (doc_id, start, stop).

    Only the shards that hold a wanted document are decoded, and of them only the symbols that cover its stretch. A null stop is the document's end.
    A stretch outside the document gives no ids; an unknown or null doc_id gives no row; rows that repeat give one. A doc_id that
    several documents have gives a row for each.
    """
    files = wanted.sparkSession.read.schema(_FILE).parquet(path)

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, inside, ids, nulls in zip(*(b.column(c).to_pylist() for c in ("part", "inside", "doc_ids", "nulls")), strict=True):
                known = np.flatnonzero(np.frombuffer(nulls, np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), part), pa.int32()), pa.array(np.full(len(known), inside), pa.int64()), pa.array(known, pa.int32()), pa.array(np.frombuffer(ids, "<i8")[known])], names=["part", "inside", "nth", "doc_id"])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for shard in b.to_pylist():
                got = [(w["doc_id"], w["start"], w["stop"], decode(shard, w["nth"], w["start"], w["stop"]).astype("<u4").tobytes()) for w in shard["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "stop", "ids"])

    index = files.select("part", "inside", "doc_ids", "nulls").mapInArrow(places, "part int, inside long, nth int, doc_id long")
    asked = wanted.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).distinct()
    by_shard = index.join(asked, "doc_id").groupBy("part", "inside").agg(F.collect_list(F.struct("nth", "doc_id", "start", "stop")).alias("wanted"))
    shards = files.select("part", "inside", "ends", "rules", "sizes", "sequence").join(by_shard, ["part", "inside"])
    return shards.mapInArrow(work, "doc_id long, start long, stop long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of ``docs`` to a new place in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
