"""Best-fit packing of token sequences into bins of fixed capacity.

Only the lengths decide where a piece goes, so the plan is made on the histogram of lengths, which has at most
``capacity`` rows whatever the corpus. Lengths above a third of the capacity go at most two to a bin: they are matched
greedily, the longest with the longest that still fits. Shorter lengths then fill the smallest gaps that hold them,
longest first. The plan is a list of slots (length, range of ranks, first bin, offset); pieces are ranked within
their length by counting, without a sort of all pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varigrid.llm.common import store
from varigrid.llm.tokens import documents

_PIECES = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, first bin, offset) for so many pieces of each length; and the number of bins.

    The piece of rank r in a slot goes to bin first bin + r - first rank. Each step uses up a length or a group of
    equal bins, so there are few slots whatever the counts.
    """
    left, used = {n: c for n, c in counts.items() if c}, defaultdict(int)
    slots, groups, bins = [], defaultdict(list), 0

    def put(n: int, first_bin: int, number: int, offset: int) -> None:
        slots.append((n, used[n], used[n] + number, first_bin, offset))
        used[n] += number
        left[n] -= number

    def take(most: int, above: int) -> int:
        return next((n for n in range(most, above, -1) if left.get(n)), 0)

    third = capacity // 3
    for n in sorted((n for n in left if n > third), reverse=True):
        while left[n]:
            mate = take(min(n, capacity - n), third)
            if not mate:
                number, gap = left[n], capacity - n
                put(n, bins, number, 0)
            elif mate == n:
                if left[n] == 1:
                    mate = take(min(n - 1, capacity - n), third)
                    number = 1
                    put(n, bins, 1, 0)
                    gap = capacity - n - mate
                    if mate:
                        put(mate, bins, 1, n)
                else:
                    number, gap = left[n] // 2, capacity - 2 * n
                    put(n, bins, number, 0)
                    put(n, bins, number, n)
            else:
                number, gap = min(left[n], left[mate]), capacity - n - mate
                put(n, bins, number, 0)
                put(mate, bins, number, n)
            groups[gap].append((bins, number))
            bins += number
    for n in sorted((n for n in left if 0 < n <= third), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity + 1) if groups.get(g)), None)
            if gap is None:
                each = min(capacity // n, left[n])
                number = left[n] // each
                first = bins
                bins += number
                for k in range(each):
                    put(n, first, number, k * n)
                groups[capacity - each * n].append((first, number))
                continue
            first, many = groups[gap].pop()
            each = min(gap // n, left[n])
            number = min(many, left[n] // each)
            for k in range(each):
                put(n, first, number, capacity - gap + k * n)
            groups[gap - each * n].append((first, number))
            if number < many:
                groups[gap].append((first + number, many - number))
    return slots, bins


def pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Tokens of every document cut to pieces: doc_id, piece, start, length, ids_crc32 and ids (null unless asked for).

    Only documents of more than ``capacity`` tokens, the end id included, are cut; the first piece takes what is over.
    nth counts the pieces of this length in the task.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        rows: list[tuple] = []
        for b, i, ids in documents(it, path):
            doc_id, fp = b.column("doc_id")[i].as_py(), b.column("fp")[i].as_py()
            cut = len(ids) % capacity or capacity
            for k, (lo, hi) in enumerate(zip([0, *range(cut, len(ids), capacity)], [*range(cut, len(ids), capacity), len(ids)], strict=True)):
                raw = ids[lo:hi].astype("<u4").tobytes()
                rows.append((doc_id, fp, k, lo, hi - lo, zlib.crc32(raw), seen[hi - lo], raw if with_ids else None))
                seen[hi - lo] += 1
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    return texts.mapInArrow(work, "doc_id long, fp long, piece int, start long, length long, ids_crc32 long, nth long, ids binary")


def pack(docs: DataFrame, path: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens of the tokenizer file ``path``.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each
    sequence) and ids (little-endian unsigned 32-bit; null unless ``with_ids``). A null or empty text is the end id
    alone; a very long one is cut into pieces of ``capacity``. Rows that repeat a doc_id are packed as documents of their own; equal lengths are told apart by rank, so
    ties only swap places. An empty table gives no rows; other columns are ignored. Only the histogram of lengths, at
    most ``capacity`` rows, reaches the driver.
    """
    cut = store(pieces(docs, path, capacity, with_ids).withColumn("part", F.spark_partition_id()), "pieces")
    counts = store(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    slots, _ = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    by_length: dict[int, np.ndarray] = {n: np.array([s[1:] for s in slots if s[0] == n], np.int64) for n in {s[0] for s in slots}}

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            bin_, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at, table = np.flatnonzero(length == n), by_length[n]
                k = np.searchsorted(table[:, 0], rank[at], "right") - 1
                bin_[at], offset[at] = table[k, 2] + rank[at] - table[k, 0], table[k, 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(bin_), pa.array(offset), b.column("ids")], names=[*names, "sequence_id", "offset", "ids"])

    ranked = cut.join(shifts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
