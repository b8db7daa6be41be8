"""Benchmark decontamination by a prefix-filtered set join of documents with the windows of benchmark items.

A window is a set of shingles, each at its place. A document holds the window only if it holds all of them, so for exact
containment the necessary prefix of a window is one shingle: the first when shingles are ordered by rarity, that is by the
number of pairs each would join (occurrences in the documents times windows that have it). Documents are joined with windows on
that shingle alone. A candidate then has to meet the bounds: the window's start follows from the shingle's place in it, must not lie before
the first word, and the window's length must fit what the document has left. Those that remain are verified word by word.

Only shingles that may be in a prefix leave the scan of the documents: a bitmap of 2^25 cells (4 MB, whatever the inputs) tells. Cells
shared by chance pass on to the exact join, so a bitmap that fills up costs time and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varigrid.llm.common import discard, store
from varigrid.llm.ragged import NOT_ALNUM, Words, batches, split, windows

#: Cells of a bitmap, and of one of its rows.
CELLS, ROW = 1 << 25, 1 << 15
#: Distinct shingles that a task counts before it passes its counts on.
COUNTED = 1 << 18


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row; different for different k."""
    return windows(words, k, 0xA0761D6478BD642F).view(np.int64)


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Rows (item, n, words, shingles) for every window of ``items`` (item_id, text): its words, joined by a space, their number, and its shingles in order.

    An item with fewer words than ``window`` is one window, and one with fewer than ``shingle`` has one shingle of all its words. Items without words have no rows.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = split(b.column("text"), True, NOT_ALNUM)
            hashes, rows = w.hashes(), []
            for item, a, z in zip(b.column("item").to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                n = min(window, z - a)
                words = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:z].tolist(), w.ends[a:z].tolist(), strict=True)]
                parts = _shingles(hashes[a:z], min(shingle, n)) if n else ()
                for i in range(z - a - n + 1 if n else 0):
                    rows.append((item, n, " ".join(words[i : i + n]), parts[i : i + n - min(shingle, n) + 1]))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "n", "words", "shingles"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(work, "item string, n int, words string, shingles array<long>").distinct()


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each cell that one of ``hashes`` (h) falls into. The driver gets at most 1,024 rows of 4 KB."""
    cell = F.col("h").bitwiseAND(F.lit(CELLS - 1))
    rows = hashes.select((cell / ROW).cast("int").alias("row"), (cell % ROW).alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((CELLS // ROW, ROW // 8), np.uint8)
    for r in rows.collect():
        out[r.row] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & (CELLS - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _candidates(w: Words, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shingle size: the size, and text, first word and hash of every shingle whose cell is set."""
    hashes = w.hashes()
    for k in sizes:
        parts = _shingles(hashes, k)
        at = np.flatnonzero(_may_hold(bits, parts))
        text = np.searchsorted(w.first, at, "right") - 1
        inside = at + k <= w.first[text + 1]
        yield k, text[inside], at[inside], parts[at[inside]]


def occurrences(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """Rows (h, n): how often shingles whose cell is set occur in the texts, counted within tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["h", "n"])

        for b in batches(it):
            w = split(b.column("text"), True, NOT_ALNUM)
            for *_, found in _candidates(w, sizes, shared.value):
                for h, n in zip(*(x.tolist() for x in np.unique(found, return_counts=True)), strict=True):
                    counts[h] = counts.get(h, 0) + n
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(windows_: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (h, place, n, words): of every distinct window the rarest shingle and its first place; windows with a shingle that no document has are left out."""
    each = windows_.select("words", "n", "shingles").dropDuplicates(["words"])
    parts = each.select("words", "n", F.posexplode("shingles").alias("place", "h"))
    own = parts.groupBy("h").agg(F.count_distinct("words").alias("windows"))
    cost = own.join(counts.withColumnRenamed("n", "times"), "h", "left").select("h", (F.coalesce("times", F.lit(0)).cast("double") * F.col("windows")).alias("cost"))
    first = parts.join(cost, "h").groupBy("words", "n").agg(F.min(F.struct("cost", "h", "place")).alias("p"))
    return first.where("p.cost > 0").select("p.h", "p.place", "n", "words")


def document_candidates(docs: DataFrame, sizes: list[int], bits: np.ndarray, window: int) -> DataFrame:
    """Every row of ``docs`` (doc_id, id, fp, text) without its text, with n_words and its candidates: h, at (first word), before, and the words around, ``before`` of them before the shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = split(b.column("text"), True, NOT_ALNUM)
            lists: list[list] = [[] for _ in range(b.num_rows)]
            for k, text, at, found in _candidates(w, sizes, shared.value):
                reach = window - k if k == max(sizes) else 0
                for i, x, h in zip(text.tolist(), at.tolist(), found.tolist(), strict=True):
                    first = int(w.first[i])
                    lo, hi = max(first, x - reach), min(int(w.first[i + 1]), x + k + reach)
                    words = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True))
                    lists[i].append({"h": h, "at": x - first, "before": x - lo, "words": words.decode()})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "id", "fp")), pa.array(np.diff(w.first), pa.int64()), pa.array(lists, kind)], names=["doc_id", "id", "fp", "n_words", "found"])

    return docs.mapInArrow(work, "doc_id long, id long, fp long, n_words long, found array<struct<h:long,at:int,before:int,words:string>>")


def merged_spans(hits: DataFrame) -> DataFrame:
    """Rows (id, fp, spans): the ranges that hits (id, fp, start, n) cover, those that meet or overlap made one, in order."""
    each = hits.groupBy("id", "fp", "start").agg((F.col("start") + F.max("n")).alias("end"))
    order = Window.partitionBy("id", "fp").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    runs = each.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "fp", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def judge(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item, and which items those are.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Returns for every row of ``docs`` (doc_id, text):
    doc_id, n_words, n_hit (words inside any occurrence of a window), spans (their ranges, end exclusive) and items (ids of the items with
    occurring windows, as sorted strings). Null and empty texts have no words, so they hit nothing and are never hit. Very long texts and items
    are read whole. Rows that repeat a doc_id are judged each; items that repeat an item_id are one item; an item without an id has the id ''.
    Without documents there are no rows; without items nothing is hit. Other columns are ignored.
    """
    wins = store(item_windows(items, window, shingle), "windows")
    sizes = sorted(r.k for r in wins.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    counts = occurrences(docs, sizes, bitmap(wins.select(F.explode("shingles").alias("h"))))
    first = store(prefixes(wins, counts), "prefixes")
    found = store(document_candidates(keyed, sizes, bitmap(first.select("h")), window), "candidates")
    near = found.select("id", "fp", "n_words", F.explode("found").alias("c")).select("id", "fp", "n_words", "c.h", "c.at", "c.before", F.col("c.words").alias("around"))
    pairs = near.join(first, "h").withColumn("start", F.col("at") - F.col("place"))
    pairs = pairs.where("start >= 0 AND start + n <= n_words")
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ") == F.col("words")
    hits = store(pairs.where(same).select("id", "fp", "start", "n", "words").distinct(), "hits")
    ids = hits.select("id", "fp", "words").distinct().join(wins.select("words", "item"), "words").groupBy("id", "fp").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = store(merged_spans(hits).join(ids, ["id", "fp"]), "hit")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    rows = found.drop("found").join(hit, ["id", "fp"], "left")
    rows = rows.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    discard(hits, first, wins)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")
