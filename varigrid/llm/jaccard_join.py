"""Similarity join of word-shingle sets by partition-and-enumerate (PartEnum) signatures.

Two sets with a Jaccard similarity of at least p percent differ in at most k elements, where k depends on their sizes
alone. Sizes are cut into bands; for each band k is fixed by the largest pair whose smaller set lies in it. The
feature domain is cut by hash into partitions, each of them into ``SUB`` parts. If two sets differ in at most k
elements, then some partition holds at most ``SPLIT - 1`` differences, and there a subset of its parts agrees
wholly; the hash of each such subset is a signature. So linked sets of a band share a signature, and no link is lost.

Sets that share a signature are compared with one lead of it, so most links show without a look at every pair of a group. After that the
signature is not needed any more: copies share hundreds, but have one lead in common or few. Where sets of one lead are then still in
different components, the rest of their pairs is cut down by prefixes: elements are put in one order, the frequent last, and two linked
sets have an element in common among the first of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import discard, store
from varigrid.llm.components import components, merged
from varigrid.llm.ragged import batches, mix, spans, split, windows
from varigrid.llm.url_filter import divide

#: Cells in which elements are counted for their order; they bound what the driver holds, and what goes to each task.
CELLS = 1 << 20
#: Pairs of a signature and a set that a part is to hold, and the signatures of a set that parts are counted by.
PART_PAIRS, USUAL_SIGNATURES = 1 << 22, 300
#: Signatures are dealt out in so many turns, each a share of all, as those of one turn lie on disk together.
TURNS = 2


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; with fewer words, of the whole sequence; empty without words."""
    w = split(texts, lower)
    words, first = w.hashes(), w.first
    all_ = windows(words, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = dict(zip(short.tolist(), spans(words, first[:-1][short], first[1:][short], 0xA0761D6478BD642F) if len(short) else (), strict=True))
    return [np.array([whole[i]], np.uint64) if i in whole else np.unique(all_[first[i] : first[i + 1] - k + 1]) if n[i] else np.empty(0, np.uint64) for i in range(len(n))]


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=100_000)
def _band(size: int, percent: int) -> tuple[int, int]:
    """Smallest and largest size of the band of ``size``: each band is as wide as a link can stretch."""
    low = 1
    while True:
        high = max(low, math.ceil(low * 100 / percent) - 1)
        if size <= high:
            return low, high
        low = high + 1


@lru_cache(maxsize=10_000)
def scheme(low: int, high: int, percent: int, split_: int, sub: int) -> tuple[int, int, int]:
    """Partitions of a band, how many of them may hold more differences than a partition tolerates, and parts of each.

    In small sets some partitions are weak: all their elements fall into fewer than ``split_`` parts. There are as
    many partitions more, or parts more, that fewer than one set in 100,000 has only weak ones among those that must
    agree; only such sets need a signature of nothing.
    """
    k = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    if not k:
        return 0, 0, sub
    bad = k // split_
    fits = []
    for parts in (sub, 4 * sub // 3, 2 * sub, 4 * sub) if split_ > 1 else (sub,):
        for n in range(bad + 1, 4 * bad + 8):
            of, share = low / n, (n - bad) / n
            weak = math.exp(-of) * (1 + (split_ - 1) * parts * math.expm1(of / parts))
            if share > weak:
                far = share * math.log(share / weak) + ((1 - share) * math.log((1 - share) / (1 - weak)) if share < 1 else 0)
                if math.exp(-n * far) < 1e-5:
                    fits.append((n * math.comb(parts, split_ - 1), n, parts))
                    break
    _, n, parts = min(fits, default=(0, bad + 1, 4 * sub if split_ > 1 else sub))
    return n, bad, parts


def _bands(size: int, percent: int) -> list[tuple[int, int]]:
    """Bands of the sets of this size or smaller that it may be linked with."""
    out = [_band(size, percent)]
    while (low := out[-1][0]) > 1 and 100 * (low - 1) >= percent * size:
        out.append(_band(low - 1, percent))
    return out


def signatures_of(sets: list[np.ndarray], percent: int, split_: int = 2, sub: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets of hashes for links of at least ``percent`` percent, and the number of the set of each."""
    by_band: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(sets):
        for band in _bands(len(s), percent) if len(s) else ():
            by_band.setdefault(band, []).append(i)
    out, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for (low, high), members in by_band.items():
        n, bad, parts = scheme(low, high, percent, split_, sub)
        if not n:  # only equal sets can be linked, and those share their set hash
            continue
        all_, number = np.concatenate([sets[i] for i in members]), np.array(members)
        row = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        cell = row * (n * parts) + ((mix(all_ ^ np.uint64(high)) >> np.uint64(33)) % np.uint64(n * parts)).astype(np.int64)
        sums, full = np.zeros(len(members) * n * parts, np.uint64), np.zeros(len(members) * n * parts, bool)
        np.add.at(sums, cell, mix(all_ + np.uint64(0x632BE59BD9B4E019)))
        full[cell] = True
        sums, full = sums.reshape(-1, n, parts), full.reshape(-1, n, parts)
        weak = np.zeros(full.shape[:2], bool)
        for i, chosen in enumerate(combinations(range(parts), parts - split_ + 1)):
            some = full[:, :, chosen].any(axis=2)
            weak |= ~some
            at, where = np.nonzero(some)
            h = np.full(len(where), np.uint64(i + 1) + np.uint64(high) * np.uint64(1 << 16), np.uint64) + where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for c in chosen:
                h = mix(h ^ sums[at, where, c])
            out.append(h)
            owners.append(number[at])
        empty = number[weak.sum(axis=1) >= n - bad]
        out.append(np.repeat(mix(np.array([high], np.uint64)), len(empty)))
        owners.append(empty)
    return np.concatenate(out), np.concatenate(owners)


def signatures(s: np.ndarray, percent: int, split_: int = 2, sub: int = 3) -> np.ndarray:
    """PartEnum signatures of one set."""
    return signatures_of([s], percent, split_, sub)[0]


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = shingle_sets(b.column("text"), k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())], names=["doc_id", "fp", "n_shingles", "node"])

    return docs.mapInArrow(work, "doc_id long, fp long, n_shingles long, node long")


def _signature_blocks(docs: DataFrame, k: int, percent: int, split_: int, sub: int, parts: int, held: int = 1 << 20, remembered: int = 1 << 18, turn: int = 0, turns: int = 1) -> DataFrame:
    """Rows (part, pairs): signatures and their nodes as two arrays of 64-bit numbers, dealt to ``parts`` ranges of signatures.

    Of ``turns`` calls, each has the signatures of one remainder; together they have all. A task skips sets that it has just had, so large groups of copies send one set per task.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes = [], []

        def flush() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, node = sig[order], node[order]
            ends = np.cumsum(np.bincount(part, minlength=parts))
            rows = [(p, sig[a:z].tobytes() + node[a:z].tobytes()) for p, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if z > a]
            sigs.clear(), nodes.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "pairs"])

        for b in batches(it):
            new = []
            for s in shingle_sets(b.column("text"), k):
                if (h := set_hash(s)) not in seen:
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(h)
                    new.append((s, h))
            sig, owner = signatures_of([s for s, _ in new], percent, split_, sub)
            due = sig % np.uint64(turns) == turn
            sig, owner = sig[due], owner[due]
            sigs.append(sig)
            nodes.append(np.array([h for _, h in new], np.int64)[owner])
            if sum(map(len, sigs)) >= held:
                yield flush()
        if sum(map(len, sigs)):
            yield flush()

    return docs.mapInArrow(work, "part int, pairs binary")


def _sharing(blocks: DataFrame, held: int = 1 << 20) -> DataFrame:
    """Of blocks dealt by part: (sig, lead, node) for every node but one, the lead, of each signature that several nodes have.

    A task sorts ``held`` pairs at a time. It remembers each signature of its part once, with its lead, so that a
    signature of very many nodes streams through; such a one has at most one pair for each set, of hundreds that the set has in all parts.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, leads = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def shared() -> pa.RecordBatch:
            nonlocal known, leads
            sig, node = (np.concatenate([x[i].view(t) for x in waiting]) for i, t in ((0, np.uint64), (1, np.int64)))
            waiting.clear()
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            again = np.zeros(len(sig), bool)
            again[1:] = ~new[1:] & (node[1:] == node[:-1])
            first = np.flatnonzero(new)
            own, lead = sig[first], node[first]
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                old = known[at] == own
                lead = np.where(old, leads[at], lead)
                known, leads = np.concatenate([known, own[~old]]), np.concatenate([leads, lead[~old]])
                by = np.argsort(known, kind="stable")
                known, leads = known[by], leads[by]
            else:
                known, leads = own, lead
            lead = np.repeat(lead, np.diff(np.append(first, len(sig))))
            keep = np.flatnonzero(~again & (node != lead))
            return pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(lead[keep]), pa.array(node[keep])], names=["sig", "lead", "node"])

        for b in it:
            for x in b.column("pairs"):
                pairs = np.frombuffer(x.as_buffer(), np.uint64)
                waiting.append(pairs.reshape(2, -1).copy())
                if sum(x.shape[1] for x in waiting) >= held:
                    yield shared()
        if waiting:
            yield shared()

    return blocks.mapInArrow(work, "sig long, lead long, node long")


def _cells(n: int) -> int:
    """Cells of the profile of a set of n elements, a power of two about a quarter as large as the set."""
    return 1 << min(max(int(n - 1).bit_length() - 2 if n > 1 else 0, 6), 13)


def profile(s: np.ndarray) -> bytes | None:
    """How many elements of a set fall into each cell; None if one has more than 255."""
    counts = np.bincount((s & np.uint64(_cells(len(s)) - 1)).astype(np.int64), minlength=_cells(len(s)))
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def most_in_common(x: bytes, y: bytes) -> int:
    """What two sets can have in common at most, by their profiles: the smaller count of each cell; the finer profile is folded."""
    a, b = (np.frombuffer(p, np.uint8).astype(np.int64) for p in (x, y))
    cells = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, cells).sum(axis=0), b.reshape(-1, cells).sum(axis=0)).sum())


def _profiles(texts: DataFrame, k: int) -> DataFrame:
    """Rows (node, n, profile) of texts (node, text): the size of the set and its profile."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = shingle_sets(b.column("text"), k)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([profile(s) for s in sets], pa.binary())], names=["node", "n", "profile"])

    return texts.mapInArrow(work, "node long, n long, profile binary")


def _possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and profiles allow a link. The bound is never below what a pair has in common, so no link is lost; most pairs that
    share a signature and little else end here, before their texts are sent anywhere."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)
            keep = []
            for (m, n), x, y in zip(sizes, b.column("profile_a"), b.column("profile_b"), strict=True):
                both = min(m, n) if not (x.is_valid and y.is_valid) else min(m, n, most_in_common(x.as_py(), y.as_py()))
                keep.append(100 * both >= percent * (m + n - both))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    a, b = (profiles.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("profile").alias(f"profile_{x}")) for x in "ab")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").where(fits).mapInArrow(work, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, profiles: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, as a table. Only texts of pairs that profiles leave open are sent to be compared."""
    open_ = store(_possible(pairs, profiles, percent), "possible")
    nodes = store(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared")
    near = divide(texts, "node", nodes)[0]
    out = store(_compared(open_, near, k).where(F.expr(f"100 * both >= {percent} * all")).select("a", "b"), "linked")
    discard(open_, nodes)
    return out


def _compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of nodes with both, the size of the intersection of their sets, and all, that of the union; texts has one text per node."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text_a", 1 << 20):
            both, all_ = [], []
            for x, y in zip(shingle_sets(b.column("text_a"), k), shingle_sets(b.column("text_b"), k), strict=True):
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                all_.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both, pa.int64()), pa.array(all_, pa.int64())], names=["a", "b", "both", "all"])

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long, both long, all long")


def near_duplicates(docs: DataFrame, k: int, percent: int, split_: int = 2, sub: int = 3, rounds: int = 1) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their k-word shingle sets of ``percent`` percent or more.

    Returns for every row of ``docs`` (doc_id, text): doc_id, fp (hash of the text), n_shingles (size of its set; A-Z
    count as lower case), set_id (equal for equal sets) and component_id (smallest doc_id that links reach, itself
    included). A null, empty or blank text has an empty set and is linked with nothing, so component_id is its own
    doc_id. Rows that repeat a doc_id count as documents of their own; a null doc_id is never the smallest, so only
    a component without any other doc_id gets null. An empty table gives no rows, other columns are ignored, and a very long text is one set like
    any other. Sets are told apart by 64-bit hashes. Links between documents of one
    component are not all looked at: a group that shares a signature is first compared with one of its sets, its lead, then, for
    ``rounds`` rounds, with other sets drawn for each lead; a pair's texts are only compared if the profiles of their sets allow a link; of sets that are still in different components, those pairs are
    compared at last that have an element in common in their prefixes (see ``_close_pairs``).
    """
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    sets = store(_sets(docs, k), "sets")
    # Parts grow in number with the sets, so what a task holds of one does not; each part is one task's.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() * USUAL_SIGNATURES // (PART_PAIRS * TURNS)))
    blocks = (_signature_blocks(docs.select("text"), k, percent, split_, sub, parts, turn=i, turns=TURNS) for i in range(TURNS))
    stored = [store(_sharing(x.repartitionById(parts, F.col("part"))).select("lead", "node").distinct(), "shared") for x in blocks]
    shared = reduce(DataFrame.unionByName, stored)
    pairs = shared.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    nodes = shared.select("node").union(shared.select("lead")).distinct()
    one = store(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("fp").alias("fp")), "nodes")
    # A text's set has one node, so grouping and join need one shuffle of texts, by their hash.
    near = divide(docs.select("fp", "text"), "fp", one)[0].groupBy("fp").agg(F.first("text").alias("text"))
    texts = store(near.join(one, "fp").select("node", "text"), "texts")
    profiles = store(_profiles(texts, k), "profiles")
    links = _linked(pairs, texts, profiles, k, percent)
    found = store(components(links), "components")
    for turn in range(rounds + 1):
        more = _next_pairs(shared, found, turn) if turn < rounds else _close_pairs(shared, found, texts, k, percent)
        if more is None:
            break
        links = _linked(more, texts, profiles, k, percent)
        old, found = found, found if links.isEmpty() else store(merged(found, links), "components")
        discard(more, links, *([old] if old is not found else ()))
    discard(*stored, one, texts, profiles)
    rows = sets.join(found, "node", "left").withColumn("root", F.coalesce("root", F.when(F.col("n_shingles") > 0, F.col("node"))))
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "fp", "n_shingles", F.col("node").alias("set_id"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _members(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (lead, node, root): the sets that share a signature with each lead, with the component that they are in so far.

    A lead is no member of its own group, since it has been compared with all others of it.
    """
    root = found.select(F.col("node").alias("n_"), F.col("root").alias("r_"))
    return shared.join(root, F.col("node") == F.col("n_"), "left").select("lead", "node", F.coalesce("r_", "node").alias("root"))


def _next_pairs(shared: DataFrame, found: DataFrame, turn: int) -> DataFrame | None:
    """For each lead whose sets are in several components, pairs of one drawn set with those of other components; None without any."""
    rows = store(_members(shared, found), "members")
    drawn = F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(turn), "lead", "node"))
    groups = rows.groupBy("lead").agg(drawn.alias("d"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead", "d")
    pairs = rows.join(groups, "lead").where(F.col("root") != F.col("d.root")).select(F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b"))
    pairs = store(pairs.distinct(), "pairs")
    discard(rows)
    return None if pairs.isEmpty() else pairs


def _levels(texts: DataFrame, k: int) -> np.ndarray:
    """How frequent elements are, by cells of their hashes, as the logarithm; 0 for the rare.

    A task reports the cells that it has met more often than chance would have it; the sums of those, at most ``CELLS``, reach the
    driver. They decide about the order of elements alone, so an uneven count costs time and no link.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in batches(it):
            for s in shingle_sets(b.column("text"), k):
                np.add.at(counts, (s % np.uint64(CELLS)).astype(np.int64), 1)
        often = np.flatnonzero(counts >= 2 + 4 * counts.sum() // CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.array(counts[often], pa.int64())], names=["cell", "n"])

    sums = texts.select("text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 4").toArrow()
    levels = np.zeros(CELLS, np.uint8)
    levels[np.asarray(sums["cell"], np.int64)] = np.log2(np.asarray(sums["n"], np.float64)).astype(np.uint8)
    return levels


def _prefixes(texts: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Rows (node, size, elements): the first elements of each set, which it cannot lack in common with a set that it is linked with."""
    table = texts.sparkSession.sparkContext.broadcast(levels)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = shingle_sets(b.column("text"), k)
            first = [s[np.lexsort((s, table.value[(s % np.uint64(CELLS)).astype(np.int64)]))[: len(s) + 1 + (-percent * len(s)) // 100]].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["node", "size", "elements"])

    return texts.select("node", "text").mapInArrow(work, "node long, size int, elements array<long>")


def _close_pairs(shared: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Pairs of sets in different components that may be linked, among the sets that share a lead with a set of another component; None without any such set.

    All elements have one order, the frequent last. Two linked sets of m and n elements have (m + n) p / (100 + p) or more in common, so
    the first of these is early in both, and what follows it in either suffices. Sets of a crowd that are not linked differ in
    elements that few have, and those come first, so a crowd does not make all its pairs. Prefixes are sent to their components, not texts.
    """
    rows = _members(shared, found)
    open_ = rows.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead")
    nodes = store(rows.join(open_, "lead", "left_semi").select("node", "root").distinct(), "open")
    if nodes.isEmpty():
        return None
    near = divide(texts, "node", nodes)[0]
    rows = _prefixes(near, k, percent, _levels(near, k)).join(nodes, "node").select("node", "root", "size", F.posexplode("elements").alias("at", "element"))
    x, y = (rows.select("element", *(F.col(c).alias(f"{c}_{i}") for c in ("node", "root", "at", "size"))) for i in "xy")
    early = (100 + percent) * (F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))) >= percent * (F.col("size_x") + F.col("size_y"))
    sizes = 100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")
    pairs = x.join(y, "element").where((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & sizes & early)
    out = store(pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), "pairs")
    discard(nodes)
    return out
