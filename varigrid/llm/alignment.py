"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging of all documents of a batch.

The tokens of A and of B cut one byte sequence in two ways. A document's state is one token of A and one of B that overlap; a step emits that
pair as a link and moves on the pointer whose token ends first, or both with a cut if they end together. One vector of such states
advances all documents of a batch at the same time; documents that are through are taken out of it.

How common a link is follows from the whole corpus: for an id pair, the number of documents that hold it. Documents are told by blocks. A
block numbers the distinct pairs that it meets, and its documents keep those numbers; only the pairs themselves, once a block, are
counted, joined and sent back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm import tokens
from varigrid.llm.common import discard, store
from varigrid.llm.ragged import PART, batches

#: Bytes of text that are merged at a time, and pairs that a block numbers before the next one begins.
TOGETHER, NUMBERED = 2 << 20, 1 << 19
#: Pieces of text that a worker remembers with their ids.
REMEMBERED = 1 << 18
_SPACE = 32


class Vocabulary:
    """The entries of a tokenizer by id: their bytes in blocks of eight, their sizes, and the decimal digits of the ids with their number."""

    def __init__(self, entries: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in entries], np.int64)
        width = -(-max(int(self.sizes.max(initial=0)), 1) // 8) * 8
        self.blocks = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in entries), "<u8").reshape(len(entries), -1)
        self.digits = np.zeros((len(entries), len(str(len(entries))) + 1), np.uint8)
        self.widths = np.array([len(str(i)) for i in range(len(entries))], np.int64)
        for i in range(len(entries)):
            self.digits[i, : self.widths[i]] = np.frombuffer(str(i).encode(), np.uint8)


@lru_cache(maxsize=1)
def _byte_level(path: str) -> Vocabulary:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    back = {c: b for b, c in tokens._alphabet().items()}
    return Vocabulary([bytes(back[c] for c in t.id_to_token(i)) if all(c in back for c in t.id_to_token(i)) else t.id_to_token(i).encode() for i in range(t.get_vocab_size())])


class _Pieces:
    """A sentencepiece model and the pieces of text that were encoded: the number of each, and the place and count of its ids in one array.

    A text is cut before each space that follows another character. No entry of the vocabulary holds a space after another
    character, so none goes across a cut, and the ids of the parts are those of the whole; a model for which this does not hold is refused.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece of the model holds a space after another character")
        entry = lambda i, x: bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode()
        self.vocabulary = Vocabulary([entry(i, x) for i, x in enumerate(names)])
        # One space at a text's end; alone it would be an empty text, before which the model puts none.
        self.last = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        """Each part begins with the space that the model puts before a text."""
        own = self.model.encode([x[1:].decode() for x in parts], num_threads=1)
        own = [self.last if x == b" " else ids for x, ids in zip(parts, own, strict=True)]
        count = np.array([len(x) for x in own], np.int64)
        self.number.update(zip(parts, range(len(self.start), len(self.start) + len(parts)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.array([x for e in own for x in e], np.int64)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each of which begins with a space, and where each text's ids begin and the last ends."""
        space = data == _SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1]] = True
        at = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.number]
        if new:
            if len(self.number) + len(new) > REMEMBERED:
                self.clear()
                new = distinct
            self.learn(new)
        number = np.array([self.number[x] for x in distinct], np.int64)[np.asarray(parts.indices)]
        count = self.count[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], count)]
        return ids, ends[np.searchsorted(at, offsets)]


@lru_cache(maxsize=1)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def _same(data: np.ndarray, offsets: np.ndarray, voc: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's ids are those of the text; every id is compared with the bytes at its place, eight at a time."""
    size = voc.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    same = np.diff(ends[first]) == np.diff(offsets)
    n = np.diff(first)
    at = ends[:-1] + np.repeat(offsets[:-1] - ends[first[:-1]], n)
    text = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    differs = np.zeros(len(ids) + 1, bool)
    rows, k = np.flatnonzero(np.repeat(same, n)), 0
    while len(rows):
        differs[rows] |= text[at[rows] + 8 * k] & PART[np.minimum(size[rows] - 8 * k, 8)] != voc.blocks[ids[rows], k]
        k += 1
        rows = rows[size[rows] > 8 * k]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    return same & (wrong[first[1:]] == wrong[first[:-1]])


def lockstep(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (index in A, index in B) of all documents, step by step, and whether a cut follows each.

    ends_*: byte offsets within its document where every token ends; first_*: each document's first token, and the number of all.
    Documents have both kinds of tokens or none, and both end at the same byte.
    """
    live = np.flatnonzero(np.diff(first_a))
    a, b, last = (x.astype(np.int32) for x in (first_a[live], first_b[live], first_a[live + 1]))
    links_a, links_b, cuts = [], [], []
    while len(a):
        ea, eb = ends_a[a], ends_b[b]
        cut = ea == eb
        links_a.append(a)
        links_b.append(b)
        cuts.append(cut)
        a = a + (ea <= eb)
        b = b + (eb <= ea)
        through = a == last
        if through.any():
            stay = ~through
            a, b, last = a[stay], b[stay], last[stay]
    if not cuts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)


def _spelled(a: tuple, b: tuple, groups: tuple) -> list[str]:
    """SHA-256 of each document's groups as text, A and B ids in decimal; '' for one without tokens. a, b: ids, first, vocabulary; groups: of each token."""
    (ids_a, first_a, voc_a), (ids_b, first_b, voc_b) = a, b
    group_a, group_b = groups
    # A's tokens of a group come before B's; groups are numbered over all documents.
    before_b = np.searchsorted(group_b, group_a, "left")
    before_a = np.searchsorted(group_a, group_b, "right")
    n = len(ids_a) + len(ids_b)
    place_a, place_b = np.arange(len(ids_a)) + before_b, np.arange(len(ids_b)) + before_a
    width = max(voc_a.digits.shape[1], voc_b.digits.shape[1])
    text, used = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
    for ids, place, voc, group, end in ((ids_a, place_a, voc_a, group_a, b"|"), (ids_b, place_b, voc_b, group_b, b";")):
        text[place, : voc.digits.shape[1]] = voc.digits[ids]
        used[place] = voc.widths[ids]
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.empty(0, bool)
        text[place, used[place]] = np.where(last, end[0], b","[0])
    flat = text[np.arange(width) <= used[:, None]].tobytes()
    bounds = np.concatenate([[0], np.cumsum(used + 1)])[first_a + first_b].tolist()
    return [hashlib.sha256(flat[x : z - 1]).hexdigest() if z > x else "" for x, z in zip(bounds[:-1], bounds[1:], strict=True)]


class _Block:
    """The pairs that a block has met, sorted, with their numbers and how many documents hold them."""

    def __init__(self, number: int) -> None:
        self.id = number
        self.pairs, self.codes, self.documents = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of pairs, each of which stands once for every document that holds it."""
        distinct, inverse, times = np.unique(pairs, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.pairs, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.pairs):
            known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == distinct
        new = distinct[~known]
        if len(new):
            codes = np.arange(len(self.documents), len(self.documents) + len(new), dtype=np.int32)
            self.pairs, self.codes = np.insert(self.pairs, at[~known], new), np.insert(self.codes, at[~known], codes)
            self.documents = np.concatenate([self.documents, np.zeros(len(new), np.int64)])
        code = self.codes[np.searchsorted(self.pairs, distinct)]
        self.documents[code] += times
        return code[inverse]


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("code", pa.int32()), ("documents", pa.int64())])


def _rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else pa.nulls(n, f.type)) for f in _ALIGNED], schema=_ALIGNED)


def _cut_binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each of sizes (in elements)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def merge_batch(texts: pa.Array, path_a: str, path_b: str) -> tuple:
    """(ids, first token of each text, vocabulary) of A and of B, and the links of all texts: index in A, index in B, cut.

    A encodes a space and the text, B the text, before which it puts a space; special tokens are plain text. A text that is null or
    empty, or whose bytes differ from those of A's or B's tokens, has no tokens.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    _, raw_offsets, raw = padded.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    voc_a, pieces = _byte_level(path_a), _pieces(path_b)
    own = [x[:-1] for x in tokens.encode(padded, path_a, plain=True)]
    ids_a = np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64)
    first_a = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    ids_b, first_b = pieces.encode(data, offsets)
    keep = (np.diff(offsets) > 1) & _same(data, offsets, voc_a, ids_a, first_a) & _same(data, offsets, pieces.vocabulary, ids_b, first_b)

    def kept(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(first)
        return ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n * keep)])

    (ids_a, first_a), (ids_b, first_b) = kept(ids_a, first_a), kept(ids_b, first_b)

    def ends(ids: np.ndarray, first: np.ndarray, voc: Vocabulary) -> np.ndarray:
        out = np.concatenate([[0], np.cumsum(voc.sizes[ids])])
        return out[1:] - np.repeat(out[first[:-1]], np.diff(first))

    links = lockstep(ends(ids_a, first_a, voc_a), first_a, ends(ids_b, first_b, pieces.vocabulary), first_b)
    return (ids_a, first_a, voc_a), (ids_b, first_b, pieces.vocabulary), links


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds. 1, a document: block, doc_id, the counts, groups_sha256, and its distinct pairs by number with how many links each has, as 32-bit integers.
    0, a pair of a block: a, b, code (its number there) and documents (how many of the block hold it)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, blocks = _Block(task << 32), 0

        def pairs() -> pa.RecordBatch:
            order = np.argsort(block.codes)
            p = block.pairs[order]
            columns = {"a": pa.array((p >> 32).astype(np.int32)), "b": pa.array((p & 0xFFFFFFFF).astype(np.int32)), "code": pa.array(np.arange(len(p), dtype=np.int32)), "documents": pa.array(block.documents)}
            return _rows(0, len(p), block=pa.array(np.full(len(p), block.id)), **columns)

        for batch in batches(it, "text", TOGETHER):
            a, b, (link_a, link_b, cut) = merge_batch(batch.column("text"), path_a, path_b)
            (ids_a, first_a, _), (ids_b, first_b, _) = a, b
            n = batch.num_rows
            text = np.searchsorted(first_a, link_a, "right") - 1
            # The last tokens of groups, then each token's group.
            ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
            ends_a[link_a[cut]], ends_b[link_b[cut]] = 1, 1
            groups = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
            # By document, then pair: pairs of one document once, with their links.
            distinct, inverse = np.unique(ids_a[link_a] << 32 | ids_b[link_b], return_inverse=True)
            by_text, times = np.unique(text * max(len(distinct), 1) + inverse, return_counts=True)
            own, which = by_text // max(len(distinct), 1), by_text % max(len(distinct), 1)
            codes = block.numbers(distinct[which]) if len(which) else np.empty(0, np.int32)
            sizes = np.bincount(own, minlength=n)
            counts = [np.diff(first_a), np.diff(first_b), np.bincount(text[cut], minlength=n), np.bincount(text, minlength=n)]
            columns = {c: pa.array(x.astype(np.int64)) for c, x in zip(_COUNTS, counts, strict=True)}
            columns |= {"groups_sha256": pa.array(_spelled(a, b, groups), pa.string()), "codes": _cut_binary(codes, sizes), "times": _cut_binary(times.astype(np.int32), sizes)}
            yield _rows(1, n, block=pa.array(np.full(n, block.id)), doc_id=batch.column("doc_id"), **columns)
            if len(block.pairs) > NUMBERED:
                yield pairs()
                blocks += 1
                block = _Block((task << 32) + blocks)
        yield pairs()

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select("doc_id", "text").mapInArrow(work, f"kind int, block long, doc_id long, {counts}, groups_sha256 string, codes binary, times binary, a int, b int, code int, documents long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, count, best): documents that hold the pair, and whether no other pair of A's id has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("documents").alias("count"))
    counts = store(counts, "pair-counts")  # as a table, so that a frequent id of A is split in the join
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(rows: DataFrame) -> DataFrame:
    """Documents with n_best and count_sum, from rows sorted by block, its pairs (kind 0, by code) before its documents."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, count, best = None, [], []

        for batch in it:
            kind, blocks = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (blocks[1:] != blocks[:-1])]))
            for x, z in zip(edges, np.append(edges[1:], len(kind)), strict=True):
                part = batch.slice(x, z - x)
                if blocks[x] != block:
                    block, count, best = blocks[x], [np.empty(0, np.int64)], [np.empty(0, bool)]
                if kind[x] == 0:
                    count.append(part.column("count").to_numpy())
                    best.append(part.column("best").to_numpy(zero_copy_only=False).astype(bool))
                    continue
                if len(count) > 1:
                    count, best = [np.concatenate(count)], [np.concatenate(best)]
                n_best, total = [], []
                for codes, times in zip(part.column("codes"), part.column("times"), strict=True):
                    c, t = np.frombuffer(codes.as_py(), np.int32), np.frombuffer(times.as_py(), np.int32).astype(np.int64)
                    n_best.append(int(t[best[0][c]].sum()))
                    total.append(int((t * count[0][c]).sum()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *_COUNTS)), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part.column("groups_sha256")], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(work, f"doc_id long, {counts}, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How the tokens of two tokenizer files, byte-level A and sentencepiece B, cut each text.

    Returns for every row of ``docs`` (doc_id, text): doc_id, n_a, n_b (tokens), n_groups (stretches between bytes where tokens of both end), n_links
    (pairs of tokens that overlap), n_best (links of which no other pair with that A id is in more documents), count_sum (documents that hold a link's pair, over
    the links) and groups_sha256 (of the ids by group). Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
    tokens: zeros and ''. Rows that repeat a doc_id or a text are documents of their own and count each. An empty table gives no rows; other columns are ignored; very
    long texts are merged whole, beside the others of their batch.
    """
    both = store(aligned(docs, path_a, path_b), "aligned")
    pairs = both.where("kind = 0").select("block", "a", "b", "code", "documents")
    counts = store(pair_counts(pairs), "pairs")
    told = pairs.join(counts, ["a", "b"]).select(F.lit(0).alias("kind"), "block", "code", "count", "best")
    rows = both.where("kind = 1").select("kind", "block", "doc_id", *_COUNTS, "groups_sha256", "codes", "times")
    rows = told.unionByName(rows, allowMissingColumns=True)
    out = store(_scored(rows.repartition("block").sortWithinPartitions("block", "kind", "code")), "scored")
    discard(both, counts)
    return out
