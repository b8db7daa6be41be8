"""Alignment against both tokenizers run over whole texts and a walk byte by byte."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tests.llm.cases import documents, empty
from varigrid.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a  b", " lead", "trail ", "tab\tnl\n\n x", "l'été c'est   l'homme", "<|endoftext|> <s> </s> <unk>", "▁a ▁", "日本語 テキスト", "a\x00b\x07", "👩‍👩‍👧 ok", "é é", "　x\xa0y", "don't we'll 'S", "x" * 3000, "1234567890 12 345", "\r\n\x0b\x0c", "a b " * 400]


def tokenised():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in alignment.tokens._alphabet().items()}

    def run(text):
        if not text:
            return [], [], b""
        whole = (" " + text).encode()
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            y.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            return [], [], b""
        return x, y, whole

    return run


def expected(rows):
    run, found, held = tokenised(), [], defaultdict(int)
    for doc_id, text in rows:
        x, y, whole = run(text)
        owner_x = [k for k, (_, t) in enumerate(x) for _ in t]
        owner_y = [k for k, (_, t) in enumerate(y) for _ in t]
        links = sorted(set(zip(owner_x, owner_y, strict=True)))
        groups, gx, gy = [], [], []
        for p in range(len(whole)):
            gx += [x[owner_x[p]][0]] if p == 0 or owner_x[p] != owner_x[p - 1] else []
            gy += [y[owner_y[p]][0]] if p == 0 or owner_y[p] != owner_y[p - 1] else []
            if p + 1 == len(whole) or owner_x[p + 1] != owner_x[p] and owner_y[p + 1] != owner_y[p]:
                groups.append(",".join(map(str, gx)) + "|" + ",".join(map(str, gy)))
                gx, gy = [], []
        pairs = [(x[i][0], y[j][0]) for i, j in links]
        for pair in set(pairs):
            held[pair] += 1
        found.append((doc_id, len(x), len(y), groups, pairs))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return Counter((d, n, m, len(g), len(p), sum(held[q] == most[q[0]] for q in p), sum(held[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, g, p in found)


@pytest.mark.parametrize("numbered", [1 << 19, 1])
def test_against_whole_texts(spark, monkeypatch, numbered):
    monkeypatch.setattr(alignment, "NUMBERED", numbered)
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = alignment.align(docs.repartition(3), A, B).collect()
    assert Counter(tuple(r) for r in got) == expected([tuple(r) for r in docs.collect()])


def test_documents_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.align(docs, A, B).collect()
    assert Counter(tuple(r) for r in got) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table_and_other_columns(spark):
    assert alignment.align(empty(spark), A, B).count() == 0
    docs = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, text string, n_a long, code long")
    assert alignment.align(docs, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pieces_that_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    pieces, sp = alignment._Pieces(B), SentencePieceProcessor(model_file=B)
    for texts in (["a b c d e", "a b"], ["f g a ", "b b b  c"]):
        padded = [(" " + t).encode() for t in texts]
        ids, first = pieces.encode(np.frombuffer(b"".join(padded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in padded])]))
        assert [ids[x:z].tolist() for x, z in zip(first[:-1], first[1:], strict=True)] == [sp.encode(t) for t in texts]


def test_lockstep_of_documents_of_unlike_length():
    a, b = np.array([2, 4, 5, 9, 1, 7, 8]), np.array([1, 4, 9, 1, 3, 8])
    x, y, cut = alignment.lockstep(a, np.array([0, 4, 4, 7]), b, np.array([0, 3, 3, 6]))
    got = sorted(zip(x.tolist(), y.tolist(), cut.tolist(), strict=True))
    assert got == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (3, 2, True), (4, 3, True), (5, 4, False), (5, 5, False), (6, 5, True)]


def test_decoded_entries_are_what_the_tokenizer_decodes():
    t, voc = Tokenizer.from_file(A), alignment._byte_level(A)
    t.decoder = ByteLevel()
    for i in range(0, 50256, 97):
        own = voc.blocks[i].tobytes()[: voc.sizes[i]]
        assert own.decode(errors="replace") == t.decode([i])


def test_many_documents_of_one_batch():
    texts = pa.array([f"doc {i} holds {i % 7} words" for i in range(500)] + [None, ""])
    (ids_a, first_a, _), (ids_b, first_b, _), (x, y, cut) = alignment.merge_batch(texts, A, B)
    assert len(first_a) == len(first_b) == 503 and len(x) == len(ids_a) + len(ids_b) - int(cut.sum())
