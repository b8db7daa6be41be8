import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.cases import documents, empty
from varigrid.llm import ragged
from varigrid.llm.substring_dedup import _leftmost_min, remove_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    words = [WORD.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    for length, seed in ((35, 6), (35, 3), (10, 2)):
        docs = documents(spark)
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_passages(docs, length, seed).collect()]
        assert sorted(got, key=str) == brute(docs.collect(), length)


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "x a b c d e"), (None, "q")], "doc_id long, text string")
    got = remove_repeated_passages(docs, 4, 2).collect()
    assert sorted(r.kept_text for r in got) == ["f", "q", "x"]
    assert sorted(len(r.spans) for r in got) == [0, 1, 1]
    assert remove_repeated_passages(empty(spark), 35).count() == 0


def test_words_and_windows_of_arrays():
    texts = ["a b  c", None, "", " x\ta b c", "é\x0bé", "a b c"]
    w = ragged.split(pa.array(texts))
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in WORD.findall(t or "")]
    h = w.hashes()
    assert h[0] == h[4] == h[9] and len(set(h.tolist())) == 5
    x = ragged.windows(h, 3)
    assert x[0] == x[4] == x[9 - 0] if len(x) > 9 else x[0] == x[4]
    assert ragged.spans(h, np.array([0, 4]), np.array([3, 7]))[0] == x[0]


def test_leftmost_min():
    r = np.random.default_rng(1)
    x = r.integers(0, 5, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 28, 30):
        assert _leftmost_min(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(len(x) - w + 1)]


def test_many_repeated_rows(spark):
    """Rows that repeat one id and one text cost their number, not its square."""
    text = " ".join(f"w{i % 290}" for i in range(300))
    docs = spark.createDataFrame([(None if i % 2 else 7, text) for i in range(4000)] + [(9, "alone " * 3)], "doc_id long, text string")
    rows = remove_repeated_passages(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in rows} == {(None, 300, 300, 2000), (7, 300, 300, 2000), (9, 3, 0, 1)}


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_hashes_of_words_that_cancel_out_in_sums():
    """Words and word sequences of the Thue-Morse family, whose polynomials agree modulo a power of two, get hashes of their own."""
    for n in (64, 512, 1024, 2048, 8192):
        words = ["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))]
        assert len(set(ragged.split(pa.array(words)).hashes().tolist())) == 2
        h = ragged.split(pa.array([" ".join(thue_morse(n, "a", "b") + thue_morse(n, "b", "a"))])).hashes()
        two = ragged.spans(h, np.array([0, n]), np.array([n, 2 * n]))
        assert two[0] != two[1] and ragged.windows(h, n)[[0, n]].tolist() == two.tolist()


def test_passages_that_cancel_out_in_sums_stay(spark):
    docs = spark.createDataFrame([(1, " ".join(thue_morse(1024, "a", "b"))), (2, " ".join(thue_morse(1024, "b", "a")))], "doc_id long, text string")
    rows = {r.doc_id: r.n_removed for r in remove_repeated_passages(docs, 1024).collect()}
    assert rows == {1: 0, 2: 0}
