"""Contamination against plain Python that looks for every window at every word."""

import random
import re

from tests.llm.cases import documents, empty
from varigrid.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(window, len(w))
            for at in range(len(w) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == w[at : at + n]:
                        hit |= set(range(i, i + n))
                        found.add("" if item is None else str(item))
        spans = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((doc_id, len(own), len(hit), list(zip(*spans, strict=True)), sorted(found)))
    return sorted(map(str, out))


def run(docs, items, **how):
    rows = decontamination.judge(docs, items, **how).collect()
    assert rows == [] or rows[0].asDict().keys() == {"doc_id", "n_words", "n_hit", "spans", "items"}
    return sorted(str((r.doc_id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], list(r.items))) for r in rows)


def test_against_every_window(spark):
    r = random.Random(2)
    vocabulary = ["a", "b", "c", "the", "Of", "é", "x1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 14])))) for i in range(12)]
    items += [(3, "a b, c"), (None, "the x1"), (50, None), (51, ""), (52, "--"), (53, "a a a a a a a a"), (54, items[4][1])]
    texts = [" ".join(r.choice(vocabulary + ["zz", "qq-"]) for _ in range(r.choice([0, 2, 9, 40, 120]))) for _ in range(40)]
    texts += [t + ". " + texts[3] for _, t in items if t] + [None, "", "a " * 60, " ".join(f"w{i}" for i in range(6000)) + " " + (items[0][1] or "")]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(2, texts[2]), (2, texts[5])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for how in ({"window": 5, "shingle": 3}, {"window": 10, "shingle": 3}, {"window": 2, "shingle": 4}):
        assert run(d, b, **how) == expected(docs, items, how["window"])


def test_other_columns_and_empty_tables(spark):
    docs = documents(spark)
    items = spark.createDataFrame([("q", "one", 1, 2)], "item_id string, text string, h long, words long")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs, items) == expected(plain, [("q", "one")], 10)
    assert run(docs, items.limit(0)) == expected(plain, [], 10) and run(empty(spark), items) == []


def test_a_shingle_that_all_windows_hold_is_not_the_one_to_join_by(spark):
    """The rarest shingle decides by the pairs it would join: the template that all items share is rarer in texts than each item's own words, and joins all."""
    items = spark.createDataFrame([(i, f"fill in here own{i} word") for i in range(50)], "item_id long, text string")
    windows_ = decontamination.item_windows(items, 10, 2)
    counts = decontamination.occurrences(spark.createDataFrame([(f"own{i} word here own{i} " * 2 + "fill in here",) for i in range(50)], "text string"), [2], decontamination.bitmap(windows_.selectExpr("explode(shingles) AS h")))
    rows = decontamination.prefixes(windows_, counts)
    assert rows.count() == 50 and rows.groupBy("h").count().agg({"count": "max"}).first()[0] == 1
