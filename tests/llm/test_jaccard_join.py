import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import documents, empty
from varigrid.llm import jaccard_join
from varigrid.llm.components import components, merged
from varigrid.llm.jaccard_join import _sharing, near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [shingles(r.text, k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id, len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "split", "sub"), [(3, 90, 2, 3), (5, 80, 2, 3), (5, 80, 1, 1), (2, 60, 2, 3)])
def test_against_brute_force(spark, k, percent, split, sub):
    docs = documents(spark, seed=k, n=120)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, k, percent, split, sub).collect()]
    assert sorted(got) == brute(docs.collect(), k, percent)


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_each_signature_has_one_lead_whatever_is_held(spark, held):
    r = random.Random(held)
    pairs = [(r.randrange(1, 40) << 58, r.randrange(1, 9)) for _ in range(300)] + [(5 << 58, n) for n in range(1, 60)]
    blocks = [(sig * 4 >> 64, np.array([sig], np.uint64).tobytes() + np.array([n], np.int64).tobytes()) for sig, n in pairs]
    rows = _sharing(spark.createDataFrame([(p, bytearray(x)) for p, x in blocks], "part int, pairs binary").repartition(4, "part"), held).collect()
    nodes = {}
    for sig, n in pairs:
        nodes.setdefault(np.array([sig], np.uint64).view(np.int64)[0], set()).add(n)
    for sig, all_ in nodes.items():
        leads = {x.lead for x in rows if x.sig == sig}
        assert len(leads) == (len(all_) > 1)
        assert {x.node for x in rows if x.sig == sig} | leads == (all_ if leads else set())


@pytest.mark.parametrize("percent", [80, 90])
def test_crowd_around_the_threshold_over_many_partitions(spark, percent):
    r = random.Random(percent)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            words[r.randrange(len(words))] = r.choice(["new", f"n{r.randrange(10**6)}"])
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(docs, 3, percent, rounds=0).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(docs.collect(), 3, percent)
    assert got == want and 5 < len({c for _, _, c in want}) < 150


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "A B c d"), (None, "q"), (None, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 90).collect()}
    assert got == {(None, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None), (3, 0, 3)}
    assert near_duplicates(empty(spark), 3, 90).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(percent):
    r = random.Random(percent)
    for _ in range(400):
        n = r.choice([4, 9, 12, 20, 60, 200])
        both = {r.getrandbits(64) for _ in range(n)}
        most = n * (100 - percent) // percent
        left = r.randint(0, most)
        x, y = (np.array(sorted(both | {r.getrandbits(64) for _ in range(k)}), np.uint64) for k in (left, r.randint(0, most - left)))
        common = len(np.intersect1d(x, y))
        assert 100 * common >= percent * (len(x) + len(y) - common)
        if x.tolist() != y.tolist():
            assert len(np.intersect1d(signatures(x, percent), signatures(y, percent)))


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(i, find(i)) for a, b in links if a != b for i in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(x.node, x.root) for x in got} == want and len(got) == len(want)


def test_merged_components_are_those_of_all_links(spark):
    r = random.Random(6)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    want = {(x.node, x.root) for x in components(frame(links)).collect()}
    for cut in (0, 30, 89):
        got = merged(components(frame(links[:cut])), frame(links[cut:])).collect()
        assert {(x.node, x.root) for x in got} == want and len(got) == len(want)


def test_words_that_cancel_out_in_sums_are_not_linked(spark):
    """Two one-word texts of the Thue-Morse family share nothing."""
    words = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024)) for flip in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, 3, 90).collect()) == [(0, 0), (1, 1)]


def test_profiles_never_bound_below_what_sets_have_in_common():
    r = np.random.default_rng(6)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (60, 70, 60), (64, 65, 40), (500, 520, 470), (1000, 1030, 3), (20_000, 24_000, 18_000), (9000, 16_500, 8000)):
        x = r.integers(0, 2**63, n + m - both, dtype=np.uint64)
        a, b = jaccard_join.profile(x[:n]), jaccard_join.profile(x[n - both :])
        assert both <= jaccard_join.most_in_common(a, b) <= min(n, m) and jaccard_join.most_in_common(a, b) == jaccard_join.most_in_common(b, a)
    assert jaccard_join.profile(np.arange(300, dtype=np.uint64) * np.uint64(1 << 20)) is None and len(jaccard_join.profile(np.empty(0, np.uint64))) == 64


def crowd(spark, n):
    """Texts of 300 words that all share and three slots of 20 words, each one of 30 passages; no two are linked unless all slots agree."""
    r = random.Random(8)
    shared, slots = [f"s{i}" for i in range(300)], [[[f"t{i}x{j}y{k}" for k in range(20)] for j in range(30)] for i in range(3)]
    rows = [(i, " ".join(shared[:100] + r.choice(slots[0]) + shared[100:200] + r.choice(slots[1]) + shared[200:] + r.choice(slots[2]))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_crowd_below_the_threshold_compares_few_texts(spark, monkeypatch):
    compared, own = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda pairs, texts, k: compared.append(pairs.count()) or own(pairs, texts, k))
    docs = crowd(spark, 600)
    rows = near_duplicates(docs, 3, 90).collect()
    # Two texts with two slots of three in common are just below; all others are told apart by their profiles.
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text, r.doc_id)
    assert {r.doc_id: r.component_id for r in rows} == {r.doc_id: groups[r.text] for r in docs.collect()}
    assert sum(compared) <= 3 * 600


def test_signatures_are_sent_in_turns_and_leave_one_row_for_a_pair(spark, monkeypatch):
    r = random.Random(9)
    base = [[f"w{r.randrange(10**6)}" for _ in range(300)] for _ in range(10)]
    rows = [(i, " ".join([*base[i % 10][:150], f"n{i}", *base[i % 10][150:]])) for i in range(60)]
    sent, kept, plans, blocks, own = [], [], [], jaccard_join._signature_blocks, jaccard_join.store

    def counted(*args, **more):
        out = blocks(*args, **more)
        sent.append(sum(len(x.pairs) for x in out.collect()))
        return out

    def stored(df, name):
        out = own(df, name)
        if name == "shared":
            kept.append(out.count())
        if name == "texts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(jaccard_join, "_signature_blocks", counted)
    monkeypatch.setattr(jaccard_join, "store", stored)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, split_=1, sub=1).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i % 10 for i, _ in rows}
    all_ = 16 * sum(len(signatures(s, 80, 1, 1)) for s in jaccard_join.shingle_sets(pa.array([x for _, x in rows]), 5))
    assert sum(sent) == all_ and max(sent) < 0.6 * all_
    assert sum(kept) <= len(kept) * 10 * 15  # pairs in ten groups of six, not signatures
    assert len(plans) == 1 and "hashpartitioning(node" not in plans[0]  # texts are shuffled once, by their hash


def test_texts_of_open_sets_are_not_sent_to_their_components(spark, monkeypatch):
    names, own = [], jaccard_join.store
    monkeypatch.setattr(jaccard_join, "store", lambda df, name: names.append((name, "text" in df.columns)) or own(df, name))
    docs = crowd(spark, 120)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(docs, 3, 90).collect())
    assert got == brute(docs.collect(), 3, 90)
    assert ("open", False) in names and [n for n, text in names if text] == ["texts"]
