"""Fingerprints and mixes against plain Python that walks k-mer by k-mer and word by word."""

import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents
from varigrid.llm import mixing, order_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = 2**64
ALL = 2**64
LEFT = 0x9E3779B97F4A7C17


def scrambled(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB % ALL
    return x ^ x >> 31


def word_hash(word):
    h = scrambled((len(word) + LEFT) % ALL)
    for i in range(0, len(word), 8):
        h = scrambled(h ^ int.from_bytes(word[i : i + 8], "little"))
    return h


def joined(a, b):
    return scrambled((a * LEFT + b) % ALL)


def doubled(values):
    """Hash of a power of two of values."""
    return values[0] if len(values) == 1 else joined(doubled(values[: len(values) // 2]), doubled(values[len(values) // 2 :]))


def sequence(values, seed=0xD1342543DE82EF95):
    h, at = scrambled(len(values) ^ seed), 0
    for j in range(len(values).bit_length() - 1, -1, -1):
        if len(values) >> j & 1:
            h, at = joined(h, doubled(values[at : at + (1 << j)])), at + (1 << j)
    return h


def fingerprint(text, m, l, k):
    """The l smallest numbered k-mers of each of m hash functions, put back in text order and hashed as a tuple."""
    words = [w.encode() for w in WORD.findall(text)]
    hashes = [word_hash(w) for w in words]
    kmers = [tuple(hashes[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(hashes)] if words else [])
    if not kmers:
        return "0" * 8 * m
    met, numbered = Counter(), []
    for kmer in kmers:
        numbered.append(scrambled((sequence(kmer) + met[kmer] * 0xA24BAED4963EE407) % ALL))
        met[kmer] += 1
    out = []
    for i in range(m):
        seed = scrambled((i + 1) * 0x9E3779B97F4A7C15 % ALL)

        def rank(at, seed=seed):
            h = (numbered[at] ^ seed) * 0xBF58476D1CE4E5B9 % ALL
            return (h ^ h >> 32) * 0x94D049BB133111EB % ALL, at

        chosen = sorted(heapq.nsmallest(l, range(len(numbered)), key=rank))
        entry = seed
        for j in range(l):
            entry = scrambled(entry ^ ((numbered[chosen[j]] if j < len(chosen) else 0) + j) % ALL)
        out.append(f"{entry >> 32:08x}")
    return "".join(out)


def alike(x, y):
    pairs = [(x[i : i + 8], y[i : i + 8]) for i in range(0, len(x), 8)]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_fingerprints_and_their_likeness(spark):
    docs = documents(spark)
    rows = sorted(docs.collect(), key=lambda r: (-r.doc_id, [-ord(c) for c in r.text or ""]))
    prints = [fingerprint(r.text or "", 64, 2, 2) for r in rows]
    want = Counter()
    for i, r in enumerate(rows):
        text, after = r.text or "", (i + 1) % len(rows)
        half = len(text) // 2
        edited = fingerprint(text[: len(text) - half] + (rows[after].text or "")[:half], 64, 2, 2)
        want[r.doc_id, prints[i], edited, alike(prints[i], edited), alike(prints[i], prints[after])] += 1
    got = order_minhash.edit_report(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want


@pytest.mark.parametrize(("m", "l", "k"), [(16, 3, 1), (8, 1, 4)])
def test_fingerprints_of_other_shapes(spark, m, l, k):
    docs = documents(spark).where("doc_id < 90 OR doc_id > 170")
    got = Counter((r.doc_id, r.fingerprint) for r in order_minhash.fingerprints(docs, m, l, k).collect())
    assert got == Counter((r.doc_id, fingerprint(r.text or "", m, l, k)) for r in docs.collect())


def filled(sizes, weights, total, most):
    """Targets: shares by weight, stopped at ``most`` times the size, the excess shared again."""
    full, target = set(), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = Fraction(total) - sum(most * sizes[s] for s in full)
        target = {s: Fraction(most * sizes[s]) if s in full else rest * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def selected(blocks, times, shift):
    return [b for b in range(blocks) if ((b + 1) * times + shift) // blocks > (b * times + shift) // blocks]


@pytest.mark.parametrize("seed", [3, 4])
def test_taken_words_are_those_of_the_selected_blocks(spark, seed):
    r, block, most, shards_of = random.Random(seed), 64, 3, 50
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 70, 200, 333])), r.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(700)]
    rows += [(700, "w " * 40, "tiny"), (701, None, "void"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Seeded hashes come from the session; all that follows from them is redone here.
    keyed = docs.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("o", F.xxhash64(F.lit(17), "doc_id", "fp"))
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(18), "o")).withColumn("s", F.xxhash64(F.lit(19), "source")).collect()
    shards = -(-len(keyed) // shards_of)
    streams, seeds = defaultdict(list), {}
    for x in keyed:
        streams[x.source].append((x.h % shards, x.o, x.doc_id, x.fp, len(WORD.findall(x.text or ""))))
        seeds[x.source] = x.s
    order = sorted(streams, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[4] for x in streams[s]) for s in order}
    target = filled(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(size.values()), most)
    passes, blocks, shift, votes = {}, {}, {}, {}
    for s in order:
        passes[s], rest = divmod(target[s], size[s]) if size[s] else (0, Fraction(0))
        blocks[s] = -(-size[s] // block)
        shift[s] = seeds[s] % blocks[s] if blocks[s] else 0
        words = [sum(min(block, size[s] - b * block) for b in selected(blocks[s], n, shift[s])) for n in range(blocks[s] + 1)]
        n = max((n for n, w in enumerate(words) if w <= rest), default=0)
        votes[s] = n + ((rest - words[n]) / (words[n + 1] - words[n]) if n < blocks[s] else 0)
    once = {s: int(votes[s]) for s in order}
    seats = int(sum(votes.values()) + Fraction(1, 2)) - sum(once.values())
    for s in sorted((s for s in order if votes[s] > once[s]), key=lambda s: (-votes[s] / (2 * once[s] + 1), s is None, s or ""))[:seats]:
        once[s] += 1
    want = Counter()
    for s in order:
        chosen, at = set(selected(blocks[s], once[s], shift[s])), 0
        for *_, doc_id, _, n in sorted(streams[s]):
            want[doc_id, s, n, passes[s] * n + sum((at + i) // block in chosen for i in range(n))] += 1
            at += n
    got = mixing.mix(docs, block=block, shard_documents=shards_of, most=most).collect()
    assert Counter((x.doc_id, x.source, x.size, x.taken) for x in got) == want
    assert all(x.target == pytest.approx(float(target[x.source])) for x in got)
