"""Operators on nulls, empty tables, repeats and clashing columns, and against brute force where SQL cannot say it."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import documents, empty
from varigrid.llm import line_templates, mixing, order_minhash, packing, quality_rules, token_files, url_filter, warc
from varigrid.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# op1


def test_urls_the_filter_passes_in_error_are_allowed(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i}") for i in range(400)] + [(None, None), (7, "http://h0.org/p7")], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i % 7}.org/p{i}",) for i in range(0, 400, 5)] + [(None,), ("h0.org/p0",)], "canonical string")
    got = url_filter.judge(pages, listed, [], bits_per_key=2).collect()
    assert len(got) == 402
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 400, 5))
    assert any(r.possible and not r.listed for r in got) and all(r.possible for r in got if r.listed)


def test_url_filter_without_list_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert {r.verdict for r in url_filter.judge(pages, none, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), none, [url_filter.Rule("block", "org", "/")]).count() == 0


# op2


def test_quality_rules_of_repeats_and_empty(spark):
    docs = documents(spark)
    got = quality_rules.judge(docs)
    assert got.count() == docs.count() and quality_rules.judge(empty(spark)).count() == 0
    rows = Counter(r.doc_id for r in quality_rules.clean(docs).collect())
    kept = Counter(r.doc_id for r in got.where("kept").collect())
    assert rows == kept and quality_rules.clean(docs).columns == docs.columns


def test_frequent_lines_go_and_copies_do_not_make_them(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{i} {long}\nShared  LINE here\nrare {i}", "a") for i in range(30)] + [(100 + i, f"{long}\ncopied line", "b") for i in range(30)]
    out = quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), least=20, share=0.5).collect()
    assert {r.doc_id: r.text for r in out} == {**{i: f"{i} {long}\nrare {i}" for i in range(30)}, **{100 + i: f"{long}\ncopied line" for i in range(30)}}


def test_depleted_documents_go(spark):
    footer = " ".join(f"f{i}" for i in range(60))
    rows = [(i, f"{footer}\nown {i}", None) for i in range(30)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.depleted and not r.kept and r.n_frequent_words == 60 for r in got)


# op4


def test_token_files_round_trip(spark, encode):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "no id", "en", None, 5, 0, "x")], documents(spark).schema))
    path = new_path(spark, "tokens")
    token_files.write(docs, path, PATH, shard_tokens=2000, least=2)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = encode(r.text)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    shards = spark.read.parquet(path).collect()
    assert len(shards) > 2 and sum(len(s.rules) for s in shards) > 0


def test_rules_are_used_and_copies_shrink_to_one_symbol():
    r = random.Random(5)
    ids = np.array([r.choice([1, 1, 2, 3, 4, 5]) for _ in range(3000)] + [7, 8, 9] * 100, np.uint32)
    rules, sizes, seq, ends = token_files.re_pair(ids, np.array([1500, len(ids)]), least=3, most=50)
    inner, placed = Counter(rules.ravel().tolist()), Counter(seq.tolist())
    assert all(inner[x] or placed[x] > 1 for x in range(token_files.BASE, token_files.BASE + len(rules)))
    assert token_files.expand(seq, rules).tolist() == ids.tolist() and len(seq) < len(ids) // 3
    copies = np.array([*range(10, 200), 2] * 4, np.uint32)
    rules, sizes, seq, ends = token_files.re_pair(copies, np.arange(1, 5) * 191)
    assert token_files.expand(seq, rules).tolist() == copies.tolist() and ends.tolist() == [1, 2, 3, 4] and max(sizes) == 191


def test_fetch_of_chosen_stretches(spark, encode):
    docs = documents(spark)
    path = new_path(spark, "tokens")
    token_files.write(docs, path, PATH, shard_tokens=2000, least=2)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(encode(r.text))
    wanted = [(0, 0, None), (6, 3, 9), (6, 3, 9), (9, 5, 10**6), (9, 10**6, None), (max(i for i in texts if i is not None), 100, 200), (None, 0, 5), (-4, 0, 5)]
    got = sorted((r.doc_id, r.start, r.stop or -1, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in token_files.fetch(spark.createDataFrame(wanted, "doc_id long, start long, stop long"), path).collect())
    assert got == sorted((i, a, z or -1, tuple(ids[a:z])) for i, a, z in set(wanted) if i in texts and i is not None for ids in texts[i])


def test_token_files_of_empty_table(spark):
    assert token_files.round_trip(empty(spark), PATH).count() == 0


def test_re_pair_decodes_any_part():
    r = random.Random(3)
    docs = [[r.choice([1, 2, 3, 70000]) for _ in range(r.choice([0, 1, 2, 50, 300]))] for _ in range(40)] + [[9] * 100, [1, 1, 1]]
    ids, lengths = np.array([x for d in docs for x in d], np.uint32), np.array([len(d) for d in docs])
    for most in (1, 3, 4096):
        rules, sizes, seq, ends = token_files.re_pair(ids, np.cumsum(lengths), least=2, most=most)
        assert token_files.expand(seq, rules).tolist() == ids.tolist() and len(seq) < len(ids)
        assert [len(token_files.expand(np.array([token_files.BASE + i]), rules)) for i in range(len(rules))] == sizes.tolist()
        shard = {"rules": rules.astype("<u4").tobytes(), "sizes": sizes.astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes()}
        for i, d in enumerate(docs):
            a, z = sorted((r.randint(0, len(d)), r.randint(0, len(d))))
            assert token_files.decode(shard, i).tolist() == d if d else True
            assert token_files.decode(shard, i, a, z).tolist() == d[a:z] if d else True


# op5


def test_line_templates_edges(spark):
    docs = documents(spark)
    out = line_templates.drop_recurring(docs, least=3)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_templates.drop_recurring(empty(spark)).count() == 0
    nulls = [r for r in out.collect() if r.text is None]
    assert nulls and all((r.n_lines, r.n_dropped) == (0, 0) for r in nulls)


def test_templates_with_fields_recur(spark):
    body = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(20))
    rows = [(i, f"{body(i)}\nposted by {chr(97 + i)}user on page {i} of many\nonly {body(i)}", None) for i in range(12)]
    out = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.text for r in out} == {i: f"{body(i)}\nonly {body(i)}" for i in range(12)}


def test_near_copies_stay_whole_and_boilerplate_pages_do_not(spark):
    line = lambda i, n: " ".join(f"{chr(97 + (i * 7 + j) % 26)}{chr(97 + i % 26)}{chr(97 + (i // 26 + 3 * j) % 26)}" for j in range(n))
    told = [line(i, 12) for i in range(8)]
    copies = [(i, "\n".join([*told[:i % 8], line(100 + i, 12), *told[i % 8 + 1 :]])) for i in range(30)]
    menu = [f"menu m{chr(97 + i % 26)}{chr(97 + i // 26)} {line(400 + i, 4)}" for i in range(33)]
    pages = [(100 + 11 * a + b, "\n".join([menu[a], menu[11 + b], menu[22 + (a + b) % 11], f"own o{chr(97 + a)}{chr(97 + b)} {line(1000 + 11 * a + b, 3)}"])) for a in range(11) for b in range(11)]
    out = {r.doc_id: r.text for r in line_templates.drop_recurring(spark.createDataFrame(copies + pages, "doc_id long, text string")).collect()}
    assert all(out[i] == t for i, t in copies)
    assert all(out[i] == t.split("\n")[3] for i, t in pages)


def test_fields_follow_the_size_of_the_leaf(spark):
    """A word counts as a field by its share of a leaf, so with more documents ordinary lines do not turn into templates of their own."""
    r = random.Random(1)
    common = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    for many in (400, 4000):
        rows = [(i, f"we saw {' '.join(r.choices(common, k=6))}") for i in range(many)]
        assert line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), usual=0.05).where("n_dropped > 0").isEmpty()


CLASHES = ["id", "fp", "gone", "frequent", "host", "block", "possible", "row", "lines", "n_lines", "n_dropped", "fp_", "id_", "h", "w0", "taken", "part", "node"]


def test_clashing_names(spark):
    docs = documents(spark).select("doc_id", "text", "source", *(F.lit(7).alias(c) for c in CLASHES))
    for out, own in ((quality_rules.clean(docs), []), (line_templates.drop_recurring(docs, least=3), ["n_lines", "n_dropped"])):
        assert sorted(out.columns) == sorted(docs.columns)
        assert {tuple(r) for r in out.select([c for c in CLASHES if c not in own]).distinct().collect()} == {(7,) * (len(CLASHES) - len(own))}
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").select("*", *(F.lit(7).alias(c) for c in CLASHES))
    asked = url_filter.ask(pages, "url", pages, 4)
    assert asked.columns == [*pages.columns, "possible"] and asked.drop("possible").first()["block"] == 7


# op6


def test_warc_index_selects_and_short_payloads_stay(spark):
    rows = [(i, f"http://h/{i}" if i % 4 else None, f"<p>{i % 5}</p>" * (i % 3)) for i in range(60)] + [(None, "u\r\nX: 1", "<p>0</p>"), (None, None, None), (3, "http://h/3", "<p>3</p>" * 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    index = warc.write(pages, path, least_bytes=9, file_bytes=900)
    assert index.select("file").distinct().count() > 1 and index.count() == len(rows)
    picked = warc.read(index.where("page_id % 2 = 0 AND record_type = 'response'"), path, gap=64, most=500).collect()
    html = {r[0]: r[2] for r in rows}
    assert picked and all(r.page_id % 2 == 0 and r.payload.decode() == html[r.page_id] for r in picked)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in warc.read(index, path).collect():
        h = (html[r.page_id] if r.page_id is not None else None) or ""
        if r.page_id is not None:
            other = first[h] if len(h) >= 9 and first[h] != r.page_id else None
            assert (r.refers_to, r.record_type) == (other, "response" if other is None else "revisit")
    assert warc.round_trip(pages.limit(0)).count() == 0


# op7


def test_packing_plan_against_counts():
    r = random.Random(2)
    for capacity in (1, 2, 3, 10, 64):
        for _ in range(60):
            counts = {n: r.choice([0, 1, 2, 5, 40]) for n in range(1, capacity + 1) if r.random() < 0.5}
            slots, bins = packing.plan(counts, capacity)
            fill, large, seen = defaultdict(list), Counter(), Counter()
            for n, lo, hi, first, offset in slots:
                assert lo == seen[n]
                seen[n] = hi
                for k in range(hi - lo):
                    fill[first + k].append((offset, n))
                    large[first + k] += n > capacity // 3
            assert seen == Counter({n: c for n, c in counts.items() if c}) and sorted(fill) == list(range(bins))
            for b, parts in fill.items():
                end = 0
                for offset, n in sorted(parts):
                    assert offset == end
                    end += n
                assert end <= capacity and large[b] <= 2
            total = sum(n * c for n, c in counts.items())
            assert bins <= -(-total // capacity) * 1.3 + 1 + sum(c for n, c in counts.items() if n > capacity // 3) / 2


def test_packing_against_tokens(spark, encode):
    docs = documents(spark)
    got = packing.pack(docs, PATH, 256, with_ids=True).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    once = Counter(r.doc_id for r in docs.collect())
    for r in docs.collect():
        want, mine = encode(r.text), sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        if once[r.doc_id] == 1:
            assert [i for p in mine for i in np.frombuffer(p.ids, "<u4").tolist()] == want
            assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
            assert len(mine) == -(-len(want) // 256) and all(p.length == 256 for p in mine[1:])
    assert packing.pack(empty(spark), PATH).count() == 0


# op8


def test_edit_report_against_plain_python(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "last of all", "en", None, 5, 0, "x")], documents(spark).schema))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), [-ord(c) for c in r.text or ""]))
    got = Counter((r.doc_id, r.n_chars, r.edited_text, r.near_edited, r.near_next) for r in order_minhash.edit_report(docs).collect())
    want, prints = Counter(), order_minhash.sketches([r.text or "" for r in rows], 64, 2, 2)
    for i, r in enumerate(rows):
        t, n = r.text or "", (i + 1) % len(rows)
        half = len(t) // 2
        edited = t[: len(t) - half] + (rows[n].text or "")[:half]
        es = order_minhash.sketches([edited], 64, 2, 2)[0]
        want[r.doc_id, len(t), edited, order_minhash.likeness(prints[i], es), order_minhash.likeness(prints[i], prints[n])] += 1
    assert got == want
    one = docs.where("doc_id = 0").limit(1)
    assert [r.near_next for r in order_minhash.edit_report(one).collect()] == [1.0]
    assert order_minhash.edit_report(empty(spark)).count() == 0


def test_sketch_selects_the_smallest_in_text_order():
    x = order_minhash._numbered(np.random.default_rng(4).integers(0, 40, 5000).astype(np.uint64))
    assert len(set(x.tolist())) == 5000
    kmers = np.random.default_rng(5).integers(0, 900, 3000).astype(np.uint64)
    whole = order_minhash.sketch(kmers, 32, 3)
    moved = order_minhash.sketch(np.concatenate([kmers[1500:], kmers[:1500]]), 32, 3)
    assert order_minhash.likeness(whole, order_minhash.sketch(kmers.copy(), 32, 3)) == 1
    assert order_minhash.likeness(whole, moved) < 0.7
    near = kmers.copy()
    near[::200] = 7777
    assert order_minhash.likeness(whole, order_minhash.sketch(near, 32, 3)) > 0.8


# op9


def test_apportion_against_highest_quotients(spark):
    r = random.Random(8)
    rows = [(g, p, float(r.choice([0, 1, 3, 7, 50, 999])), s) for g, s in enumerate([0, 1, 2, 5, 17, 200]) for p in range(r.choice([1, 2, 9]))]
    df = spark.createDataFrame([(g, str(p), v, s) for g, p, v, s in rows], "g int, p string, v double, s long")
    got = {(x.g, x.p): x.quota for x in mixing.apportion(df, "g", "p", "v", "s").collect()}
    for g in {x[0] for x in rows}:
        parties = [(p, v) for g_, p, v, _ in rows if g_ == g and v]
        seats = next(s for g_, _, _, s in rows if g_ == g)
        best = sorted(((-v / (2 * n - 1), str(p)) for p, v in parties for n in range(1, seats + 1)))[:seats]
        won = Counter(p for _, p in best)
        assert {p: n for (g_, p), n in got.items() if g_ == g} == {str(p): won[str(p)] for g_, p, *_ in rows if g_ == g}


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.choice([0, 5, 90, 400])), r.choice(["a", "b", "b", "b", "c", None, "d"]), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) < 0.05 * target[s] + 64, (i, s)
    free = {s: target[s] / mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))) if target[s] < 2.999 * size[s]}
    assert max(free.values()) == pytest.approx(min(free.values()))


@pytest.mark.parametrize("words", [[10], [20], [100], [30] * 5, [7, 150]])
def test_rare_sources_of_short_streams_meet_their_targets(spark, words):
    rows = [(i, " ".join(["w"] * (300 if i % 12 else words[i // 12 % len(words)])), "large" if i % 12 else "a rare one") for i in range(2400)]
    rows += [(5000, "w " * 33, "tiny"), (5001, None, "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_documents=24).collect()
    taken, target = Counter(), {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert target["a rare one"] > 0 and all(abs(taken[s] - t) <= 64 for s, t in target.items()), (taken, target)


def test_mix_of_awkward_tables(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(x.size == words[x.doc_id] for x in got)
    assert mixing.mix(empty(spark)).count() == 0


# tokens


def test_pieces_encode_as_whole_texts(encode):
    import pyarrow as pa

    from varigrid.llm import tokens

    texts = ["", " ", "a", " a", "a ", "a  b", "it's  don't", "über É\u3000x y", "line\nnext line\n\n end", "x\u00a0 y", "12 345 6", "<|endoftext|> a", "a\tb c", "\n a", "👩‍👩‍👧 z"]
    for t, ids in zip(texts, tokens.encode(pa.array(texts), PATH), strict=True):
        assert ids.tolist() == encode(t), t
