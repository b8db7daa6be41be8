"""The pipeline's stages, each on what the one before it keeps."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.cases import documents, empty
from tests.llm.test_jaccard_join import brute
from varigrid.llm import mixing, quality_rules
from varigrid.llm.common import n_words, store


@pytest.fixture(scope="module")
def stages(spark):
    docs = store(documents(spark, seed=11, n=150), "raw")
    out = {"raw": docs}
    for name, stage in cp.STAGES:
        docs = out[name] = store(stage(spark, docs, ""), name)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert all(stages[n].columns == cp.COLUMNS for n, _ in cp.STAGES[:-1])
    assert all(stages[n].where("n_chars <> length(text)").count() == 0 for n in ("line_dedup", "mixing"))


def test_quality_keeps_what_its_rules_keep(stages):
    kept = Counter(r.doc_id for r in quality_rules.judge(stages["raw"]).where("kept").collect())
    assert Counter(r.doc_id for r in stages["quality_rules"].collect()) == kept and kept


def test_line_dedup_keeps_documents(stages):
    ids = [sorted(r.doc_id for r in stages[n].collect()) for n in ("quality_rules", "line_dedup")]
    assert ids[0] == ids[1]


def test_near_duplicates_keep_the_smallest_of_each_group(spark, stages):
    want = {i for i, _, least in brute(stages["line_dedup"].collect(), 5, 80) if i == least}
    got = [r.doc_id for r in stages["near_duplicates"].collect()]
    assert set(got) == want and len(got) == len(want) < stages["line_dedup"].count()
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, None), (4, "A b c d e f", None, None, None), (None, "alone", None, None, None), (5, None, None, None, None), (6, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, odd, "").collect()) == ["4", "5", "6", "None"]


def test_mixing_takes_what_the_mix_says(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix(stages["near_duplicates"]).collect() if r.taken}
    rows = stages["mixing"].groupBy("doc_id").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in rows if r.n} == taken and taken


def test_packing_holds_all_tokens(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages["mixing"].collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, bins = Counter(), defaultdict(list)
    for r in stages["packing"].collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024


def test_run_chains_the_stages(spark, stages, tmp_path):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    stages["raw"].write.parquet(f"{tmp_path}/documents.parquet")
    assert key(cp.run(spark, str(tmp_path))) == key(stages["packing"])


def test_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
