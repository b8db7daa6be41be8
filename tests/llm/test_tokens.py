"""The vectorised encoder against the tokenizers library, on texts made to sit on its cuts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from varigrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "Z", "the", "ß", "é", "7", "٣", "½", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x85", "\x1c", "'", "'s", "'ll", "''", "’", ".", "!!", "|", "́", "中", "😀", "\x00", "<|endoftext|>", "_", "ǅ"]


def held(texts: list[str | None], **options: int) -> None:
    want = [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, tokens.END] for t in texts]
    got = tokens.encode(pa.array(texts, pa.string()), PATH, **options)
    assert [x.tolist() for x in got] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20), st.none()), max_size=5))
def test_ids_equal_the_librarys(texts):
    held(texts)


def test_edges_between_texts_slices_and_forgetting():
    held([" ", "x", " ", "\n", "", None, "'", "s", "a ", "b\n\n", " c"])
    held([])
    held(["one two three", "four five"] * 3 + ["six seven " * 3000], remembered=2)
    texts = pa.array(["skipped", "x y", None, "z"])
    assert [x.tolist() for x in tokens.encode(texts.slice(1), PATH)] == [x.tolist() for x in tokens.encode(pa.array(["x y", None, "z"]), PATH)]


def test_very_long_text():
    text = "".join(np.random.default_rng(3).choice(PARTS, 200_000))
    held([text, "a" * 50_000])
