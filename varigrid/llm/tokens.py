"""Token ids of whole texts by a public byte-level BPE tokenizer, on the executors.

Such a tokenizer cuts a text into words before it merges bytes, and never merges across a cut. The same cuts are found here for
a batch of texts at once, from the classes of the characters; each distinct word is encoded once per worker and remembered, up to a
fixed number of words, and the ids of a text are put together from those of its words. Which class a character has is asked of the
tokenizer. Next to an apostrophe or to white space of several bytes no cut is made, so such a word may hold several of the tokenizer's.
A text that holds an added token is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from varigrid.llm.ragged import batches

#: The id that ends a document.
END = 2
#: Words that a worker remembers; a word and its ids take about 200 bytes.
REMEMBERED = 1 << 19
#: Bytes of text that are cut at a time.
TOGETHER = 2 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _APOSTROPHE, _WIDE_SPACE = range(1, 7)


class _Known:
    """A tokenizer, the classes of characters that it was asked for, and encoded words: the number of each, and the place and count of its ids in one array."""

    def __init__(self, path: str, plain: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = {b: c for b, c in _alphabet().items() if b != 10}
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        self.kinds = np.zeros(0x110000, np.uint8)
        self.ascii = np.zeros(256, np.uint8)
        self.ascii[:128] = [self.kind(chr(i)) for i in range(128)]
        self.blanks = bytes(i for i in range(128) if self.ascii[i] == _SPACE)
        self.wide: list[str] = []
        self.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def kind(self, char: str) -> int:
        """Letter, number, white space or other, as the tokenizer cuts."""
        if char == "'":
            return _APOSTROPHE
        joined = lambda x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + char)) == 1
        return _LETTER if joined("a") else _NUMBER if joined("1") else _OTHER if joined("!") else _SPACE if ord(char) < 128 else _WIDE_SPACE

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Encode new words: those that are one of the tokenizer's words by its model alone, as lines of one text, and the others one by one."""
        blanks = re.escape(self.blanks)
        apart = re.compile(b"|".join([b"'", b"[" + blanks + b"]\\Z", *(re.escape(c.encode()) for c in self.wide)])).search
        plain = [w for w in words if not apart(w)]
        odd = [w for w in words if apart(w)] if len(plain) < len(words) else []
        spelled = b"\n".join(plain).decode("latin-1").translate(self.alphabet)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids if plain else [], np.uint32)
        size = self.sizes[ids].cumsum()
        ends = np.array([len(w) for w in plain], np.int64).cumsum()
        at = np.searchsorted(size, ends)
        if len(plain) and (size[-1] != ends[-1] or (size[at] != ends).any()):
            raise ValueError("the tokenizer does not cut at the end of a line")
        own = self.encode([w.decode() for w in odd])
        count = np.concatenate([np.diff(at + 1, prepend=0), np.array([len(x) for x in own], np.int64)])
        first = len(self.start)
        self.number.update(zip(plain + odd, range(first, first + len(count)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids, np.array([x for e in own for x in e], np.uint32)])

    def ask(self, point: int) -> None:
        self.kinds[point] = self.kind(chr(point))
        if self.kinds[point] == _WIDE_SPACE:
            self.wide.append(chr(point))


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def _known(path: str, plain: bool = False) -> _Known:
    """For all tasks of a worker process."""
    return _Known(path, plain)


def _classes(data: np.ndarray, known: _Known) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = known.ascii[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        lead = data[at].astype(np.uint32)
        byte = lambda n: data[np.minimum(at + n, len(data) - 1)].astype(np.uint32) & 0x3F
        two, three = (lead & 0x1F) << 6 | byte(1), (lead & 0x0F) << 12 | byte(1) << 6 | byte(2)
        point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)))
        for p in np.unique(point[known.kinds[point] == 0]).tolist():
            known.ask(p)
        own = known.kinds[point]
        kind[at], kind[at + 1] = own, own
        for n, least in ((2, 0xE0), (3, 0xF0)):
            kind[at[lead >= least] + n] = own[lead >= least]
    return kind


def _cuts(data: np.ndarray, edges: np.ndarray, known: _Known) -> np.ndarray:
    """Where words start in the bytes of texts that start at ``edges``."""
    kind = _classes(data, known)
    start = np.zeros(len(data), bool)
    start[edges] = True
    at = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    at = at[~start[at]]
    before, here = kind[at - 1], kind[at]
    glued = (before == _APOSTROPHE) | (before == _WIDE_SPACE) | (here == _APOSTROPHE) | (here == _WIDE_SPACE)
    blank = before == _SPACE
    # The last of white space is a word's first character if it is a space, else a word; what is before it is a word.
    start[at[blank & (here != _WIDE_SPACE)] - 1] = True
    start[at[~glued & ~(blank & (data[at - 1] == 32))]] = True
    return np.flatnonzero(start)


def encode(texts: pa.Array, path: str, remembered: int = REMEMBERED, plain: bool = False) -> list[np.ndarray]:
    """The ids of every text, ended by ``END``, by the tokenizer file ``path`` without its special tokens around the text; a null text counts as empty.

    With ``plain`` the added tokens are ordinary text where a text spells them."""
    known = _known(path, plain)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, raw = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    off = off - off[0]
    cuts = _cuts(data, off[:-1][off[:-1] < off[1:]], known) if len(data) else np.empty(0, np.int64)
    ends = np.append(cuts, len(data))
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    number = list(map(known.number.get, distinct))
    new = [w for w, n in zip(distinct, number, strict=True) if n is None]
    if new:
        if len(known.number) + len(new) > remembered:
            known.clear()
            new = distinct
        known.learn(new)
        number = list(map(known.number.get, distinct))
    number = np.array(number, np.int64)[np.asarray(words.indices)]
    count = known.count[number]
    sizes = np.concatenate([[0], np.cumsum(count)])
    ids = known.ids[np.arange(sizes[-1]) + np.repeat(known.start[number] - sizes[:-1], count)]
    bounds = sizes[np.searchsorted(cuts, off)].tolist()
    end = np.array([END], np.uint32)
    out = [np.concatenate([ids[a:z], end]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in _with_added(texts, known):
        out[i] = np.array([*known.encode([texts[i].as_py()])[0], END], np.uint32)
    return out


def _with_added(texts: pa.Array, known: _Known) -> list[int]:
    import pyarrow.compute as pc

    return sorted({i for a in known.added for i in np.flatnonzero(pc.match_substring(texts, a).to_numpy(zero_copy_only=False)).tolist()}) if len(texts) else []


def documents(it: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Every row as (batch, row, ids with the end id); a null text counts as empty."""
    for b in batches(it, column, TOGETHER):
        for i, ids in enumerate(encode(b.column(column), path)):
            yield b, i, ids
