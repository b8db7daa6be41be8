"""Words and word windows of many texts at once, as flat numpy arrays.

A batch of texts is one byte array with the texts' offsets; words, their hashes and window hashes are computed for
the whole batch without a Python loop over words. Hashes depend on the words alone, so they agree between tasks. Words
that differ have equal hashes with the odds of chance alone, 2^-64 for a pair: every step scrambles, so nothing cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_LEFT = np.uint64(0x9E3779B97F4A7C17)
#: The low bytes of a block of eight that belong to a word with so many bytes left.
PART = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed by the xxhash library, one by one.
_LONG = 1 << 10
#: Bytes that are in no word of letters and digits: ASCII but for 0-9, A-Z and a-z.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """starts, ends: byte positions of the words; first: index of each text's first word, and the number of all words;
    offsets: the texts' bytes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        """Hash of every word: its blocks of eight bytes go into the hash one after the other, each scrambled, so no sum can cancel out."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) + _LEFT)
        blocks = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), 0, (1,))
        rows, k = np.flatnonzero(size <= _LONG), 0
        while len(rows):
            part = blocks[self.starts[rows] + k] & PART[np.minimum(size[rows] - k, 8)]
            out[rows] = mix(out[rows] ^ part)
            k += 8
            rows = rows[size[rows] > k]
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]])
        return out

    def texts_of(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two stretches of words, one after the other, from their hashes; scrambled each time, so equal sums do not add up."""
    return mix(a * _LEFT + b)


def _doubled(words: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of all stretches of 1, 2, 4 ... words, up to ``length``."""
    out = [words]
    while 2 << (len(out) - 1) <= length:
        x, step = out[-1], 1 << (len(out) - 1)
        out.append(_after(x[:-step], x[step:]) if len(x) > step else x[:0])
    return out


def _spans(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Each span put together from stretches of a power of two, the longest first."""
    at, out = starts.copy(), mix(lengths.astype(np.uint64) ^ np.uint64(seed))
    doubled = _doubled(words, int(lengths.max(initial=0)))
    for j in range(len(doubled) - 1, -1, -1):
        rows = np.flatnonzero(lengths >> j & 1)
        out[rows] = _after(out[rows], doubled[j][at[rows]])
        at[rows] += 1 << j
    return out


def windows(words: np.ndarray, k: int, seed: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of every k consecutive words, texts' borders ignored; empty if there are fewer words."""
    n = len(words) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, n, _BLOCK // 2):
        hi = min(n, lo + _BLOCK // 2)
        out[lo:hi] = _spans(words[lo : hi + k - 1], np.arange(hi - lo), np.full(hi - lo, k), seed)
    return out


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of the words from starts to ends (exclusive), for ascending spans; equal to ``windows`` for equal lengths."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK // 2, "right")))
        lo = int(starts[i])
        out[i:j] = _spans(words[lo : int(ends[i:j].max())], starts[i:j] - lo, ends[i:j] - starts[i:j], seed)
        i = j
    return out


def split(texts: pa.Array, lower: bool = False, gap: np.ndarray = _IS_SPACE) -> Words:
    """Words of every text, the longest runs of bytes that ``gap`` does not hold; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    off = off - off[0]
    if lower:
        raw = _LOWER[raw]
    word = ~gap[raw]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    start[edge] = word[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    end[edge] = word[edge]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, off), off)


def batches(it: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes of text, so that the arrays made from one stay small; a text is never cut."""
    for batch in it:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j
