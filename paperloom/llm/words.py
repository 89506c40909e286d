"""Words of whole texts as 64-bit codes, for operators that compare word sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Word codes kept by a worker; a full memo starts afresh. About 130 bytes each.
MEMO_WORDS = 500_000
#: Words of more bytes are hashed one by one by ``codes_in``.
LONG_WORD = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = np.array([chr(k) not in " \t\n\v\f\r" for k in range(256)])
#: The first k bytes of a little-endian 64-bit value.
_FIRST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_in(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all ``texts`` in turn, and where each text's begin (and the last one's end).

    Words are runs of anything but space and U+0009 to U+000D, in UTF-8; ``lower``: A-Z lower-cased. All
    words are hashed together, by 8 of their bytes a round. These are other codes than those of ``codes_of``.
    """
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
    held, at = held.lower() if lower else held, at - at[0]
    padded = held + bytes(8)
    eight = np.ndarray(len(held) + 1, "<u8", padded, strides=(1,))  # those from each byte on
    inside = _INSIDE[np.frombuffer(held, np.uint8)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(held))]  # a word ends with its text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    codes = mixed(lengths.astype(np.uint64) * _GOLDEN)
    some = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        some = some[lengths[some] > k] if k else some
        if not len(some):
            break
        value = eight[starts[some] + k] & _FIRST[np.minimum(lengths[some] - k, 8)]
        codes[some] = mixed((codes[some] ^ mixed(value)) + _GOLDEN)
    for k in np.flatnonzero(lengths > LONG_WORD):
        codes[k] = xxhash.xxh3_64_intdigest(held[starts[k] : starts[k] + lengths[k]])
    return codes, np.searchsorted(starts, at)


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``size`` words of each of ``texts``, ascending, and where each text's begin (and the last one's end)."""
    codes, at = codes_in(texts, lower=True)
    n = np.diff(at)
    counts = np.where(n < size, np.minimum(n, 1), n - size + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    if len(codes) >= size:
        whole = np.ones(len(codes) - size + 1, bool)  # those that don't begin in one text and end in another
        for k in range(1, size):
            edges = at[:-1] - k
            whole[edges[(edges >= 0) & (edges < len(whole))]] = False
        out[np.repeat(n >= size, counts)] = shingles(codes, size)[whole]
    for k in np.flatnonzero((n > 0) & (n < size)):
        out[starts[k]] = shingles(codes[at[k] : at[k + 1]], size)[0]
    for k in np.flatnonzero(counts > 1):
        out[starts[k] : starts[k + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][counts > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[starts]


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of ``size`` words; for fewer words, but some, one of the whole sequence."""
    n = len(codes)
    if not n:
        return codes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - size + 1 + k])
    return out
