"""A run-length compressed FM-index over sequences of words, through which sequences are streamed backward."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.ones = int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Level by level, the bits of all symbols from the highest down, each level ordered by the bits above."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.depth):
            bits = ((symbols >> (self.depth - 1 - level)) & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        # where each symbol's places begin on the last level
        self.base = np.zeros(sigma, np.int32)
        change = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        self.base[symbols[change]] = change

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.base[symbol]


class FMIndex:
    """Over pieces of symbols, for matches of up to ``reach`` symbols.

    Suffixes are ordered by their first ``reach`` symbols, by doubling; that is all that matches of
    this length can tell apart. Of the last column only its runs are kept: a wavelet tree over the
    runs' symbols, where each run starts (with a bit for each place), and the lengths of each symbol's runs added up. Neither the
    text nor its order stays. ``values`` gives each piece a number; a suffix keeps the rank of its
    piece's number in 32 bits.
    """

    def __init__(self, pieces: np.ndarray, lengths: np.ndarray, values: np.ndarray, reach: int):
        self.alphabet, codes = np.unique(pieces, return_inverse=True)
        sigma = len(self.alphabet) + 1
        ends = np.cumsum(lengths)
        starts = ends - lengths + np.arange(len(lengths))
        text = np.zeros(len(codes) + len(lengths), np.int32)  # a closing 0 after each piece
        inside = np.ones(len(text), bool)
        inside[starts + lengths] = False
        text[inside] = codes + 1
        order = _suffixes(text, reach)
        self.length = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int32)
        last = text[order - 1]  # the symbol before each suffix
        starts_run = np.concatenate([[True], last[1:] != last[:-1]])
        self.marks = BitVector(starts_run)
        self.run_start = np.flatnonzero(starts_run).astype(np.int32)
        self.run_symbol = last[self.run_start]
        self.tree = WaveletTree(self.run_symbol, sigma)
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        lengths_of_runs = np.diff(np.append(self.run_start, self.length))
        self.run_sum = np.concatenate([[0], np.cumsum(lengths_of_runs[by_symbol])]).astype(np.int32)
        self.run_first = np.concatenate([[0], np.cumsum(np.bincount(self.run_symbol, minlength=sigma))]).astype(np.int32)
        self.ranked = np.unique(values)
        self.least = np.repeat(np.searchsorted(self.ranked, values).astype(np.int32), lengths + 1)[order]

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before each position."""
        run = np.maximum(self.marks.rank(at) - 1, 0)  # of the place before
        whole = self.run_first[symbol] + self.tree.rank(symbol, run)
        partly = np.where(self.run_symbol[run] == symbol, at - self.run_start[run], 0)
        return self.run_sum[whole] - self.run_sum[self.run_first[symbol]] + partly

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on as those of [low, high)."""
        both = self.before(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def least_values(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least piece value over each interval, none of them empty."""
        power = (np.frexp((high - low).astype(np.float32))[1] - 1).astype(np.int8)
        # a rounded length may reach the next power of two
        power -= (np.int64(1) << power.astype(np.int64)) > high - low
        out = np.empty(len(low), np.int32)
        least = self.least
        for k in range(int(power.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                least = np.minimum(least[:-half], least[half:])
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
        return self.ranked[out]

    def matching_statistics(self, query: np.ndarray, lengths: np.ndarray, reach: int, indexed: bool = False, least: int = 1, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stream pieces (raw symbols, one after the other) through the index.

        For each end in ``query`` the length of the longest match that ends there, up to ``reach``
        and within the end's own piece, and the interval of suffixes that start with the match.
        ``indexed`` says that the pieces are in the index: a match whose interval is a single suffix
        is then the piece itself, and its length is known without further steps. Ends that have no
        room for a match of ``least`` are left at 0.
        """
        ends = np.cumsum(lengths)
        room = np.arange(len(query)) - np.repeat(ends - lengths, lengths) + 1
        at = np.searchsorted(self.alphabet, query)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == query[known]
        symbol = np.where(known, at + 1, 0)
        length = np.zeros(len(query), np.int32)
        low, high = np.zeros(len(query), np.int32), np.zeros(len(query), np.int32)
        for begin in range(0, len(query), block):
            live = begin + np.flatnonzero(known[begin : begin + block] & (room[begin : begin + block] >= least))
            length[live], low[live], high[live] = 1, self.first[symbol[live]], self.first[symbol[live] + 1]
            for n in range(1, reach):
                live = live[room[live] > n]
                if indexed:
                    single = live[high[live] - low[live] == 1]
                    length[single] = np.minimum(room[single], reach)
                    live = live[high[live] - low[live] > 1]
                live = live[known[live - n]]
                if not len(live):
                    break
                new_low, new_high = self.step(symbol[live - n], low[live], high[live])
                longer = new_high > new_low
                live = live[longer]
                length[live], low[live], high[live] = n + 1, new_low[longer], new_high[longer]
        return length, low, high


def _suffixes(text: np.ndarray, reach: int) -> np.ndarray:
    """Positions in the order of their first ``reach`` symbols, at least."""
    rank, reached = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reached < reach:
        follow = np.zeros_like(rank)
        follow[:-reached] = rank[reached:] + 1
        key = rank * (int(follow.max()) + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()])
        rank = np.empty_like(rank)
        rank[order] = fresh
        reached *= 2
        if fresh[-1] == len(rank) - 1:
            break
    return order
