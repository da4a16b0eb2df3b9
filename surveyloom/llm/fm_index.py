"""FM-index of a word sequence: suffix order, wavelet-tree ranks, sampled suffix positions; all searches are vectorised."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Places of all suffixes in order. Symbol 0 separates: no two separators are equal, the earlier is the smaller. The last symbol is 0.

    The first sort takes as many symbols as fit in a word; what is still tied there is doubled, as usual. A key that
    holds a separator is never tied, because the sort is stable.
    """
    n = len(symbols)
    wide = max(1, min(62 // bits, 16))
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(wide, np.int64)])
    for j in range(wide):
        part = np.where(alive, padded[j : j + n], 0)
        key = (key << bits) | part
        alive &= part > 0
    order = np.argsort(key, kind="stable")
    tied = alive[order]
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~tied[1:]
    step = wide
    while not new.all():
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = group
        size_one = new & np.append(new[1:], True)
        rows = np.flatnonzero(~size_one)
        places = order[rows]
        second = rank[places + step]
        by = np.lexsort((second, group[rows]))
        order[rows] = places[by]
        g, s = group[rows][by], second[by]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        new[rows] = fresh
        step *= 2
    return order


class WaveletTree:
    """Ranks over a sequence of small numbers: one bit vector a level, zeros before ones, counts kept for every 64 bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.bits = len(sequence), bits
        self.words, self.before, self.zeros = [], [], []
        current = sequence.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is found before each place."""
        low, high = np.zeros_like(at), at.copy()
        for i in range(self.bits):
            one = (symbol >> (self.bits - 1 - i)) & 1 == 1
            a, b = self._ones(i, low), self._ones(i, high)
            low, high = np.where(one, self.zeros[i] + a, low - a), np.where(one, self.zeros[i] + b, high - b)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it is found before."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at.copy()
        for i in range(self.bits):
            one = (self.words[i][high >> 6] >> (high & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(i, low), self._ones(i, high)
            low, high = np.where(one, self.zeros[i] + a, low - a), np.where(one, self.zeros[i] + b, high - b)
            symbol = symbol << 1 | one
        return symbol, high - low


class FMIndex:
    """Counts and locates runs of symbols (1 and up) in a sequence in which 0 separates."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        if not len(symbols) or symbols[-1] != 0:
            symbols = np.append(symbols, 0)
        bits = max(1, int(alphabet).bit_length())
        order = suffix_order(symbols, bits)
        last = symbols[order - 1]
        self.tree = WaveletTree(last, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        kept = (order % sample == 0) | (last == 0)  # the start of a run is kept, so that no walk crosses a separator
        self.rows = np.flatnonzero(kept)
        self.places = order[self.rows]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (a row of ``phrases``, padded on the left with 0), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.tree.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            live = np.flatnonzero((c > 0) & (low < high))
            c = c[live]
            low[live], high[live] = self.first[c] + self.tree.rank(c, low[live]), self.first[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of the suffix of each row: walk back to a kept one."""
        out = np.full(len(rows), -1, np.int64)
        left, current, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            at = np.minimum(np.searchsorted(self.rows, current), len(self.rows) - 1)
            found = self.rows[at] == current
            out[left[found]] = self.places[at[found]] + steps
            left, current = left[~found], current[~found]
            if len(left):
                symbol, rank = self.tree.symbol_and_rank(current)
                current = self.first[symbol] + rank
            steps += 1
        return out
