"""An FM-index over a sequence of word numbers: sorted suffixes, a wavelet tree for ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Symbols in one index; two ranks and a position then sort as one number of 60 bits.
MAX_WORDS = (1 << 20) - 32
SAMPLE = 16


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text whose last symbol occurs once, by prefix doubling with packed sorts.

    A rank is the first slot of a group of equal prefixes. Each round sorts only suffixes whose group is not yet a single one.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    mask = (1 << bits) - 1
    sym_bits = max(1, int(text.max() + 1).bit_length())
    span = min(n, max(1, (62 - bits) // sym_bits))
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= sym_bits
        key[: n - k] |= text[k:].astype(np.int64) + 1
    slots, pos = np.arange(n), np.arange(n)
    key, order, rank = (key << bits) | pos, np.empty(n, np.int64), np.empty(n, np.int64)
    while True:
        key.sort()
        pos = key & mask
        order[slots] = pos
        new = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:] >> bits, key[:-1] >> bits, out=new[1:-1])
        starts = np.flatnonzero(new)
        rank[pos] = np.repeat(slots[starts[:-1]], np.diff(starts))
        open_ = ~(new[:-1] & new[1:])
        slots, pos = slots[open_], pos[open_]
        if not len(slots):
            return order
        # The last symbol is unique, so an open group never reaches beyond the end.
        key = (((rank[pos] << bits) | rank[pos + span]) << bits) | pos
        span *= 2


class WaveletTree:
    """Ranks of symbols in prefixes of a sequence, one bit vector a level (most significant bit first)."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros, cur = [], [], seq.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            on = bit.astype(bool)
            cur = np.concatenate([cur[~on], cur[on]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the prefix of each length."""
        lo, hi = np.zeros_like(ends), ends
        for k in range(self.levels):
            on = (symbols >> (self.levels - 1 - k)) & 1 == 1
            ones = self.ones[k]
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(on, self.zeros[k] + a, lo - a), np.where(on, self.zeros[k] + b, hi - b)
        return hi - lo

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        out, lo = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.levels):
            ones = self.ones[k]
            a, on = ones[at], ones[at + 1] > ones[at]
            b = ones[lo]
            out = out * 2 + on
            at, lo = np.where(on, self.zeros[k] + a, at - a), np.where(on, self.zeros[k] + b, lo - b)
        return out, at - lo


class FMIndex:
    """Finds patterns in a sequence of up to ``MAX_WORDS`` symbols, which run from 0 to ``n_symbols`` - 1."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        # The end marker takes 0, all other symbols move up by one.
        self.seq_len = len(seq)
        text = np.concatenate([seq.astype(np.int64) + 1, [0]])
        order = sorted_suffixes(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, n_symbols + 1)
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        marked = order % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (rows of ``patterns``, left-aligned), by steps from each pattern's last symbol to its first."""
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.seq_len + 1, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            sym = patterns[live, lengths[live] - 1 - step] + 1
            lo[live] = self.first[sym] + self.tree.rank(sym, lo[live])
            hi[live] = self.first[sym] + self.tree.rank(sym, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a row whose position is stored."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            hit = self.marked[here + 1] > self.marked[here]
            done = open_[hit]
            out[done] = self.samples[self.marked[at[done]]] + steps[done]
            open_ = open_[~hit]
            sym, rank = self.tree.symbol(at[open_])
            at[open_] = self.first[sym] + rank
            steps[open_] += 1
        return out
