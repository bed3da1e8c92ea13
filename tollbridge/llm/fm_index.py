"""A compressed FM-index of word sequences: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` symbols, or more, by doubling the length compared."""
    n, rank, width = len(symbols), symbols.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
        if width >= depth or steps[-1] == n - 1:
            return order


class WaveletMatrix:
    """Counts of a symbol in a prefix of a sequence, from one packed bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for shift in range(self.bits - 1, -1, -1):
            bit = ((now >> shift) & 1).astype(bool)
            packed = np.zeros(8 * (len(bit) // 64 + 1), np.uint8)
            packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(n_symbols)
        self.start = np.zeros(n_symbols, np.int64)
        self.start = self.rank(every, np.zeros(n_symbols, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for words, counts, zeros, shift in zip(self.words, self.counts, self.zeros, range(self.bits - 1, -1, -1)):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at - self.start[symbol]


class FmIndex:
    """The index of several sequences, each of a weight: how often it is in the corpus."""

    def __init__(self, sequences: list[np.ndarray], weights: list[int]):
        sizes = np.array([len(s) for s in sequences])
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        known, dense = np.unique(np.concatenate(sequences), return_inverse=True)
        self.symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        self.symbols[np.arange(len(dense)) + np.repeat(np.arange(len(sizes)), sizes)] = dense + 1
        self.sizes, n_symbols = sizes, len(known) + 1
        order = sort_suffixes(self.symbols, int(sizes.max()) + 2)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=n_symbols))])
        self.tree = WaveletMatrix(self.symbols[order - 1], n_symbols)
        owner = np.repeat(np.array(weights, np.int64), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(owner[order])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges of the suffixes that begin with the symbol and then as before."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def repeated(self, window: int, least: int = 2) -> np.ndarray:
        """For each place, whether the ``window`` symbols from there on are in the corpus ``least`` times.

        The sequences are streamed from right to left, all at a time. A match [i, e) grows to the left
        while it is frequent enough. If it stops at i, the longest match that begins at i is found by
        doubling and halving its length, and goes on from there: no place's matching statistic is lost.
        """
        found = np.zeros(len(self.symbols), bool)
        own = np.flatnonzero(self.sizes >= window)
        first, end = self.first[own], self.sizes[own].copy()
        at, low, high = end - 1, np.zeros(len(own), np.int64), np.full(len(own), len(self.symbols))
        # a probe looks for [stuck, end); good and bad are lengths known to be frequent and not to be
        probe, stuck = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
        good, bad, good_low, good_high = (np.zeros(len(own), np.int64) for _ in range(4))
        while len(first):
            symbol = self.symbols[first + at]
            new_low, new_high = self.extend(symbol, low, high)
            fits = self.weight[new_high] - self.weight[new_low] >= least
            low, high = np.where(fits, new_low, low), np.where(fits, new_high, high)
            mark = fits & ~probe & (end - at >= window)
            found[(first + at)[mark]] = True
            reached = fits & probe & (at == stuck)
            good = np.where(reached, end - stuck, good)
            good_low, good_high = np.where(reached, low, good_low), np.where(reached, high, good_high)
            missed = ~fits & probe
            bad = np.where(missed, end - stuck, bad)
            fell = ~fits & ~probe
            stuck = np.where(fell, at, stuck)
            bad, good = np.where(fell, end - at, bad), np.where(fell, 0, good)
            at = at - fits
            turn = reached | missed | fell
            settled = turn & (bad - good == 1)
            found[(first + stuck)[settled & (good >= window)]] = True
            end = np.where(settled, stuck + good, end)
            at = np.where(settled, stuck - 1, at)
            whole = settled & (good == 0)
            low = np.where(whole, 0, np.where(settled, good_low, low))
            high = np.where(whole, len(self.symbols), np.where(settled, good_high, high))
            again = turn & ~settled
            length = np.where(good == 0, 1, np.minimum(2 * good, (good + bad) // 2))
            end = np.where(again, stuck + length, end)
            at = np.where(again, end - 1, at)
            low, high = np.where(again, 0, low), np.where(again, len(self.symbols), high)
            probe = (probe & ~settled) | again
            # a main search is over at the sequence's start, or when no window ends before its match does
            goes_on = probe | ((at >= 0) & (end >= window))
            if not goes_on.all():
                first, end, at, low, high, probe, stuck, good, bad, good_low, good_high = (
                    x[goes_on] for x in (first, end, at, low, high, probe, stuck, good, bad, good_low, good_high)
                )
        return found
