"""A compressed full-text index over word symbols: bounded-depth BWT, wavelet matrix, matching statistics.

Rows of the index are the positions of the text, sorted by the next ``depth`` symbols. That is enough for
intervals of patterns of fewer than ``depth`` symbols. The BWT lies in a wavelet matrix: a bit vector for each bit
of a symbol, packed in 64-bit words with a running count of ones, 1.5 bits for each bit. All queries are vectors:
streamed sequences take each backward step together.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        held = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (held >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words), np.uint32)
            ones[1:] = np.cumsum(np.bitwise_count(words[:-1]))
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(int(self.n - bit.sum()))
            held = np.concatenate([held[bit == 0], held[bit == 1]])

    def _ones_before(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word].astype(np.int64) + np.bitwise_count(self.words[k][word] & below)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``lo`` and before ``hi``."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            up = (symbol >> (self.levels - 1 - k)) & 1 == 1
            moved = []
            for at in (start, lo, hi):
                ones = self._ones_before(k, at)
                moved.append(np.where(up, self.zeros[k] + ones, at - ones))
            start, lo, hi = moved
        return lo - start, hi - start


class FMIndex:
    """An index over sequences of 64-bit word hashes; each sequence has an owner, of which the least counts."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int = 32) -> None:
        self.depth = depth
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        self.sigma = len(self.alphabet) + 1
        n = len(words) + len(sizes)
        text = np.zeros(n, np.int64)  # a 0 ends each sequence
        spot = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text[spot] = symbols + 1
        owner = np.repeat(owners, sizes + 1)
        ranks, rank, h = [text], text, 1
        while h < depth:
            after = np.zeros(n, np.int64)
            after[:-h] = rank[h:] + 1 if h < n else 0
            key = rank * (int(rank.max()) + 2 if n else 1) + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            ranks.append(rank)
            h *= 2
        self.order = np.argsort(rank)
        self.matrix = WaveletMatrix(text[self.order - 1], self.sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.common = self._lcp(ranks)
        self.owner = owner[self.order]
        self._starts: dict[int, np.ndarray] = {}

    def _lcp(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Symbols, ``depth`` at most, that each row has in common with the one before."""
        n = len(self.order)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        length = np.zeros(max(0, n - 1), np.int64)
        live = np.ones(len(length), bool)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(length), bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            if k == len(ranks) - 1:
                length[same], live = self.depth, ~same
                continue
            same &= live
            length[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        return np.concatenate([[0], length])

    def starts(self, length: int) -> np.ndarray:
        """First rows of the groups that have ``length`` symbols in common, and the number of rows."""
        if length not in self._starts:
            self._starts[length] = np.append(np.flatnonzero(self.common < length), len(self.order))
        return self._starts[length]

    def group(self, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        starts = self.starts(length)
        at = np.searchsorted(starts, row, side="right") - 1
        return starts[at], starts[at + 1]

    def least_owner(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the groups with ``length`` common symbols and the least owner in each."""
        starts = self.starts(length)
        return starts, np.minimum.reduceat(self.owner, starts[:-1]) if len(starts) > 1 else self.owner

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; ``sigma`` for those not in the index."""
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == words, at + 1, self.sigma) if len(self.alphabet) else np.full(len(words), self.sigma)

    def matching(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences: for each word the length, below ``depth``, of the longest
        run from it on that the index has, and a row of the index that begins with this run.

        Sequences are read backwards, all at once. A step extends the interval to the left; where that leaves
        nothing, the run loses words at its right end until it can be extended.
        """
        symbols = self.symbols(words)
        length = np.zeros(len(words), np.int64)
        row = np.zeros(len(words), np.int64)
        order = np.argsort(-sizes, kind="stable")
        at = np.cumsum(sizes)[order] - 1
        sizes = sizes[order]
        n = len(self.order)
        lo, hi, run = np.zeros(len(at), np.int64), np.full(len(at), n), np.zeros(len(at), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # those with more than ``step`` words
            at, lo, hi, run = at[:live], lo[:live], hi[:live], run[:live]
            now = at - step
            symbol = symbols[now]
            full = run == self.depth - 1
            run[full] -= 1
            if full.any():
                lo[full], hi[full] = self.group(lo[full], self.depth - 2)
            open_ = np.flatnonzero(symbol < self.sigma)
            lost = symbol == self.sigma
            lo[lost], hi[lost], run[lost] = 0, n, 0
            while len(open_):
                s = symbol[open_]
                left, right = self.matrix.rank(s, lo[open_], hi[open_])
                good = right > left
                done = open_[good]
                lo[done], hi[done] = self.before[s[good]] + left[good], self.before[s[good]] + right[good]
                run[done] += 1
                open_ = open_[~good]
                for r in np.unique(run[open_]):
                    some = open_[run[open_] == r]
                    run[some] = r - 1
                    lo[some], hi[some] = self.group(lo[some], r - 1) if r > 1 else (0, n)
            length[now], row[now] = run, lo
        return length, row
