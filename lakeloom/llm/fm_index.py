"""A compressed full-text index over word sequences, with vectorised backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of symbols below ``2 ** levels``: one bit vector per level with
    popcounts by 64-bit block."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.size, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        row = symbols.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[k][word] & ((np.uint64(1) << low) - np.uint64(1))
        return self.blocks[k][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        a, b = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            ra, rb = self._ones(k, a), self._ones(k, b)
            a = np.where(one, self.zeros[k] + ra, a - ra)
            b = np.where(one, self.zeros[k] + rb, b - rb)
        return b - a


    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol, a, b = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = (self.words[k][b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            ra, rb = self._ones(k, a), self._ones(k, b)
            a = np.where(one, self.zeros[k] + ra, a - ra)
            b = np.where(one, self.zeros[k] + rb, b - rb)
        return symbol, b - a


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of values below 2 ** 32."""
    key = (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key)
    ks = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ks[1:] != ks[:-1])]) if len(key) else 0
    return out


#: Every so many-th symbol of a sequence says where it is; others are found by walking back to one.
SAMPLE = 8


class FMIndex:
    """Compressed index of sequences of symbols for patterns of up to ``depth`` symbols.

    ``text`` holds the sequences one after another, each ended by 0; other symbols are positive.
    Suffixes are ordered by doubling.  What is kept is the transformed text in a wavelet
    matrix and, for every SAMPLE-th symbol and the first of each sequence, the sequence it is in.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        self.n_symbols = int(text.max()) + 1 if n else 1
        rank, width = text.astype(np.int64), 1
        while n and (width == 1 or int(rank.max()) + 1 < n):
            shifted = np.zeros(n, np.int64)
            shifted[: max(n - width, 0)] = rank[width:] + 1
            rank = _ranks(rank, shifted)
            width *= 2
        suffixes = np.argsort(rank, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
        del rank
        self.size = n
        self.bwt = WaveletMatrix(text[suffixes - 1], self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        ends = np.concatenate([[False], text == 0])[:n]  # the symbol before is an end
        begin = np.flatnonzero(np.concatenate([[True], ends[1:]])) if n else np.zeros(0, np.int64)
        sequence = np.cumsum(np.concatenate([[True], ends[1:]])) - 1 if n else begin
        known = (np.arange(n) - begin[sequence]) % SAMPLE == 0 if n else ends
        marked = known[suffixes]
        packed = np.packbits(np.concatenate([marked, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.marks, self.marks_before = packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
        self.samples = sequence[suffixes[marked]].astype(np.int32)

    def sequences(self, rows: np.ndarray) -> np.ndarray:
        """The sequences in which the suffixes of these rows begin, by steps back in the text until one
        whose sequence is known."""
        out, live, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            there = (self.marks[word] >> low & np.uint64(1)).astype(bool)
            before = self.marks_before[word[there]] + np.bitwise_count(self.marks[word[there]] & ((np.uint64(1) << low[there]) - np.uint64(1)))
            out[live[there]] = self.samples[before]
            live, at = live[~there], at[~there]
            if len(live):
                symbol, rank = self.bwt.access(at)
                at = self.first[symbol] + rank
        return out

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns with one symbol put before them."""
        start = self.first[symbol]
        return start + self.bwt.rank(symbol, lo), start + self.bwt.rank(symbol, hi)

    def matching(self, text: np.ndarray, ends: np.ndarray, stop: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end position, how many symbols before it match, ``depth`` at
        most, while more than ``stop`` - 1 places do, and the suffix interval of that match."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        live = np.arange(len(ends))
        for step in range(1, self.depth + 1):
            at = ends[live] - step
            ok = at >= 0
            live, at = live[ok], at[ok]
            symbol = text[at]
            ok = symbol > 0
            live, symbol = live[ok], symbol[ok]
            if not len(live):
                break
            a, b = self.extend(symbol, lo[live], hi[live])
            ok = b - a >= stop
            live = live[ok]
            lo[live], hi[live], length[live] = a[ok], b[ok], step
        return length, lo, hi
