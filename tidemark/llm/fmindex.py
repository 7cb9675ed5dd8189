"""An FM-index over words: suffix order, wavelet ranks, sampled positions. All array work is numpy."""

from __future__ import annotations

import io

import numpy as np

SEPARATOR = 0
SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; separators differ from each other, earlier ones being less.

    Prefix doubling from as many symbols as fit a 64-bit key, sorting again only
    what is still tied, so long repeats cost in proportion to their own length.
    """
    n = len(symbols)
    separators = np.flatnonzero(symbols == SEPARATOR)
    values = symbols.astype(np.int64) + len(separators)
    values[separators] = np.arange(len(separators))
    bits = int(values.max(initial=0) + 1).bit_length()
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for ahead in range(depth):
        key <<= bits
        key[: max(0, n - ahead)] += values[ahead:] + 1
    order = np.argsort(key)
    ranked = key[order]
    opens = np.ones(n, bool)
    opens[1:] = ranked[1:] != ranked[:-1]
    head = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    tied = ~opens
    tied[:-1] |= ~opens[1:]
    rows = np.flatnonzero(tied)
    while len(rows):
        starts = order[rows]
        ahead = starts + depth
        key = head[rows] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, starts = key[by], starts[by]
        order[rows] = starts
        fresh = np.ones(len(rows), bool)
        fresh[1:] = key[1:] != key[:-1]
        now = np.maximum.accumulate(np.where(fresh, rows, 0))
        head[rows] = now
        rank[starts] = now
        still = ~fresh
        still[:-1] |= ~fresh[1:]
        rows = rows[still]
        depth *= 2
    return order


class _Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1]
        self.ones = int(ones.sum())

    @classmethod
    def of(cls, bits: np.ndarray) -> _Bits:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        return cls(packed.view("<u8"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of a symbol, highest first."""

    def __init__(self, levels: list[_Bits], size: int, n_symbols: int):
        self.levels, self.depth = levels, len(levels)
        self.zeros = [size - level.ones for level in levels]
        every = np.arange(n_symbols)
        self.begin = self._down(every, np.zeros(n_symbols, np.int64))

    @classmethod
    def of(cls, symbols: np.ndarray, n_symbols: int) -> Wavelet:
        size, depth = len(symbols), max(1, int(n_symbols - 1).bit_length())
        levels = []
        for level in range(depth):
            bit = (symbols >> (depth - 1 - level)) & 1 == 1
            levels.append(_Bits.of(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        return cls(levels, size, n_symbols)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            one = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1 == 1, self.zeros[level] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for level, bits in enumerate(self.levels):
            bit, one = bits.get(at), bits.rank(at)
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + one, at - one)
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Symbols of several texts, each ended by SEPARATOR. It can be written as bytes and read again."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], SEPARATOR)
        # a walk back must not leave its text, so the texts' starts are sampled too
        kept = (order % SAMPLE == 0) | (before == SEPARATOR)
        self._hold(np.bincount(symbols, minlength=n_symbols), Wavelet.of(before, n_symbols), _Bits.of(kept), order[kept].astype(np.int32))

    def _hold(self, counts: np.ndarray, wavelet: Wavelet, kept: _Bits, samples: np.ndarray) -> None:
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.size, self.wavelet, self.kept, self.samples = int(self.first[-1]), wavelet, kept, samples

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = np.stack([level.words for level in self.wavelet.levels])
        np.savez(out, counts=np.diff(self.first).astype(np.int32), levels=levels, kept=self.kept.words, samples=self.samples)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FMIndex:
        index = cls.__new__(cls)
        with np.load(io.BytesIO(raw), allow_pickle=False) as held:
            counts = held["counts"].astype(np.int64)
            wavelet = Wavelet([_Bits(words) for words in held["levels"]], int(counts.sum()), len(counts))
            index._hold(counts, wavelet, _Bits(held["kept"]), held["samples"])
        return index

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that begin with each pattern (one in each line): [low, high)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the symbols the suffixes of the given rows start."""
        found, steps = np.empty(len(rows), np.int64), 0
        waiting, rows = np.arange(len(rows)), rows.copy()
        while len(waiting):
            known = self.kept.get(rows) == 1
            found[waiting[known]] = self.samples[self.kept.rank(rows[known])] + steps
            waiting, rows = waiting[~known], rows[~known]
            symbol, nth = self.wavelet.access(rows)
            rows = self.first[symbol] + nth
            steps += 1
        return found
