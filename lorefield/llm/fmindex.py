"""FM-index over word numbers: suffix sorting, a wavelet matrix for ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 ends a passage; each 0 sorts by its place, so no comparison crosses one."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (n + int(symbols.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        in_order = key[order]
        new[order] = np.cumsum(np.concatenate(([0], in_order[1:] != in_order[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of a symbol in any prefix of a sequence, one bit level at a time, for many queries at once."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(len(level) - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place at[i]."""
        low, high = np.zeros_like(at), at
        for level, shift in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = (symbol >> shift) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Search index of one shard of passages, a symbol array in which 0 ends each passage."""

    def __init__(self, symbols: np.ndarray, sample_every: int = 16):
        order = suffix_order(symbols)
        self.size = len(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix; the first suffix is preceded by the closing 0
        self.ranks = WaveletMatrix(self.last)
        counts = np.bincount(symbols, minlength=1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        sampled = (order % sample_every == 0) | (self.last == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each phrase, a row of `phrases`, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        top = len(self.before) - 2
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 0):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, lengths[live] - back].astype(np.int64)
            known = symbol <= top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            base = self.before[symbol]
            low[live], high[live] = base + self.ranks.rank(symbol, low[live]), base + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back to the next sampled row and add the steps."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            now = at[open_]
            done = self.sampled[now + 1] > self.sampled[now]
            hit = open_[done]
            out[hit] = self.places[self.sampled[now[done]]] + steps[hit]
            open_, now = open_[~done], now[~done]
            symbol = self.last[now].astype(np.int64)
            at[open_] = self.before[symbol] + self.ranks.rank(symbol, now)
            steps[open_] += 1
        return out
