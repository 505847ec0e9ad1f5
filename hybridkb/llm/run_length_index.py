"""A run-length compressed Burrows-Wheeler index of many short texts, and matching statistics streamed on it."""

from __future__ import annotations

import numpy as np

from hybridkb.llm.common import powers, prefix_hash


CHUNK = 1 << 14  # suffixes that are compared at a time


class RunLengthIndex:
    """Texts lie one after the other, each ended by a 0; other symbols are 1 + byte + 256 * family, and
    only texts and patterns of one family can match. Equal suffixes are
    ordered by text. Kept: the runs of the BWT, per symbol their places and counts, and the suffix array only
    at the first and last row of each run."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.text = symbols
        order = self._suffixes(symbols, longest)
        bwt = symbols[order - 1]  # the symbol before text 0 is the last end mark
        first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        last = np.concatenate((first[1:], [len(bwt)])) - 1
        self.first, self.last, self.head = first, last, bwt[first].astype(np.int64)
        self.sample_first, self.sample_last = order[first], order[last]
        lengths = last - first + 1
        self.by_symbol = np.argsort(self.head, kind="stable")
        self.n_runs = len(first)
        self.keys = self.head[self.by_symbol] * (self.n_runs + 1) + self.by_symbol
        total = np.cumsum(lengths[self.by_symbol]) - lengths[self.by_symbol]
        # LF of a run's first row: rows of smaller symbols, and of the same symbol in earlier runs, come before.
        self.lf_first = np.empty(self.n_runs, dtype=np.int64)
        self.lf_first[self.by_symbol] = total
        self.hash = prefix_hash((symbols & 255).astype(np.uint8))

    @staticmethod
    def _suffixes(symbols: np.ndarray, longest: int) -> np.ndarray:
        n = len(symbols)
        end = np.flatnonzero(symbols == 0)
        left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)  # symbols before the end mark
        rank, h = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        bits = int(rank.max() + 1).bit_length()
        while 2 * h * bits <= 62:
            second = np.zeros(n, dtype=np.int64)
            second[:-h] = np.where(left[:-h] >= h, rank[h:], 0)
            rank = (rank << (bits * h)) | second
            h *= 2
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        while h <= longest:
            second = np.zeros(n, dtype=np.int64)
            second[:-h] = np.where(left[:-h] >= h, rank[h:] + 1, 0)
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
            h *= 2
        return np.argsort(rank, kind="stable")

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most ``most``: found by hash, then held
        against the symbols, which can only shorten it."""
        n, h = len(self.text), self.hash
        lo, hi = np.zeros_like(most), np.minimum(most, n - np.maximum(a, b))
        down = powers(n + 1)[1]
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi + 1) >> 1
            same = (h[a + mid] - h[a]) * down[a] == (h[b + mid] - h[b]) * down[b]
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        for x in range(0, len(lo), CHUNK):
            n = lo[x : x + CHUNK]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            differ = np.flatnonzero(self.text[a[x : x + CHUNK][row] + at] != self.text[b[x : x + CHUNK][row] + at])
            np.minimum.at(lo, x + row[differ], at[differ])
        return lo

    def matching(self, patterns: np.ndarray, ends: np.ndarray, sizes: np.ndarray, cap: int):
        """Stream the patterns backwards, all in step; yields (pattern numbers, starts within them, lengths of
        the longest match with the index that begins there, exact up to ``cap``)."""
        live = np.flatnonzero(sizes > 0)
        row = np.zeros(len(sizes), dtype=np.int64)
        place = np.full(len(sizes), self.sample_first[0])
        length = np.zeros(len(sizes), dtype=np.int64)
        step = 0
        while len(live):
            c = patterns[ends[live] - 1 - step].astype(np.int64)
            q, j, m = row[live], place[live], length[live]
            run = np.searchsorted(self.first, q, side="right") - 1
            fits = self.head[run] == c
            miss = np.flatnonzero(~fits)
            if len(miss):
                at = np.searchsorted(self.keys, c[miss] * (self.n_runs + 1) + run[miss])
                up, down = at - 1, np.minimum(at, self.n_runs - 1)
                up_ok = (up >= 0) & (self.head[self.by_symbol[up]] == c[miss])
                down_ok = (at < self.n_runs) & (self.head[self.by_symbol[down]] == c[miss])
                run_up, run_down = self.by_symbol[up], self.by_symbol[down]
                want = np.minimum(m[miss], cap)
                by_up = np.where(up_ok, self._common(self.sample_last[run_up], j[miss], want), -1)
                by_down = np.where(down_ok, self._common(self.sample_first[run_down], j[miss], want), -1)
                take_up = by_up >= by_down
                run[miss] = np.where(take_up, run_up, run_down)
                q[miss] = np.where(take_up, self.last[run_up], self.first[run_down])
                j[miss] = np.where(take_up, self.sample_last[run_up], self.sample_first[run_down])
                m[miss] = np.maximum(by_up, by_down)
            known = m >= 0
            row[live] = np.where(known, self.lf_first[run] + q - self.first[run], 0)
            place[live] = np.where(known, j - 1, self.sample_first[0])
            length[live] = np.where(known, m + 1, 0)
            yield live, sizes[live] - 1 - step, length[live]
            step += 1
            live = live[sizes[live] > step]
