"""A full-text index of integer sequences: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in ascending order, by prefix doubling over what is still tied."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    held = ranks[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = np.flatnonzero(np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n))))
    step = 1
    while len(tied):
        at = order[tied]
        after = at + step
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, order[tied] = key[by], at[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Index of runs of symbols 1..top; a run never continues in the next one.

    find() searches many patterns of one length at once, backwards, by rank in a wavelet matrix of
    the Burrows-Wheeler transform. locate() walks back to the next sampled suffix position; the
    first position of every run is sampled, so no walk leaves its run.
    """

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray, top: int, every: int = 8) -> None:
        runs, n = len(run_starts), len(symbols) + len(run_starts)
        self.run_starts = run_starts + np.arange(runs)  # each run is followed by one separator
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[np.append(self.run_starts[1:], n) - 1] = False
        text[inside] = symbols
        ranks = text + runs
        ranks[~inside] = np.arange(runs)
        order = suffix_array(ranks)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (bwt >> level & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(bits)]).astype(np.int32)
            self.levels.append((level, ones, n - int(ones[-1])))
            bwt = np.concatenate([bwt[~bits], bwt[bits]])
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))
        first_of_run = np.zeros(n, bool)
        first_of_run[self.run_starts] = True
        marked = (order % every == 0) | first_of_run[order]
        self.marked, self.samples = np.concatenate([[0], np.cumsum(marked)]), order[marked]
        self.size = n

    def _descend(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            n = ones[rows]
            rows = np.where(symbols >> level & 1, zeros + n, rows - n)
        return rows

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        return self._descend(symbols, rows) - self.first[symbols]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern (one per matrix row)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, column]
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, counted with one separator after each run."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            marked = self.marked[rows + 1] > self.marked[rows]
            out[todo[marked]] = self.samples[self.marked[rows[marked]]] + steps
            todo, rows = todo[~marked], rows[~marked]
            symbols, at = np.zeros(len(rows), np.int64), rows
            for level, ones, zeros in self.levels:
                n = ones[at]
                bit = ones[at + 1] > n
                symbols |= bit.astype(np.int64) << level
                at = np.where(bit, zeros + n, at - n)
            rows = self.before[symbols] + at - self.first[symbols]
            steps += 1
        return out
