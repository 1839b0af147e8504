"""FM-index over integer sequences: wavelet-tree ranks and a sampled suffix array, all in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that is a prefix of another one sorts first."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        held = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1])))
        rank = fresh
        step *= 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return np.argsort(rank, kind="stable")


class WaveletTree:
    """Levels of bits, most significant first; every level is sorted stably by the bit before the next."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            before = self.ones[k][at]
            one = (self.ones[k][at + 1] - before).astype(bool)
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + before, at - before)
        return out


class FMIndex:
    """Backward search over ``seq`` (symbols 1 and up; 0 ends the text and stands between its parts)."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 16) -> None:
        text = np.concatenate((np.asarray(seq, np.int64) + 1, [0]))  # a unique, least end
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(symbols + 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 2))))
        marked = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.kept = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length (a row of symbols each)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column].astype(np.int64) + 1
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix and add the steps."""
        out, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.marks[at + 1] > self.marks[at]
            out[todo[here]] = self.kept[self.marks[at[here]]] + steps
            todo, at, steps = todo[~here], at[~here], steps + 1
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
        return out
