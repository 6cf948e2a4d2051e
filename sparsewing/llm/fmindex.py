"""A full-text index of an integer sequence: Burrows-Wheeler transform, wavelet tree, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of ``x`` (a unique smallest symbol must end it) in order, by prefix doubling on the ranks still tied."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first[np.cumsum(new) - 1]  # rank: the position at which the group of equal prefixes begins
    h = 1
    size = np.diff(np.concatenate((first, [n])))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        at = order[tied]
        group, nxt = rank[at], np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        o = np.lexsort((nxt, group))
        at, group, nxt = at[o], group[o], nxt[o]
        order[tied] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])))
        first = np.flatnonzero(new)
        rank[at] = tied[first][np.cumsum(new) - 1]
        size = np.diff(np.concatenate((first, [len(at)])))
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return order


class WaveletTree:
    """Ranks of symbols below 2**bits in a sequence, level by level from the highest bit (a wavelet matrix)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``sym`` stands before position ``at``, element by element."""
        lo, hi = np.zeros(len(sym), dtype=np.int64), at.astype(np.int64)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (sym >> (self.bits - 1 - k)) & 1 == 1
            lo, hi = np.where(bit, zeros + ones[lo], lo - ones[lo]), np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def get(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """``seq``: symbols 1..top. ``sample``: every so many positions a suffix position is kept."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = 8):
        x = np.concatenate((np.asarray(seq, dtype=np.int64) + 1, [0]))
        sa = suffix_array(x)
        bwt = x[sa - 1]
        self.n = len(x)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=top + 2))))
        self.tree = WaveletTree(bwt, max(1, int(top + 1).bit_length()))
        keep = sa % sample == 0
        self.kept_upto = np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))
        self.kept = sa[keep]

    def step(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        base = self.less[sym]
        both = self.tree.rank(np.concatenate((sym, sym)), np.concatenate((lo, hi)))
        return base + both[: len(sym)], base + both[len(sym) :]

    def search(self, phrases: np.ndarray, length: np.ndarray):
        """Rows of ``phrases`` hold symbols at the right end. Backward search of all rows at once: [lo, hi) of each."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for k in range(width):
            act = np.flatnonzero((k < length) & (lo < hi))
            if not len(act):
                continue
            lo[act], hi[act] = self.step(phrases[act, width - 1 - k] + 1, lo[act], hi[act])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to the nearest sampled position."""
        out, walk, at, todo = np.empty(len(rows), dtype=np.int64), 0, rows.astype(np.int64), np.arange(len(rows))
        while len(todo):
            hit = self.kept_upto[at + 1] - self.kept_upto[at] == 1
            out[todo[hit]] = self.kept[self.kept_upto[at[hit]]] + walk
            todo, at = todo[~hit], at[~hit]
            sym = self.tree.get(at)
            at = self.less[sym] + self.tree.rank(sym, at)
            walk += 1
        return out
