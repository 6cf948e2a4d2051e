"""A two-level n-gram trie in Elias-Fano form, kept in one memory-mapped region: a file's, or anonymous memory.

Level 1 holds the contexts (hashes, ascending) as an Elias-Fano sequence, monotone Elias-Fano pointers to each context's
successors, and a quantised back-off weight per context. Level 2 holds all successors as one Elias-Fano sequence of
``rank of the context * 2**FINGER + fingerprint of the word``, so a successor search looks only at the part of
the sequence that belongs to the context, with one quantised probability each.
"""

from __future__ import annotations

import mmap

import numpy as np

FINGER = 40
#: Codes count 1/STEP of a decimal order of magnitude below 1; they reach below the smallest double.
STEP = 32
U64 = np.uint64


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities to codes, rounded towards smaller probabilities, so that no distribution sums to more than before."""
    return np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEP - 1e-9).astype(np.uint16)


class EliasFano:
    """A non-decreasing sequence of uint64: ``low`` bits packed, ``high`` parts in unary, ranks kept for every word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if top > n else 0
        upper = (values >> U64(bits)).astype(np.int64)
        flags = np.zeros(n + (int(upper[-1]) if n else 0) + 65 & ~63, dtype=np.uint8)
        flags[upper + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        low = np.zeros(n * bits // 64 + 2, dtype=U64)
        if bits:
            part = values & ((U64(1) << U64(bits)) - U64(1))
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << off)
            over = np.flatnonzero((off.astype(np.int64) + bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64)))).astype(np.uint32)
        return cls(n, bits, low, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], dtype=U64), self.low, self.high, self.zeros]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero number ``k`` (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left = k - self.zeros[word]
        x, at = ~self.high[word], np.zeros(len(k), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & ((U64(1) << U64(half)) - U64(1))).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            at += np.where(go, half, 0)
            x = np.where(go, x >> U64(half), x)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=U64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(U64)
        x = self.low[word] >> off
        x |= np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return x & ((U64(1) << U64(self.bits)) - U64(1))

    def _bucket(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last index of the values with this high part."""
        zeros = int(self.zeros[-1])
        inside = np.minimum(upper, zeros - 1)
        end = self._select0(inside) - inside
        before = np.maximum(inside - 1, 0)
        begin = np.where(inside > 0, self._select0(before) - before, 0)
        out = upper >= zeros
        return np.where(out, self.n, begin), np.where(out, self.n, end)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the successor of ``x`` is sought within the bucket of its high part."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        lo, hi = self._bucket((x >> U64(self.bits)).astype(np.int64))
        end = hi.copy()
        want = x & ((U64(1) << U64(self.bits)) - U64(1)) if self.bits else np.zeros(len(x), dtype=U64)
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            less = self._low(mid) < want[act]
            lo[act] = np.where(less, mid + 1, lo[act])
            hi[act] = np.where(less, hi[act], mid)
            act = act[lo[act] < hi[act]]
        ok = lo < end
        at = np.minimum(lo, self.n - 1)
        return np.where(ok & (self._low(at) == want), lo, -1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index (selecting the ones of the unary part)."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.minimum(np.searchsorted(ones, i, side="right") - 1, len(self.high) - 1)
        left = i - ones[word]
        x, at = self.high[word], np.zeros(len(i), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & ((U64(1) << U64(half)) - U64(1))).astype(np.int64)
            go = left >= c
            left = np.where(go, left - c, left)
            at += np.where(go, half, 0)
            x = np.where(go, x >> U64(half), x)
        return ((word * 64 + at - i).astype(U64) << U64(self.bits)) | self._low(i)


class Trie:
    """Laid out by ``pack`` or written by ``write``, and read from the mapped bytes."""

    def __init__(self, held):
        """``held``: the path of a file, or the mapping that ``pack`` returned."""
        raw = np.memmap(held, dtype=U64, mode="r") if isinstance(held, str) else np.frombuffer(held, dtype=U64)
        self.parts, at = [], 1
        for _ in range(int(raw[0])):
            size = int(raw[at])
            self.parts.append(raw[at + 1 : at + 1 + size])
            at += 1 + size
        ef = []
        for k in range(3):
            n, bits, a, b = (int(v) for v in self.parts[4 * k])
            ef.append(EliasFano(n, bits, self.parts[4 * k + 1][:a], self.parts[4 * k + 2][:b], self.parts[4 * k + 3].view(np.uint32)[: b + 1]))
        self.contexts, self.pointers, self.successors = ef
        self.backoff, self.prob = (self.parts[12 + k].view(np.uint16) for k in range(2))

    @staticmethod
    def _parts(contexts: np.ndarray, first: np.ndarray, words: np.ndarray, backoff: np.ndarray, prob: np.ndarray) -> list[bytes]:
        """contexts: ascending hashes; first: index of each context's first successor, and one past the last; words:
        fingerprints, ascending within a context; backoff, prob: codes."""
        rank = np.repeat(np.arange(len(contexts), dtype=U64), np.diff(first))
        levels = [EliasFano.build(contexts), EliasFano.build(first.astype(U64)), EliasFano.build((rank << U64(FINGER)) | words)]
        parts = [a for e in levels for a in e.arrays()] + [backoff.astype(np.uint16), prob.astype(np.uint16)]
        out = [np.array([len(parts)], dtype=U64).tobytes()]
        for a in parts:
            raw = a.tobytes()
            out += [np.array([(len(raw) + 7) // 8], dtype=U64).tobytes(), raw, bytes(-len(raw) % 8)]
        return out

    @staticmethod
    def pack(*levels: np.ndarray) -> mmap.mmap:
        """The trie in an anonymous mapping, which belongs to the task and to no folder."""
        parts = Trie._parts(*levels)
        held = mmap.mmap(-1, sum(map(len, parts)))
        for raw in parts:
            held.write(raw)
        return held

    @staticmethod
    def write(path: str, *levels: np.ndarray) -> None:
        with open(path, "wb") as f:
            f.writelines(Trie._parts(*levels))

    def search(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams (-1: unseen) and of the contexts' back-off weights (0 for unknown contexts)."""
        rank = self.contexts.find(context)
        known = rank >= 0
        at = np.full(len(word), -1, dtype=np.int64)
        at[known] = self.successors.find((rank[known].astype(U64) << U64(FINGER)) | word[known])
        if known.any():  # the hit must lie between the context's pointers
            r = rank[known]
            a, b = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
            at[known] = np.where((at[known] >= a) & (at[known] < b), at[known], -1)
        code = np.where(at >= 0, self.prob[np.maximum(at, 0)].astype(np.int64) if len(self.prob) else -1, -1)
        back = np.where(known, self.backoff[np.maximum(rank, 0)].astype(np.int64) if len(self.backoff) else 0, 0)
        return code, back
