"""The md5 of ``tag:...:number`` for many whole numbers at once, as ``rng.digest`` has it for a column.

A digest of a short text is 64 steps on 32-bit words, which are taken for all numbers together. Texts of more than one
block of md5, and numbers below 0, go one by one.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LONGEST = 55


class Numbers:
    """Whole numbers with their decimal digits, by how many they have."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, dtype=np.int64)
        self.groups, self.odd = [], np.flatnonzero(self.values < 0)
        size = np.where(self.values < 0, 0, 1)
        for n in range(1, 19):
            size[self.values >= 10**n] = n + 1
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            rest, digits = self.values[at], []
            for _ in range(n):
                high = rest // 10
                digits.append((rest - 10 * high + 48).astype(np.uint32))
                rest = high
            self.groups.append((at, digits[::-1]))


def digests(front: str, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 64 bits of the md5 of ``front`` and each number; their order is that of the hexadecimal strings."""
    head, n = front.encode(), len(numbers.values)
    fits = [(at, digits) for at, digits in numbers.groups if len(head) + len(digits) <= _LONGEST]
    a, b, c, d = (x.byteswap().astype(np.uint64) for x in _short(head, fits, n))
    first, last = (a << np.uint64(32)) | b, (c << np.uint64(32)) | d
    alone = [numbers.odd, *(at for at, digits in numbers.groups if len(head) + len(digits) > _LONGEST)]
    for at in np.concatenate(alone).tolist():
        raw = md5(head + str(int(numbers.values[at])).encode()).digest()
        first[at], last[at] = int.from_bytes(raw[:8]), int.from_bytes(raw[8:])
    return first, last


def _short(head: bytes, groups: list, n: int) -> list[np.ndarray]:
    fixed = bytearray(64)
    fixed[: min(len(head), 64)] = head[:64]
    plain = [int.from_bytes(fixed[4 * i : 4 * i + 4], "little") for i in range(16)]
    words: dict[int, np.ndarray] = {}
    for at, digits in groups:
        size = len(head) + len(digits)
        for i, x in enumerate([*digits, np.uint32(0x80)], len(head)):
            words.setdefault(i // 4, np.zeros(n, np.uint32))[at] |= x << np.uint32(8 * (i % 4))
        words.setdefault(14, np.zeros(n, np.uint32))[at] |= np.uint32(8 * size)
    sizes = {len(digits) for _, digits in groups}
    if len(sizes) == 1:  # the same length everywhere
        words.pop(14, None)
        plain[14] = 8 * (len(head) + sizes.pop())
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        w = _WORD[i]
        np.add(f, np.uint32((_ADD[i] + plain[w]) & 0xFFFFFFFF), out=f)
        if w in words:
            np.add(f, words[w], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # the old a is used up
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]
