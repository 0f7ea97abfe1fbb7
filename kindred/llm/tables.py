"""Vectorised hash tables from 64-bit keys to rows of floats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from kindred.llm.text import U64

SPREAD = U64(0x9E3779B97F4A7C15)
#: Marks free slots; keys are kept one higher, so this one is not for use.
FREE = U64(0)


class HashTable:
    """Open addressing with linear probes over fixed keys (all below 2**64 - 1, distinct)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(1.6 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, values.dtype)
        held, at = keys + U64(1), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == FREE
            some = left[free]
            self.keys[at[some]] = held[some]
            won = self.keys[at[left]] == held[left]
            done = left[won]
            self.values[at[done]] = values[done]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, self.values.dtype)
        at = self._slot(keys)
        held = self.keys[at]
        good = held == keys + U64(1)
        out[good] = self.values[at[good]]
        left = np.flatnonzero(~good & (held != FREE))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            good = held == keys[left] + U64(1)
            out[left[good]] = self.values[at[good]]
            more = ~good & (held != FREE)
            left, at = left[more], at[more]
        return out


class Remembered:
    """Rows computed from keys, kept in a direct-mapped table of fixed size; keys that clash are computed anew."""

    def __init__(self, compute: Callable[[np.ndarray], np.ndarray], width: int, bits: int) -> None:
        self.compute, self.shift = compute, U64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros((1 << bits, width), np.float32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * SPREAD) >> self.shift).astype(np.int64)
        new = np.flatnonzero(self.keys[at] != keys + U64(1))
        if not len(new):
            return self.rows[at]
        some, inverse = np.unique(keys[new], return_inverse=True)
        rows = self.compute(some)
        slots = ((some * SPREAD) >> self.shift).astype(np.int64)
        free = self.keys[slots] == FREE
        slots, mine = slots[free], np.flatnonzero(free)
        self.keys[slots] = some[mine] + U64(1)
        won = self.keys[slots] == some[mine] + U64(1)
        self.rows[slots[won]] = rows[mine[won]]
        out = self.rows[at]
        out[new] = rows[inverse]
        return out
