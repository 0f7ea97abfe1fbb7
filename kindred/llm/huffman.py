"""Canonical length-limited Huffman codes, and chunks of ids coded with them.

Lengths come from the package-merge method, codes are numbered by (length, symbol). A chunk holds whole
documents; its ids are cut into blocks of equal count whose first bits are listed, so that every block is decoded
on its own. One table lookup of ``LIMIT`` bits gives a symbol and its length; all blocks of a chunk take each step
together.

Chunk layout, little-endian: b"KHUF", u16 version, u16 unused, u32 documents, u32 ids in a block, u64 ids, u64
bytes of code, u64 ids of the shard before this chunk; then i64 doc_id and u8 "doc_id is null" for each document,
u64 ids of each document, u64 first bit of each block, and the code.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

LIMIT = 16
HEAD = struct.Struct("<4sHHIIQQQ")
MAGIC, VERSION = b"KHUF", 1


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal code of at most ``limit`` bits; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    if n <= 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    packages, leaf_at = np.empty(0, np.int64), []
    for _ in range(limit):
        all_ = np.concatenate([weights, packages])
        at = np.argsort(all_, kind="stable")
        leaf_at.append(at < n)
        merged = all_[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    need, got = 2 * n - 2, np.zeros(n, np.int64)
    for leaves in reversed(leaf_at):
        k = int(leaves[:need].sum())
        got[:k] += 1
        need = 2 * (need - k)
    lengths[order] = got
    return lengths


@dataclass
class Code:
    """A canonical code from its lengths."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order].astype(np.int64)
        room = np.int64(1) << (LIMIT - size)
        first = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(order) else np.empty(0, np.int64)
        self.codes = np.zeros(len(self.lengths), np.uint32)
        self.codes[order] = first >> (LIMIT - size)
        self.symbols = np.zeros(1 << LIMIT, np.uint32)
        self.sizes = np.ones(1 << LIMIT, np.uint8)
        filled = int(room.sum())
        self.symbols[:filled] = np.repeat(order, room)
        self.sizes[:filled] = np.repeat(size, room)

    def encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """The code of ``ids`` and the first bit of each block."""
        if not len(ids):
            return b"", np.empty(0, np.uint64)
        kind = np.int32 if len(ids) * LIMIT < 1 << 31 else np.int64
        size = self.lengths[ids].astype(kind)
        end = np.cumsum(size, dtype=kind)
        at = end - size
        word, bit = at >> 5, at & 31
        placed = self.codes[ids].astype(np.uint64) << (64 - bit - size).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(word[-1]) + 2, np.uint64)
        held = word[first]
        out[held] += np.add.reduceat(placed >> np.uint64(32), first)
        out[held + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        code = out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]
        return code, at[::block].astype(np.uint64)

    def decode(self, code: bytes, first: np.ndarray, n: int, block: int) -> np.ndarray:
        """The ``n`` ids of a code, all blocks at once."""
        raw = np.frombuffer(code + b"\0\0\0\0", np.uint8).astype(np.uint32)
        near = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        out = np.zeros((len(first), block), np.uint32)
        at = first.astype(np.int64)
        for step in range(block if n else 0):
            if step == n - (len(first) - 1) * block:  # the last block ends here
                at = at[:-1]
            if not len(at):
                break
            peek = (near[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
            out[: len(at), step] = self.symbols[peek]
            at = at + self.sizes[peek]
        return out.reshape(-1)[:n]


def pack(code: Code, docs: list[tuple[int | None, np.ndarray]], block: int, before: int) -> bytes:
    """A chunk of whole documents."""
    sizes = np.array([len(ids) for _, ids in docs], np.uint64)
    ids = np.concatenate([ids for _, ids in docs])
    bits, first = code.encode(ids, block)
    head = HEAD.pack(MAGIC, VERSION, 0, len(docs), block, len(ids), len(bits), before)
    doc_ids = np.array([i or 0 for i, _ in docs], np.int64)
    nulls = np.array([i is None for i, _ in docs], np.uint8)
    return b"".join([head, doc_ids.tobytes(), nulls.tobytes(), sizes.tobytes(), first.tobytes(), bits])


def unpack(code: Code, chunk: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, ids of each document, all ids, and the ids of the shard before this chunk."""
    magic, version, _, n_docs, block, n, n_bytes, before = HEAD.unpack_from(chunk)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this format")
    at = HEAD.size
    parts = []
    for kind, count in ((np.int64, n_docs), (np.uint8, n_docs), (np.uint64, n_docs), (np.uint64, -(-n // block))):
        parts.append(np.frombuffer(chunk, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, nulls, sizes, first = parts
    ids = code.decode(chunk[at : at + n_bytes], first, n, block)
    return [None if z else int(i) for i, z in zip(doc_ids, nulls, strict=True)], sizes.astype(np.int64), ids, before
