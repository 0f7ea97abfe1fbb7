"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has next to no Jaccard similarity with the whole of it, so items are
partitioned by size (powers of two of their shingle positions) and, for each partition, documents are cut into
overlapping segments of twice its upper bound. Within such a segment an item of the partition has a similarity
of at least 0.8 / 4.2 if the segment has 0.8 of it; ``coords`` coordinates then all miss with a chance of
0.81 ** coords. One equal coordinate makes a candidate, which the exact share of the item's shingles among those
of the whole document confirms.

That holds for items whose distinct shingles are in the class of their positions. Repetitive items, and those of
fewer than 8 distinct shingles, are looked up exactly: one more of their shingles than a document may lack are
posted, and a document that has any of these is a candidate.

Items are taken in slices of bounded size, each matched against all documents in one pass without a shuffle.

Rows: null and empty texts hold nothing, on either side. An item with fewer words than a shingle is one
sequence of its words, looked for as such. Items or documents with the same id are judged one by one; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import U64, groups, lower_ascii, map_groups, rows, windows, word_hashes

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_found long, containment double"


@dataclass(frozen=True)
class Search:
    shingle: int = 5
    #: Least percent of an item's distinct shingles that the document has.
    percent: int = 80
    coords: int = 64
    #: Bounds of one slice of items: so many, and so many bytes of text, are expected in it.
    slice_items: int = 20_000
    slice_bytes: int = 16 << 20
    seed: int = 11


@dataclass
class Partition:
    """The items of one size class: ``values`` and ``owners`` sorted by value for each coordinate."""

    stride: int
    values: list[np.ndarray]
    owners: list[np.ndarray]
    likely: list[np.ndarray]


class ItemIndex:
    def __init__(self, items: list[tuple[int, bytes]], search: Search) -> None:
        self.search = search
        rng = np.random.default_rng(search.seed)
        self.a = rng.integers(0, 1 << 63, search.coords, np.uint64) << U64(1) | U64(1)
        self.b = rng.integers(0, 1 << 63, search.coords, np.uint64)
        self.ids, self.sets, self.width = [], [], []
        classes: dict[int, list[int]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = lower_ascii(text or b"").split()
            if not words:
                continue
            n = min(search.shingle, len(words))
            held = windows(word_hashes(words), n)
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(np.unique(held))
            self.width.append(n)
            distinct = len(self.sets[at])
            if distinct < 8 or distinct.bit_length() != len(held).bit_length():
                lacking = distinct + search.percent * -distinct // 100
                for h in self.sets[at][: lacking + 1].tolist():
                    self.short[n][h].append(at)
            else:
                classes[distinct.bit_length() - 1].append(at)
        self.wanted = {}
        for n, table in self.short.items():
            likely = np.zeros(1 << 16, bool)
            likely[(values := np.array(sorted(table), U64)) & U64(0xFFFF)] = True
            self.wanted[n] = values, likely
        self.partitions = [self._partition(2 << s, members) for s, members in sorted(classes.items())]

    def _partition(self, stride: int, members: list[int]) -> Partition:
        part = Partition(stride, [], [], [])
        owners = np.array(members)
        for c in range(self.search.coords):
            least = np.array([((self.sets[i] ^ self.b[c]) * self.a[c]).min() for i in members], U64)
            order = np.argsort(least)
            part.values.append(least[order])
            part.owners.append(owners[order])
            likely = np.zeros(1 << 16, bool)
            likely[least & U64(0xFFFF)] = True
            part.likely.append(likely)
        return part

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(position of the text, position of the item, shingles found) of the confirmed pairs."""
        words = [word_hashes(lower_ascii(t).split()) for t in texts]
        pairs: set[tuple[int, int]] = set()
        sets = [windows(w, self.search.shingle) for w in words]
        for n, (wanted, likely) in self.wanted.items():
            for d, w in enumerate(words):
                held = sets[d] if n == self.search.shingle else windows(w, n)
                for h in np.intersect1d(held[likely[held & U64(0xFFFF)]], wanted).tolist():
                    pairs.update((d, i) for i in self.short[n][h])
        some = [d for d, s in enumerate(sets) if len(s)]
        if some and self.partitions:
            pairs |= self._meet(np.array(some), [sets[d] for d in some])
        out, distinct = [], {}
        for d, i in sorted(pairs):
            n = self.width[i]
            if (d, n) not in distinct:
                distinct[d, n] = np.unique(sets[d] if n == self.search.shingle else windows(words[d], n))
            found = len(np.intersect1d(self.sets[i], distinct[d, n], assume_unique=True))
            if 100 * found >= self.search.percent * len(self.sets[i]):
                out.append((d, i, found))
        return out

    def _meet(self, docs: np.ndarray, sets: list[np.ndarray]) -> set[tuple[int, int]]:
        held = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        levels, blocks = [], sizes
        for j, part in enumerate(self.partitions):
            step = part.stride if j == 0 else part.stride // self.partitions[j - 1].stride
            before, blocks = blocks, -(-blocks // step)
            owner = np.repeat(np.arange(len(sets)), blocks)
            first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
            offset = np.concatenate([[0], np.cumsum(before)[:-1]])
            starts = offset[owner] + (np.arange(len(owner)) - first[owner]) * step
            levels.append((part, starts, owner))
        pairs: set[tuple[int, int]] = set()
        for c in range(self.search.coords):
            values = (held ^ self.b[c]) * self.a[c]
            for part, starts, owner in levels:
                values = np.minimum.reduceat(values, starts)
                together = values.copy()
                next_to = owner[1:] == owner[:-1]
                together[:-1][next_to] = np.minimum(values[:-1], values[1:])[next_to]
                at = np.flatnonzero(part.likely[c][together & U64(0xFFFF)])
                low = np.searchsorted(part.values[c], together[at], "left")
                high = np.searchsorted(part.values[c], together[at], "right")
                for k in np.flatnonzero(high > low):
                    d = int(docs[owner[at[k]]])
                    pairs.update((d, int(i)) for i in part.owners[c][low[k] : high[k]])
        return pairs


def slices(items: DataFrame, search: Search) -> Iterator[list[tuple[int, bytes]]]:
    """The items on the driver, one slice of bounded expected size after the other."""
    items = items.selectExpr("cast(item_id as long) item_id", "text").where("text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(count / search.slice_items), math.ceil(size / search.slice_bytes))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, r.text.encode()) for r in own.toLocalIterator()]


def contaminated(docs: DataFrame, items: DataFrame, search: Search | None = None) -> DataFrame:
    """One row per document and item of which the document holds enough (docs: doc_id, text; items: item_id, text)."""
    search = search or Search()
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def finder(held: list[tuple[int, bytes]]) -> DataFrame:
        made: list[ItemIndex] = []  # one for each task

        def work(group: list[tuple]) -> dict | None:
            if not made:
                made.append(ItemIndex(held, search))
            found = made[0].find([t or b"" for _, t in group])
            if not found:
                return None
            totals = [len(made[0].sets[i]) for _, i, _ in found]
            return {
                "doc_id": pa.array([group[d][0] for d, _, _ in found], pa.int64()),
                "item_id": pa.array([made[0].ids[i] for _, i, _ in found], pa.int64()),
                "n_item_shingles": pa.array(totals, pa.int64()),
                "n_found": pa.array([n for _, _, n in found], pa.int64()),
                "containment": pa.array([n / t for (_, _, n), t in zip(found, totals, strict=True)], pa.float64()),
            }

        return map_groups(docs, ["doc_id", "text"], work, SCHEMA)

    return reduce(DataFrame.union, [finder(held) for held in slices(items, search)])


def keep_clean(docs: DataFrame, items: DataFrame, search: Search | None = None) -> DataFrame:
    """The documents that hold no item, columns unchanged; each row is judged by its own text, without a shuffle."""
    search = search or Search()

    def without(docs: DataFrame, held: list[tuple[int, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held, search)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for group in groups((at, text) for at, (text,) in enumerate(rows(batch, "text"))):
                    keep[[group[d][0] for d, _, _ in index.find([t or b"" for _, t in group])]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, slices(items, search), docs)
