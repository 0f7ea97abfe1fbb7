"""Stage 1 within a group of records that a task holds: pairs are made, compared and linked there, none is stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.cluster import written
from kindred.operators import compare as C
from kindred.operators import lsh as L

if TYPE_CHECKING:
    from kindred.operators.stages import Search

c = F.col

#: Entries of a table over all pairs of a group's values, at most; more are kept sorted.
CELLS = 1 << 26
#: Pairs that are linked or counted at once, about.
LINKS = 1 << 21


def judged(n: np.ndarray, e: np.ndarray, o: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Whether the pairs match: the rule (its number in the order of ``verdicts``) of each by its codes."""
    found = np.zeros(len(n), bool)
    for k, test in enumerate(C.verdicts(n, e, o).values()):
        found |= (rule == k) & test
    return found


def rules(x: np.ndarray, y: np.ndarray, texts: dict[str, np.ndarray]) -> np.ndarray:
    """``compare.context`` of pairs within a state, as the rule's number in the order of ``verdicts``; an empty text is told by 0."""
    number = {k: i for i, k in enumerate(C.verdicts(np.zeros(0), np.zeros(0), np.zeros(0)))}

    def same(k: str) -> np.ndarray:
        own = texts[k][x]
        return (own == texts[k][y]) & (own != 0)

    zips, address = same("zip"), texts["address"]
    present = (address[x] != 0) & (address[y] != 0)
    out = np.where(present, np.where(same("address"), number["addressY"], np.where(zips, number["addressN_zipY"], number["addressN_zipN"])), np.where(zips, number["addressNA_zipY"], number["addressNA_zipN"]))
    return np.where(zips | same("CITY"), out, number["cityN"])


class Met:
    """Which pairs of values meet, each told once where a table of all pairs of a group's values is small, else once a packet."""

    def __init__(self, values: np.ndarray):
        self.values, self.own = np.unique(values, return_inverse=True)
        self.size = len(self.values)
        self.seen = np.zeros(self.size**2 if self.size**2 <= CELLS else 0, bool)

    def add(self, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        key = self.own[x] * self.size + self.own[y]
        if len(self.seen):
            self.seen[key] = True
        else:
            yield np.unique(key)

    def rest(self) -> Iterator[np.ndarray]:
        yield np.flatnonzero(self.seen)


class Codes:
    """Codes of pairs of values, 0 where none is given."""

    def __init__(self, values: np.ndarray, table: pa.Table, codes: list[str]):
        self.values, self.own = np.unique(values, return_inverse=True)
        self.size = len(self.values)
        one, two, *given = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(v.as_buffer(), np.int64) for v in table.column(k)]]) for k in ("one", "two", *codes))
        key = np.searchsorted(self.values, one) * self.size + np.searchsorted(self.values, two)
        self.key = None if self.size**2 <= CELLS else np.sort(key)
        self.given = []
        for v in given:
            if self.key is None:
                cells = np.zeros(self.size**2, np.int8)
                cells[key] = v
            else:
                cells = v[np.argsort(key)].astype(np.int8)
            self.given.append(cells)

    def of(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        key = self.own[x] * self.size + self.own[y]
        if self.key is None:
            return [cells[key] for cells in self.given]
        if not len(self.key):
            return [np.zeros(len(key), np.int8) for _ in self.given]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return [np.where(self.key[at] == key, cells[at], 0) for cells in self.given]


class Links:
    """The smallest of the places that are linked, for each; links are taken a packet at a time."""

    def __init__(self, size: int):
        self.label = np.arange(size, dtype=np.int32)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.label[x], self.label[y]
        self.held.append((a[a != b], b[a != b]))
        if sum(len(v) for v, _ in self.held) > LINKS:
            self.settle()

    def settle(self) -> np.ndarray:
        if not self.held:
            return self.label
        x, y = (np.concatenate(v) for v in zip(*self.held, strict=True))
        self.held.clear()
        while True:
            a, b = self.label[x], self.label[y]
            x, y = x[a != b], y[a != b]
            if not len(x):
                return self.label
            a, b = self.label[x], self.label[y]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further


class Votes:
    """How many matches a row without a middle initial has with rows of each initial."""

    def __init__(self, initial: np.ndarray):
        self.letters, self.own = np.unique(initial, return_inverse=True)
        self.open = initial == 0
        self.held: list[np.ndarray] = []
        self.length = 0
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for one, other in ((x, y), (y, x)):
            vote = self.open[one] & ~self.open[other]
            self.held.append(one[vote].astype(np.int64) * len(self.letters) + self.own[other[vote]])
            self.length += len(self.held[-1])
        if self.length > LINKS:
            self.settle()

    def settle(self) -> None:
        key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        self.held.clear()
        self.length = 0
        key, n = np.concatenate([self.key, key]), np.concatenate([self.n, n])
        self.key, place = np.unique(key, return_inverse=True)
        self.n = np.bincount(place, n, len(self.key)).astype(np.int64)

    def spawn(self, label: np.ndarray) -> np.ndarray:
        """The initial that ``identity.split_on_middle`` gives each row, by the rows' components; 0 for none."""
        self.settle()
        many = len(self.letters)
        decided = ~self.open
        part, size = np.unique(label[decided].astype(np.int64) * many + self.own[decided], return_counts=True)
        of, count = np.unique(part // many, return_counts=True)
        several = np.zeros(len(label), bool)
        several[of[count > 1]] = True
        parted = several[label]
        out = np.where(parted, self.letters[self.own], 0)
        rows = np.flatnonzero(parted & self.open)
        begin, end = (np.searchsorted(part, label[rows].astype(np.int64) * many + k) for k in (0, many))
        best = np.full(len(rows), -1.0)
        chosen = np.zeros(len(rows), np.int64)
        for k in range(int((end - begin).max(initial=0))):  # the k-th initial of each row's component, from the smallest on
            some = np.flatnonzero(begin + k < end)
            at = part[begin[some] + k]
            key = rows[some].astype(np.int64) * many + at % many
            found = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            total = np.where(self.key[found] == key, self.n[found], 0) if len(self.key) else np.zeros(len(key), np.int64)
            mean = total / size[begin[some] + k]
            better = mean > best[some]
            best[some[better]] = mean[better]
            chosen[some[better]] = self.letters[at[better] % many]
        out[rows] = chosen
        return out


def _turned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(x, y), np.maximum(x, y)


def parted(records: DataFrame, hashes: DataFrame, search: Search, coded: Callable[[str, DataFrame], DataFrame]) -> DataFrame | None:
    """(id, STATE, component, spawn) of all records, or None where a state is too large for a task or ids are repeated.

    ``records``: id, STATE, NAME, names and work (numbers that tell the names and the employers with occupations),
    initial (the middle initial's number, 0 for none), address, zip and CITY, null where they are empty. ``coded``:
    adds the codes to pairs (one, two) of numbers of a kind, "names" (n) or "work" (e, o), and leaves out those that
    never match. Pairs are made twice: first to see which values meet, then to judge them.
    """
    by, numbers, texts = ["STATE"], ["id", "names", "work", "initial"], ["address", "zip", "CITY"]
    size = search.bits, search.rounds, search.near, search.near_names
    held, most = L.grouped(hashes, records, by, numbers, texts)
    if most > L.GROUP:
        return None
    state = T.StructType([records.schema["STATE"]])
    tasks = L.in_parts(held, by, 1)

    def values(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = L.as_group(pa.Table.from_batches(list(batches)), numbers, [], *size)
        met = {k: Met(group.numbers[k]) for k in ("names", "work")}

        def told(kind: str, keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for found in keys:
                for i in range(0, len(found), L.BLOCK):
                    one, two = np.divmod(found[i : i + L.BLOCK], met[kind].size)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(one)), pa.repeat(kind, len(one)), *[pa.array(met[kind].values[v]) for v in (one, two)]], ["STATE", "kind", "one", "two"])

        if group.repeated:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], key[0].type), pa.array(["repeated"]), *[pa.array([0], pa.int64())] * 2], ["STATE", "kind", "one", "two"])
            return
        for pair in group.pairs():
            x, y = _turned(*pair)
            for kind, seen in met.items():
                yield from told(kind, seen.add(x, y))
        for kind, seen in met.items():
            yield from told(kind, seen.rest())

    pairs = written(tasks.groupBy(*by, "_part").applyInArrow(values, T.StructType([*state, *T._parse_datatype_string("kind string, one long, two long")])), "values-met")
    if not pairs.where("kind = 'repeated'").isEmpty():
        return None
    sent = held
    for kind, codes in (("names", ["n"]), ("work", ["e", "o"])):
        own = pairs.where(c("kind") == kind).drop("kind")
        good = written(coded(kind, own.select("one", "two").distinct()), "codes")
        rows = own.join(good, ["one", "two"])
        packed = L.packed_groups(rows, by, ["one", "two", *codes], []).withColumn("_kind", F.lit(kind))
        sent = sent.unionByName(packed, allowMissingColumns=True)

    def people(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group = L.as_group(table, numbers, texts, *size)
        names, work = (Codes(group.numbers[k], table.filter(pc.equal(table.column("_kind"), k)), codes) for k, codes in (("names", ["n"]), ("work", ["e", "o"])))
        links, votes = Links(len(group.ids)), Votes(group.numbers["initial"])
        for pair in group.pairs():
            x, y = _turned(*pair)
            (n,) = names.of(x, y)
            near = n >= 2
            x, y, n = x[near], y[near], n[near]
            match = judged(n, *work.of(x, y), rules(x, y, group.texts))
            links.add(x[match], y[match])
            votes.add(x[match], y[match])
        label = links.settle()
        spawn = votes.spawn(label)
        for i in range(0, len(label), L.BLOCK):
            own = slice(i, i + L.BLOCK)
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(label[own])), *[pa.array(v.astype(np.int64)) for v in (group.ids[own], group.ids[label[own]], spawn[own])]], ["STATE", "id", "component", "spawn"])

    return L.in_parts(sent, by, 1).groupBy(*by, "_part").applyInArrow(people, T.StructType([*state, *T._parse_datatype_string("id long, component long, spawn long")]))
