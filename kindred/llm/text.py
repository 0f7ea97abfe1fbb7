"""Words, hashes and batches shared by the text operators.

A word is a run of bytes other than space and 0x09-0x0D, which is what ``bytes.split()`` yields,
so UTF-8 text is split without being decoded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from kindred.cluster import shared_dir, written

__all__ = ["shared_dir", "written"]

U64 = np.uint64
#: Odd multiplier of the rolling window hash.
STEP = U64(0x9E3779B97F4A7C15)
#: Documents are worked on in groups of about so many bytes, which bounds a Python worker's memory.
GROUP_BYTES = 2 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z, everything else unchanged."""
    return text.translate(_LOWER)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _edges(text: bytes, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where words begin and where they end, a stretch of the text at a time."""
    before = True
    for at in range(0, len(text), step):
        white = _WHITE[np.frombuffer(text, np.uint8, min(step, len(text) - at), at)]
        change = np.flatnonzero(np.diff(white, prepend=before))
        begins = white[change] == 0
        before = white[-1]
        yield at + change[begins], at + change[~begins]
    if not before:
        yield np.empty(0, np.int64), np.array([len(text)])


def word_count(text: bytes) -> int:
    """Words of a text, without a list of them."""
    return sum(len(begins) for begins, _ in _edges(text))


def word_spans(text: bytes, firsts: list[int], lasts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words numbered ``firsts`` begin and those numbered ``lasts`` end."""
    out = []
    for side, wanted in enumerate((firsts, lasts)):
        numbers, back = np.unique(np.array(wanted, np.int64), return_inverse=True)
        found, seen = np.zeros(len(numbers), np.int64), 0
        for edges in _edges(text):
            a, b = np.searchsorted(numbers, [seen, seen + len(edges[side])])
            found[a:b] = edges[side][numbers[a:b] - seen]
            seen += len(edges[side])
        out.append(found[back])
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` word hashes; entry i covers i to i + n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= STEP
        out += hashes[j : j + m]
    return mix(out + U64(n))


def segment_min(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum of each run that begins at ``starts`` (none empty)."""
    return np.minimum.reduceat(values, starts)


def groups(docs: Iterable[tuple], size: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """Cut (key, bytes, ...) tuples into lists of about ``size`` bytes; a longer text stands alone."""
    held: list[tuple] = []
    total = 0
    for doc in docs:
        n = len(doc[1]) if doc[1] is not None else 0
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(doc)
        total += n
    if held:
        yield held


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Tuples of the named columns; strings as UTF-8 bytes."""
    columns = []
    for name in names:
        c = batch.column(batch.schema.names.index(name))
        if pa.types.is_string(c.type):
            c = c.cast(pa.binary())
        elif pa.types.is_large_string(c.type):
            c = c.cast(pa.large_binary())
        columns.append(c)
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True)


def map_groups(df: DataFrame, names: list[str], work: Callable[[list[tuple]], dict | None], schema: str, size: int = GROUP_BYTES) -> DataFrame:
    """Apply ``work`` to groups of rows of the named columns; it returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def docs() -> Iterator[tuple]:
            for b in batches:
                yield from rows(b, *names)

        for group in groups(docs(), size):
            if out := work(group):
                yield pa.RecordBatch.from_pydict(out)

    return df.select(*names).mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, however it writes its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def removed(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned, once what was made of it is written as well."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def binomial_tail(n: int, p: float, below: int) -> float:
    """P[X < below] for X ~ Bin(n, p)."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(below))
