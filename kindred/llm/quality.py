"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard's ratio of compressed to raw bytes falls for repetitive text and rises for text without
structure. The ratio that ordinary prose reaches depends on the length, so each length class has its own
band. Fixed chunks see what the whole text hides: a long document whose parts are each out of their band.

Rows: a null text counts as empty. A text without words fails the base rule (fewer than 50 words). Rows
with the same doc_id are judged one by one. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kindred.llm.text import GROUP_BYTES, U64, groups, mix, rows, windows, word_hashes

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, zstd_ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Accepted ratios. ``whole``: (bytes from, lowest, highest), ascending; below the first no band holds."""

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.20),
        (256, 0.48, 0.85),
        (512, 0.45, 0.78),
        (1024, 0.42, 0.70),
        (2048, 0.41, 0.65),
        (4096, 0.39, 0.62),
        (8192, 0.37, 0.62),
        (16384, 0.33, 0.62),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.45, 0.65)
    #: A text fails if more than this share of its full chunks is out of the band.
    bad_share: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50
    starts: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "starts", np.array([b[0] for b in self.whole]))

    def band(self, n_bytes: int) -> tuple[float, float]:
        at = int(np.searchsorted(self.starts, n_bytes, side="right")) - 1
        return self.whole[at][1:] if at >= 0 else (0.0, float("inf"))


def repeated(word_counts: np.ndarray, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """Of each document: its words in n-word windows that the document has twice or more."""
    total = len(hashes)
    docs = np.repeat(np.arange(len(word_counts)), word_counts)
    out = np.zeros(len(word_counts), np.int64)
    if total < n:
        return out
    key = windows(hashes, n)
    whole = docs[: len(key)] == docs[n - 1 :]
    key = key[whole] ^ mix(docs[: len(whole)][whole].astype(U64))
    at = np.flatnonzero(whole)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(total + 1, np.int64)
    hit = at[twice]
    covered[hit] += 1
    np.subtract.at(covered, hit + n, 1)
    return np.bincount(docs, weights=np.cumsum(covered[:-1]) > 0, minlength=len(word_counts)).astype(np.int64)


def judge(texts: list[bytes], bands: Bands, packer: zstandard.ZstdCompressor) -> dict[str, list]:
    """The figures and verdicts of some texts."""
    size = lambda part: len(packer.compress(part))
    found: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "zstd_ratio", "n_chunks", "n_bad_chunks")}
    words: list[bytes] = []
    for text in texts:
        own = text.split()
        words += own
        found["n_words"].append(len(own))
        found["word_chars"].append(len(text.translate(None, SPACES).decode("utf-8", "replace")))
        found["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        found["n_dup_lines"].append(len(lines) - len(set(lines)))
        found["zstd_ratio"].append(size(text) / len(text) if text else 0.0)
        step = bands.chunk_bytes
        ratios = [size(text[i : i + step]) / step for i in range(0, len(text) - step + 1, step)]
        found["n_chunks"].append(len(ratios))
        found["n_bad_chunks"].append(sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in ratios))
    counts = np.array(found["n_words"], np.int64)
    found["n_repeat_words"] = repeated(counts, word_hashes(words)).tolist()
    found["base_failed"] = [n < bands.min_words or 100 * r > bands.repeat_percent * n for n, r in zip(found["n_words"], found["n_repeat_words"], strict=True)]
    found["kept"] = []
    for i, text in enumerate(texts):
        low, high = bands.band(len(text))
        good = low <= found["zstd_ratio"][i] <= high and found["n_bad_chunks"][i] <= bands.bad_share * found["n_chunks"][i]
        found["kept"].append(good and not found["base_failed"][i])
    return found


def compression_quality(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the base figures, the ratios and the verdict; no shuffle."""
    bands = bands or Bands()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for group in groups(rows(batch, "doc_id", "text"), GROUP_BYTES):
                found = judge([t or b"" for _, t in group], bands, packer) | {"doc_id": [i for i, _ in group]}
                yield pa.RecordBatch.from_pydict({k: found[k] for k in names})

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The documents that pass, with their columns unchanged and no shuffle.

    The verdict is made beside the row, so rows that share a doc_id, or have none, keep their own.
    """
    bands = bands or Bands()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            kept: list[bool] = []
            for group in groups(((None, t) for (t,) in rows(batch, "text")), GROUP_BYTES):
                kept += judge([t or b"" for _, t in group], bands, packer)["kept"]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
