"""Language ID by interpolated Kneser-Ney character models.

Every language has a model of ``order`` characters in sorted arrays: the n-grams of each order, as integers, with
their discounted probability, and the contexts with the weight of the next lower order. Orders below the highest
are estimated from continuation counts, the lowest is interpolated with a uniform distribution. A text's language is
the one with the lowest cross-entropy per character over the whole text.

Models are fitted on a bounded sample of labelled rows: about ``train_docs``, by a hash of doc_id, four in five of
them for the counts and the rest to calibrate. The margin to the second language becomes a score, and a text whose
cross-entropy is above what ``reject`` of the calibration texts of its language reach is marked as rejected.

Rows: texts that are null or have no letter are ``und`` with score 0; without labelled rows all are. Rows with the
same doc_id are judged one by one; a row without doc_id is neither learned from nor held out. Extra columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.tables import Remembered
from kindred.llm.text import U64, map_groups, rows

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


@dataclass(frozen=True)
class Training:
    order: int = 4
    train_docs: int = 4000
    #: The rows whose crc32(doc_id) mod ``folds`` is ``held_out`` are not learned from.
    folds: int = 3
    held_out: int = 1
    #: Share of the calibration texts that are not rejected.
    reject: float = 0.995
    #: Rows of scores that a Python worker keeps are 2 ** this for one language, and fewer for more.
    table_bits: int = 23


def symbols(text: str) -> np.ndarray:
    """16-bit symbols of a lower-cased text between blanks: digits are one symbol, so are white space and rare planes."""
    codes = np.frombuffer(f"   {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    out = np.where(codes > 0xFFFF, 0xE000 | codes & 0xFFF, codes).astype(np.uint64)
    out[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    out[(codes >= 0x09) & (codes <= 0x0D)] = 0x20
    return out


def grams(text: str, order: int) -> np.ndarray:
    """The text's n-grams as integers, the last character lowest; one for each character and the end."""
    s = symbols(text)[3 - (order - 1) :]
    n = len(s) - order + 1
    out = np.zeros(n, U64)
    for j in range(order):
        out = (out << U64(16)) | s[j : j + n]
    return out


class KneserNey:
    """One language's model from its highest-order n-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int) -> None:
        self.order, self.grams, self.probs, self.contexts, self.weights = order, [], [], [], []
        self.symbols = max(1, len(np.unique(keys & U64(0xFFFF)))) + 1
        for n in range(order, 0, -1):
            many = np.bincount(np.minimum(counts, 3), minlength=4)
            discount = many[1] / (many[1] + 2 * many[2]) if many[1] and many[2] else 0.5
            context, at = np.unique(keys >> U64(16), return_inverse=True)
            total = np.bincount(at, weights=counts)
            self.grams.append(keys)
            self.probs.append(np.maximum(counts - discount, 0) / total[at])
            self.contexts.append(context)
            self.weights.append(discount * np.bincount(at) / total)
            if n > 1:
                keys, counts = np.unique(keys & U64((1 << 16 * (n - 1)) - 1), return_counts=True)

    @staticmethod
    def _at(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return at, held[at] == keys

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last character after the others."""
        p = np.full(len(keys), 1 / self.symbols)
        for n in range(1, self.order + 1):
            k = self.order - n
            own = keys & U64((1 << 16 * n) - 1)
            c, known = self._at(self.contexts[k], own >> U64(16))
            g, seen = self._at(self.grams[k], own)
            p = np.where(known, np.where(seen, self.probs[k][g], 0) + self.weights[k][c] * p, p)
        return np.log2(p)


@dataclass
class Models:
    langs: list[str]
    models: list[KneserNey]
    training: Training
    #: Per language: highest accepted cross-entropy and its spread. Slope of the score over the margin.
    highest: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    ident: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self) -> Remembered:
        bits = max(12, self.training.table_bits - max(0, len(self.langs) - 1).bit_length())
        return Remembered(lambda keys: np.stack([m.log2(keys) for m in self.models], 1), len(self.langs), bits)

    def entropies(self, texts: list[str], table: Remembered) -> np.ndarray:
        """Bits per character of each text under each language."""
        parts = [grams(t, self.training.order) for t in texts]
        sizes = np.array([len(p) for p in parts])
        found = table.get(np.concatenate(parts))
        starts = np.cumsum(sizes) - sizes
        return -np.add.reduceat(found, starts, axis=0, dtype=np.float64) / sizes[:, None]

    def scores(self, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score between 0 and 1, and whether the text is like none."""
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        share = 1 / np.exp2(-np.minimum((entropy - least[:, None]) * self.slope, 1000)).sum(1)
        above = np.maximum(0, least - self.highest[best]) / self.spread[best]
        return best, share * np.exp(-above), above > 0


def fit(docs: DataFrame, training: Training) -> Models | None:
    """Models from labelled rows (doc_id, text, lang); None if there are none."""
    known = docs.where("text is not null and lang is not null and doc_id is not null")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(training.folds))
    known = known.where(fold != training.held_out).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    total = known.count()
    if not total:
        return None
    known = known.where(F.col("h") < int(min(1.0, training.train_docs / total) * (1 << 30)))
    known = known.select("text", "lang", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0, 1).otherwise(0).alias("calibrates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[np.ndarray]] = {}
            for text, lang in rows(batch, "text", "lang"):
                held.setdefault(lang, []).append(grams(text.decode(), training.order))
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang.decode()] * len(keys), "gram": keys.view(np.int64), "n": n})

    counts = known.where("calibrates = 0").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if not len(counts):
        return None
    langs = sorted(counts.lang.unique())
    models = []
    for lang in langs:
        own = counts[counts.lang == lang]
        keys = own.gram.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        models.append(KneserNey(keys[order], own.n.to_numpy(np.int64)[order], training.order))
    found = Models(langs, models, training, np.full(len(langs), np.inf), np.ones(len(langs)))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        table = models.table()
        for batch in batches:
            part = [(t.decode(), lang.decode()) for t, lang in rows(batch, "text", "lang")]
            part = [(t, models.langs.index(lang)) for t, lang in part if lang in models.langs and any(map(str.isalpha, t))]
            if part:
                e = models.entropies([t for t, _ in part], table)
                own = np.array([k for _, k in part])
                mine = e[np.arange(len(own)), own]
                e[np.arange(len(own)), own] = np.inf
                yield pa.RecordBatch.from_pydict({"lang": own, "own": mine, "margin": np.minimum(e.min(1) - mine, 1e3)})

    rest = known.where("calibrates = 1").select("text", "lang").mapInArrow(calibrate, "lang long, own double, margin double").toArrow().to_pandas()
    for k in range(len(langs)):
        own = rest.own[rest.lang == k].to_numpy()
        if len(own) >= 20:
            found.highest[k] = np.quantile(own, training.reject)
            found.spread[k] = max(own.std(), 1e-3)
    right = rest.margin[rest.margin > 0]
    if len(right):
        found.slope = float(np.log2(99) / max(np.quantile(right, 0.05), 1e-3))
    shared.unpersist()
    return found


_tables: dict[str, Remembered] = {}


def identified(docs: DataFrame, training: Training | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row (doc_id long, text string, lang string)."""
    training = training or Training()
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(lang as string) lang")
    models = fit(docs, training)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(training.folds)) == training.held_out

    def work(group: list[tuple]) -> dict:
        models = shared.value
        pred, score, entropy, rejected = ["und"] * len(group), [0.0] * len(group), [None] * len(group), [True] * len(group)
        texts = [(at, t.decode()) for at, (_, t, _) in enumerate(group) if t]
        texts = [(at, t) for at, t in texts if any(map(str.isalpha, t))]
        if models is not None and texts:
            if models.ident not in _tables:
                _tables.clear()
                _tables[models.ident] = models.table()
            e = models.entropies([t for _, t in texts], _tables[models.ident])
            best, share, odd = models.scores(e)
            for (at, _), k, s, bits, o in zip(texts, best, share, e.min(1), odd, strict=True):
                pred[at], score[at], entropy[at], rejected[at] = models.langs[k], float(s), float(bits), bool(o)
        return {
            "doc_id": pa.array([i for i, _, _ in group], pa.int64()),
            "held_out": pa.array([h for _, _, h in group], pa.bool_()),
            "lang_pred": pa.array(pred, pa.string()),
            "score": pa.array(score, pa.float64()),
            "entropy": pa.array(entropy, pa.float64()),
            "rejected": pa.array(rejected, pa.bool_()),
        }

    docs = docs.select("doc_id", "text", F.coalesce(fold, F.lit(False)).alias("held_out"))
    return map_groups(docs, ["doc_id", "text", "held_out"], work, SCHEMA)
