"""LM scoring by context-tree weighting over bytes.

Every byte is eight binary choices, a path in the tree of byte prefixes; every node of that tree has its own tree of
contexts, the bytes before, up to ``depth`` of them. At each context the zeros and ones that followed it in training
give a Krichevsky-Trofimov estimate, and contexts are weighted from the longest up: half a context's weight is its own
estimate of all it saw, half is the product of its extensions. What training saw fixes the weights; the probability of
a byte is then, choice by choice, the mix along its context path. A context that training never saw adds nothing: the
mix ends at its parent. A text is its words, A-Z lowered, between single spaces, with ``depth`` zero bytes before and
one after.

1. Documents are bundled in packets of a bounded number of distinct runs of depth + 1 bytes. A packet sends its runs,
   with their counts in the texts to learn from, to buckets by their last two context bytes, and by the third as well
   where the data make more buckets than that. All texts count, so every run that is to be scored is there.
2. Buckets sum, in two steps where many packets meet, and weight all contexts of three bytes or more; contexts of two
   bytes are put together by their bytes, and those of one byte, 256 * 255 nodes at most, on the driver.
3. Buckets send the log probability of each of its runs back to every packet, and packets are scored by what they got.
   Words are counted and sent back likewise. Nothing is broadcast, and the texts are passed over once.

The base score is a word model: log10((c + 1) / (N + V + 1)) over the words, A-Z lowered, and an end.

Rows: null and empty texts are the end alone. A row without doc_id is learned from. Rows with the same doc_id are
scored one by one. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.tables import HashTable
from kindred.llm.text import U64, groups, lower_ascii, mix, removed, rows, word_hashes, written


@dataclass(frozen=True)
class Tree:
    depth: int = 5
    #: Rows whose crc32(doc_id) mod ``folds`` is ``held_out`` are not learned from.
    folds: int = 7
    held_out: int = 2
    #: Groups of contexts of two bytes.
    buckets: int = 256
    #: Runs of a bucket, or of packets that meet in one, about.
    bucket_rows: int = 3_000_000
    #: A packet is closed with so many distinct runs, or bytes of text.
    gather: int = 1_000_000
    packet_bytes: int = 24 << 20


#: Stands for the end of a text among the words; no hash of a word is likely to be it.
END = U64(0x5D8A2E91C3F0467B)


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of depth + 1 bytes as integers, the last byte lowest, and each text's number of them."""
    pad = b"\0" * depth
    raw = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(U64)
    sizes = np.array([len(t) + 1 for t in texts])
    n = len(raw) - depth
    out = np.zeros(n, U64)
    for j in range(depth + 1):
        out = (out << U64(8)) | raw[j : j + n]
    ends = np.cumsum(sizes + depth)
    keep = np.ones(n, bool)
    spot = ends[:-1, None] - depth + np.arange(depth)
    keep[spot.reshape(-1)] = False
    return out[keep], sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class Gathered:
    """Counts of keys of a packet."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.tidy = 0

    def add(self, keys: np.ndarray, learn: bool) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * learn))
        self.held += len(keys)
        if self.held - self.tidy > self.limit // 2:
            self.pack()

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.empty(0, U64), np.empty(0, np.int64))
        self.parts, self.held, self.tidy = [(keys, counts)], len(keys), len(keys)
        return keys, counts


def planes(keys: np.ndarray) -> bytes:
    """Keys byte by byte, all first bytes first: sorted keys are then long runs, which compress well."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def unfolded(held: list[bytes]) -> np.ndarray:
    """The keys of several ``planes``, one after the other."""
    return np.concatenate([np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(8, -1).T).view(U64).ravel() for k in held]) if held else np.empty(0, U64)


def packed(place: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """For each place: place, the planes of its keys, and bytes of each of the values."""
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]])) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some = order[a:b]
        yield int(place[some[0]]), planes(keys[some]), *(v[some].tobytes() for v in values)


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def unpacked(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their counts, which are as wide as their bytes tell."""
    parts = [(unfolded([k]), np.frombuffer(c, np.uint32 if 2 * len(c) == len(k) else np.uint64).astype(np.int64)) for k, c in zip(keys, counts, strict=True)]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def split_rows(docs: DataFrame, tree: Tree) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(tree.folds)) == tree.held_out
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.withColumn("held_out", F.coalesce(fold, F.lit(False)))


def canonical(text: bytes | None) -> bytes:
    """What is modelled: the words, A-Z lowered, between single spaces."""
    return b" ".join(lower_ascii(text or b"").split())


def words_of(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text.split()), END)


RUN, WORD, DOC = 0, 1, 2
SENT = "kind int, packet long, place long, keys binary, counts binary, doc_id long, held_out boolean, text binary"


def run_place(keys: np.ndarray, tree: Tree, thirds: int) -> np.ndarray:
    """A run's bucket: the group of its last two context bytes, and a part of it by the third."""
    return (mix((keys >> U64(8)) & U64(0xFFFF)) % U64(tree.buckets) * U64(thirds) + mix((keys >> U64(8)) & U64(0xFFFFFF)) % U64(thirds)).astype(np.int64)


def gathered(docs: DataFrame, tree: Tree, thirds: int) -> DataFrame:
    """Packets: their runs and words by bucket, and their documents, as modelled."""
    fields = [(f.strip().split(" ")[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.strip().split(" ")[1]]) for f in SENT.split(",")]

    def table(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in held], kind) for name, kind in fields], names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, packet = 0, TaskContext.get().partitionId() << 32
        kept, size = (Gathered(tree.gather), Gathered(tree.gather)), 0

        def send() -> Iterator[pa.RecordBatch]:
            for kind, held in enumerate(kept):
                keys, counts = held.pack()
                place = run_place(keys, tree, thirds) if kind == RUN else (mix(keys) % U64(tree.buckets * thirds)).astype(np.int64)
                for where, k, c in packed(place, keys, narrow(counts)):
                    yield table([{"kind": kind, "packet": packet + number, "place": where, "keys": k, "counts": c}])

        for batch in batches:
            for group in groups(rows(batch, "doc_id", "text", "held_out")):
                texts = [canonical(t) for _, t, _ in group]
                for learn in (True, False):
                    some = [t for t, (_, _, h) in zip(texts, group, strict=True) if h != learn]
                    if some:
                        kept[RUN].add(runs(some, tree.depth)[0], learn)
                        kept[WORD].add(np.concatenate([words_of(t) for t in some]), learn)
                size += sum(map(len, texts))
                yield table([{"kind": DOC, "packet": packet + number, "doc_id": i, "held_out": h, "text": t} for t, (i, _, h) in zip(texts, group, strict=True)])
                if kept[RUN].held > tree.gather or size > tree.packet_bytes:
                    yield from send()
                    number, size, kept = number + 1, 0, (Gathered(tree.gather), Gathered(tree.gather))
        yield from send()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, SENT)


def counted(sent: DataFrame, kind: int, salts: int) -> DataFrame:
    """place, keys, counts: what packets sent to each place, summed in two steps where many meet."""

    def work(table: pa.Table) -> pa.Table:
        keys, counts = unpacked(table["keys"].to_pylist(), table["counts"].to_pylist())
        return pa.table({"place": table["place"][:1], "keys": pa.array([planes(keys)], pa.binary()), "counts": pa.array([narrow(counts).tobytes()], pa.binary())})

    held = sent.where(F.col("kind") == kind).select("place", "keys", "counts", F.pmod("packet", F.lit(salts)).alias("salt"))
    schema = "place long, keys binary, counts binary"
    if salts > 1:
        held = held.groupBy("place", "salt").applyInArrow(work, schema)
    return held.groupBy("place").applyInArrow(work, schema)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov estimate of zeros and ones seen in some order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * math.lgamma(0.5) - log_gamma(n0 + n1 + 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after eight steps up."""
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - low


@dataclass
class Level:
    """Nodes of one context length, sorted by key: the context's bytes, the oldest highest, then 1 and the bits so far."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # log of the weighted probability of what the node saw
    alone: np.ndarray  # weight of the node's own estimate in a prediction

    @classmethod
    def of(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray | None) -> Level:
        """``deeper``: log of the product of the weighted probabilities of a node's extensions, if it can have any."""
        own = kt(zeros.astype(float), ones.astype(float))
        if deeper is None:
            return cls(keys, zeros, ones, own, np.ones(len(keys)))
        weighted = np.logaddexp(own, deeper) - math.log(2)
        return cls(keys, zeros, ones, weighted, np.exp(own - math.log(2) - weighted))

    def above(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the contexts of ``size`` bytes, one less than here, have of these: keys, zeros, ones, log product."""
        key = self.keys & U64((1 << 8 * (size + 1)) - 1)
        return collected(key, self.zeros, self.ones, self.weighted)

    def predict(self, nodes: np.ndarray, bits: np.ndarray, p: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mix the estimates here into ``p``, what longer contexts give where they ``have`` any."""
        if not len(self.keys):
            return p, have
        at = np.minimum(np.searchsorted(self.keys, nodes), len(self.keys) - 1)
        known = self.keys[at] == nodes
        own = (np.where(bits, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        alone = np.where(have, self.alone[at], 1.0)
        return np.where(known, alone * own + (1 - alone) * p, p), have | known


def collected(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of each of the values, in order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def choices(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The eight choices of runs under their contexts of ``size`` bytes: node keys (n, 8) and bits (n, 8)."""
    byte = (keys & U64(0xFF)).astype(np.int64)
    step = np.arange(8)
    prefix = ((1 << step) | (byte[:, None] >> (8 - step))).astype(U64)
    context = keys & U64((1 << 8 * (size + 1)) - 1) & ~U64(0xFF)
    return context[:, None] | prefix, (byte[:, None] >> (7 - step)) & 1


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """Contexts of ``depth`` down to ``least`` bytes of runs (distinct) and their counts."""
    node, bit = choices(keys, depth)
    each = np.repeat(counts, 8)
    bit = bit.reshape(-1)
    out = [Level.of(*collected(node.reshape(-1), np.where(bit, 0, each), np.where(bit, each, 0)), None)]
    for size in range(depth - 1, least - 1, -1):
        out.append(Level.of(*out[-1].above(size)))
    return out


def mixed(keys: np.ndarray, found: list[Level], depth: int, p: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the eight choices of runs, by levels from ``depth`` bytes down."""
    for size, one in zip(range(depth, -1, -1), found, strict=False):
        p, have = one.predict(*choices(keys, size), p, have)
    return p, have


def weighed(counts: DataFrame, tree: Tree, thirds: int) -> DataFrame:
    """Per bucket: runs with the mix of their contexts of three bytes or more (kind 0), contexts of two bytes (kind 1)."""
    least = min(3, tree.depth)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for place, keys, counts_ in rows(batch, "place", "keys", "counts"):
                keys, counts_ = unpacked([keys], [counts_])
                seen = counts_ > 0
                found = levels(keys[seen], counts_[seen], tree.depth, least)
                out = []
                for at in range(0, len(keys), 1 << 16):
                    some = keys[at : at + (1 << 16)]
                    p, have = mixed(some, found, tree.depth, np.full((len(some), 8), 0.5), np.zeros((len(some), 8), bool))
                    out.append((0, place, place // thirds, planes(some), p.astype(np.float32).tobytes(), np.packbits(have).tobytes()))
                key, zeros, ones, deeper = found[-1].above(2) if tree.depth > 2 else (found[-1].keys, found[-1].zeros, found[-1].ones, found[-1].weighted)
                out.append((1, place, place // thirds, key.tobytes(), np.stack([zeros, ones]).tobytes(), deeper.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "place", "pair", "keys", "counts", "more"])

    return counts.mapInArrow(work, "kind int, place long, pair long, keys binary, counts binary, more binary")


def parts_of(keys: list[bytes], counts: list[bytes], more: list[bytes]) -> tuple[np.ndarray, ...]:
    """Nodes that buckets sent, those of a key together: keys, zeros, ones, sums of log products."""
    n = [np.frombuffer(c, np.int64).reshape(2, -1) for c in counts] or [np.empty((2, 0), np.int64)]
    n = np.concatenate(n, 1)
    return collected(np.frombuffer(b"".join(keys), U64), n[0], n[1], np.frombuffer(b"".join(more), np.float64))


def pairs(weighed_: DataFrame, tree: Tree) -> DataFrame:
    """Per group of contexts of two bytes: their nodes (kind 0), and contexts of one byte (kind 1)."""

    def work(table: pa.Table) -> pa.Table:
        parts = parts_of(*(table[c].to_pylist() for c in ("keys", "counts", "more")))
        two = Level.of(*parts) if tree.depth > 2 else Level(*parts[:3], parts[3], np.ones(len(parts[0])))
        key, zeros, ones, deeper = two.above(1)
        out = [(0, two.keys.tobytes(), np.stack([two.zeros, two.ones]).tobytes(), two.alone.tobytes()), (1, key.tobytes(), np.stack([zeros, ones]).tobytes(), deeper.tobytes())]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        found = pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "keys", "counts", "more"])
        return found.append_column("pair", pa.array([table["pair"][0].as_py()] * 2, pa.int64()))

    return weighed_.where("kind = 1").select("pair", "keys", "counts", "more").groupBy("pair").applyInArrow(work, "kind int, keys binary, counts binary, more binary, pair long")


def root(pairs_: DataFrame) -> list[Level]:
    """Contexts of one byte and of none, from all groups; 256 * 255 nodes and 255 at most."""
    parts = sorted((r.keys, r.counts, r.more) for r in pairs_.where("kind = 1").select("keys", "counts", "more").collect())
    one = Level.of(*parts_of(*map(list, zip(*parts, strict=True)))) if parts else Level.of(*parts_of([], [], []))
    return [one, Level.of(*one.above(0))]


def run_table(weighed_: DataFrame, pairs_: DataFrame, tree: Tree) -> DataFrame:
    """place, keys, value: log10 of the probability of every run."""
    top = root(pairs_)
    nodes = pairs_.where("kind = 0").select("pair", F.col("keys").alias("nodes"), F.col("counts").alias("seen"), F.col("more").alias("alone"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, keys, p, have, node, seen, alone in rows(batch, "place", "keys", "counts", "more", "nodes", "seen", "alone"):
                keys = unfolded([keys])
                p = np.frombuffer(p, np.float32).reshape(-1, 8).astype(float)
                have = np.unpackbits(np.frombuffer(have, np.uint8), count=8 * len(keys)).reshape(-1, 8).astype(bool)
                if tree.depth > 2:
                    seen = np.frombuffer(seen, np.int64).reshape(2, -1)
                    two = Level(np.frombuffer(node, U64), seen[0], seen[1], seen[0], np.frombuffer(alone, np.float64))
                    p, have = two.predict(*choices(keys, 2), p, have)
                p, _ = mixed(keys, top, 1, p, have)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([planes(keys)], pa.binary()), pa.array([np.log10(p).sum(1).astype(np.float32).tobytes()], pa.binary())], names=["place", "keys", "value"])

    return weighed_.where("kind = 0").join(nodes.hint("merge"), "pair").select("place", "keys", "counts", "more", "nodes", "seen", "alone").mapInArrow(work, "place long, keys binary, value binary")


def replies(sent: DataFrame, table: DataFrame, kind: int, value: str, salts: int) -> DataFrame:
    """kind, packet, keys, value: what each packet asked for, from a table of (place, keys, value)."""

    def work(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"kind": pa.array([], pa.int32()), "packet": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "value": pa.array([], pa.binary())})
        keys = unfolded(told["keys"].to_pylist())
        values = np.frombuffer(b"".join(told["value"].to_pylist()), value)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [values[np.searchsorted(keys, unfolded([k]))].tobytes() for k in asked["keys"].to_pylist()]
        return pa.table({"kind": pa.array([kind] * len(found), pa.int32()), "packet": asked["packet"], "keys": asked["keys"], "value": pa.array(found, pa.binary())})

    asked = sent.where(F.col("kind") == kind).select("packet", "place", "keys", F.pmod("packet", F.lit(salts)).alias("salt"))
    told = table.select("place", "keys", "value", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    return asked.groupBy("place", "salt").cogroup(told.groupBy("place", "salt")).applyInArrow(work, "kind int, packet long, keys binary, value binary")


def scored(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row (doc_id, text).

    ``score`` is of the text as modelled: its words, A-Z lowered, between single spaces.
    """
    tree = tree or Tree()
    docs = split_rows(docs, tree)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # a packet's runs are about a tenth of its bytes; contexts of one pair of bytes come in at most 256 parts
    thirds = min(256, max(1, math.ceil(n_bytes / 10 / tree.bucket_rows / tree.buckets)))
    sent = written(gathered(docs, tree, thirds), "packets")
    most = dict(sent.where(F.col("kind") < DOC).groupBy("kind", "place").agg(F.sum(F.octet_length("keys").cast("long")).alias("n")).groupBy("kind").agg(F.max("n")).collect())
    salts = {kind: max(1, math.ceil(most.get(kind, 0) / 8 / tree.bucket_rows)) for kind in (RUN, WORD)}
    held = written(weighed(counted(sent, RUN, salts[RUN]), tree, thirds), "weighed")
    two = written(pairs(held, tree), "pairs")
    runs_ = written(run_table(held, two, tree), "run-table")
    removed(held)
    words = written(counted(sent, WORD, salts[WORD]).mapInArrow(wide, "place long, keys binary, value binary, total long, learned long"), "word-table")
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    unknown = -math.log10(total + distinct + 1)
    got = replies(sent, runs_, RUN, "<f4", salts[RUN]).unionByName(replies(sent, words.select("place", "keys", "value"), WORD, "<u8", salts[WORD]))

    def score(documents: pa.Table, told: pa.Table) -> pa.Table:
        tables = []
        for kind, value in ((RUN, "<f4"), (WORD, "<u8")):
            own = told.filter(pc.equal(told["kind"], kind))
            tables.append(HashTable(unfolded(own["keys"].to_pylist()), np.frombuffer(b"".join(own["value"].to_pylist()), value)))
        out = []
        for group in groups((i, t, h) for i, t, h in zip(documents["doc_id"].to_pylist(), documents["text"].to_pylist(), documents["held_out"].to_pylist(), strict=True)):
            texts = [t for _, t, _ in group]
            keys, sizes = runs(texts, tree.depth)
            scores = np.add.reduceat(tables[0].get(keys, 0.0), np.cumsum(sizes) - sizes, dtype=np.float64)
            words_ = [words_of(t) for t in texts]
            sizes = np.array([len(w) for w in words_])
            counts = tables[1].get(np.concatenate(words_), 0).astype(float)
            starts = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10(counts + 1.0) + unknown, starts)
            known = np.add.reduceat(counts > 0, starts, dtype=np.int64)
            out.append(pa.table({
                "doc_id": pa.array([i for i, _, _ in group], pa.int64()), "held_out": pa.array([h for _, _, h in group], pa.bool_()), "n_tokens": sizes,
                "n_bytes": np.array([len(t) for t in texts], np.int64), "n_known": known, "base_score": base, "score": scores,
            }))
        return pa.concat_tables(out) if out else documents.schema.empty_table().select([])

    documents = sent.where(F.col("kind") == DOC).select("packet", "doc_id", "held_out", "text")
    found = documents.groupBy("packet").cogroup(got.groupBy("packet")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double")
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' counts as 64-bit values, with their sum and the number of those to learn from."""
    for batch in batches:
        for place, keys, counts in rows(batch, "place", "keys", "counts"):
            keys, counts = unpacked([keys], [counts])
            held = {"place": [place], "keys": pa.array([planes(keys)], pa.binary()), "value": pa.array([counts.astype("<u8").tobytes()], pa.binary())}
            yield pa.RecordBatch.from_pydict(held | {"total": [int(counts.sum())], "learned": [int((counts > 0).sum())]})
