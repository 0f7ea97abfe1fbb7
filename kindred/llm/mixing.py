"""Mixing sources to target weights over fixed-length blocks.

1. Every document's words get a place in its source's stream: documents go to about sqrt(n) hash buckets, bucket
   totals give each bucket's offset and a window inside the bucket the rest, so no task sees a whole source.
2. The stream is cut into blocks of ``block_words``; a source's target in words gives its number of slots.
3. Output shards draw their source counts from a multinomial over the slots that are still open, so that the
   counts of all shards add up to the targets. Draws go down a tree of shard ranges, a level a pass, so that no
   task draws for more than ``fan`` of them, however many shards there are.
4. A source's slots run through its blocks in epochs; slot i of epoch e is block perm(i), a pseudorandom
   permutation of the block numbers keyed by source and epoch. No block is used more often than one time above
   any other of its source, and none more than ``cap`` times.
5. Slots and blocks join by (source, block).

The driver holds two numbers for each source; nothing else that it holds grows with the data.

Rows: a null text has size 0 and is never taken; a null source is a source of its own, the last one. Rows with the
same doc_id have places of their own. Equal inputs give equal mixes whatever the partitioning. Extra columns are
passed on whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.text import U64, fresh, groups, map_groups, mix, rows, word_count, word_spans, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    #: All targets together are this share of all words.
    share: float = 1.5
    #: No target is above so many times its source's size.
    cap: int = 2
    block_words: int = 128
    shard_slots: int = 8192
    #: Parts that a range of shards is drawn for at a time.
    fan: int = 64
    seed: int = 17


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to the weights; what is above ``cap`` sizes is shared again among the others."""
    left, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Swap-or-not shuffle: position x of 0..n-1 under the permutation of ``key``, element by element."""
    x, n = x.astype(U64), n.astype(U64)
    for r in range(rounds):
        k = mix(key + U64(2 * r + 1)) % n
        other = (k + n - x) % n
        swap = mix(np.maximum(x, other) ^ mix(key + U64(2 * r + 2))) >> U64(63) == 1
        x = np.where(swap, other, x)
    return x.astype(np.int64)


def draws(slots: np.ndarray, shards: int, fan: int, size: int, seed: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A range of shards in up to ``fan`` parts: (first shard, shards, slots before, slots) of each.

    ``slots`` has the open slots of each source; every part draws its own from a multinomial over those still open.
    """
    rng = np.random.default_rng(seed)
    left, used, each = slots.copy(), np.zeros_like(slots), -(-shards // fan)
    for first in range(0, shards, each):
        n = min(each, shards - first)
        want = min(n * size, int(left.sum()))
        got = np.zeros_like(slots)
        while want:
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got += more
            left -= more
            want -= int(more.sum())
        yield first, n, used.copy(), got
        used += got


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text."""

    def work(group: list[tuple]) -> dict:
        return {
            "doc_id": pa.array([i for i, _, _, _ in group], pa.int64()),
            "source": pa.array([None if s is None else s.decode() for _, _, s, _ in group], pa.string()),
            "size": pa.array([word_count(t or b"") for _, t, _, _ in group], pa.int64()),
            "h": pa.array([h for _, _, _, h in group], pa.int64()),
        }

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(source as string) source", "xxhash64(text) h")
    return map_groups(docs, ["doc_id", "text", "source", "h"], work, "doc_id long, source string, size long, h long")


@dataclass
class Plan:
    """``places``: doc_id, source, size, h, s (number of the source), start; ``targets`` by s."""

    places: DataFrame
    sizes: list[int]
    targets: list[float]
    mix: Mix

    def blocks(self) -> DataFrame:
        """The part of each document in each block: s, block, start (of the document), word_from, n_words."""
        n = self.mix.block_words
        each = self.places.where("size > 0").selectExpr("s", "start", "size", f"explode(sequence(start div {n}, (start + size - 1) div {n})) block")
        return each.selectExpr("s", "block", "start", f"greatest(0, block * {n} - start) word_from", f"least(start + size, (block + 1) * {n}) - greatest(start, block * {n}) n_words")

    def shards(self) -> DataFrame:
        """The draw of every output shard: first (its number), shards (1), and s, before, n, blocks by source."""
        spark, mix_ = self.places.sparkSession, self.mix
        n_blocks = [-(-x // mix_.block_words) for x in self.sizes]
        slots = [min(mix_.cap * b, round(t * b / x)) if x else 0 for x, t, b in zip(self.sizes, self.targets, n_blocks, strict=True)]
        some = [i for i, n in enumerate(slots) if n]
        schema = "first long, shards long, s array<long>, before array<long>, n array<long>, blocks array<long>"
        count = -(-sum(slots) // mix_.shard_slots)
        table = spark.createDataFrame([(0, count, some, [0] * len(some), [slots[i] for i in some], [n_blocks[i] for i in some])] if some else [], schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for top, shards, *by_source in rows(batch, "first", "shards", "s", "before", "n", "blocks"):
                    s, before, n, blocks = (np.array(x, np.int64) for x in by_source)
                    for first, part, used, got in draws(n, shards, mix_.fan, mix_.shard_slots, (mix_.seed, top, shards)):
                        held = np.flatnonzero(got)
                        out = (s[held], (before + used)[held], got[held], blocks[held])
                        yield pa.RecordBatch.from_pydict({"first": [top + first], "shards": [part]} | {c: pa.array([x], pa.list_(pa.int64())) for c, x in zip(("s", "before", "n", "blocks"), out, strict=True)})

        while count > 1:
            table, count = table.mapInArrow(run, schema), -(-count // mix_.fan)
            table = table.repartition(spark.sparkContext.defaultParallelism * 4, "first")
        return table

    def slots(self) -> DataFrame:
        """Every output slot: shard, slot, s, epoch, block."""
        seed = self.mix.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, *by_source in rows(batch, "first", "s", "before", "n", "blocks"):
                    for s, first, count, size in zip(*by_source, strict=True):
                        i = np.arange(first, first + count, dtype=np.int64)
                        epoch = i // size
                        key = mix(mix(np.full(count, s, U64) + U64(seed)) ^ epoch.astype(U64))
                        block = permuted(i % size, np.full(count, size), key)
                        yield pa.RecordBatch.from_pydict({"shard": np.full(count, shard), "slot": i, "s": np.full(count, s), "epoch": epoch, "block": block})

        return self.shards().mapInArrow(run, "shard long, slot long, s long, epoch long, block long")

    def assembled(self) -> DataFrame:
        """What each output slot holds: shard, slot, s, epoch, block, start (of the document), word_from, n_words."""
        return self.slots().hint("merge").join(self.blocks(), ["s", "block"])  # the planner takes the slots for as few as the draws


def plan(docs: DataFrame, mix_: Mix | None = None, distinct: bool = False) -> Plan:
    """Places and targets of ``docs`` (doc_id long, text string, source string); ``distinct``: equal rows share a place."""
    mix_ = mix_ or Mix()
    drawn = sized(docs)
    drawn = written(drawn.dropDuplicates() if distinct else drawn, "sizes")
    buckets = max(1, math.isqrt(drawn.count()))
    drawn = drawn.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    parts = written(drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    per_source = parts.groupBy("source").agg(F.sum("words").alias("words")).collect()
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.words) for r in per_source]
    targets = water_fill(sizes, [mix_.weights[i % len(mix_.weights)] for i in range(len(sizes))], mix_.share, mix_.cap)
    numbers = docs.sparkSession.createDataFrame([(r.source, i) for i, r in enumerate(per_source)], "source string, s long")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    offsets = offsets.alias("o").join(F.broadcast(numbers.alias("n")), F.col("o.source").eqNullSafe(F.col("n.source"))).selectExpr("o.source source", "bucket", "offset", "s")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    placed = placed.selectExpr("doc_id", "d.source source", "size", "h", "s", "start + offset start")
    return Plan(written(placed, "places"), sizes, targets, mix_)


def mixed(docs: DataFrame, mix_: Mix | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``."""
    p = plan(docs, mix_)
    totals = docs.sparkSession.createDataFrame([(i, x, float(t)) for i, (x, t) in enumerate(zip(p.sizes, p.targets, strict=True))], "s long, source_size long, target double")
    taken = p.assembled().groupBy("s", "start").agg(F.sum("n_words").alias("taken"))
    some = p.places.where("size > 0").join(taken, ["s", "start"], "left").select("doc_id", "source", "size", "s", "taken")
    none = p.places.where("size = 0").selectExpr("doc_id", "source", "size", "s", "cast(null as long) taken")
    found = some.union(none).join(F.broadcast(totals), "s")
    return found.selectExpr("doc_id", "source", "size", "source_size", "target", "coalesce(taken, 0) taken")


def take(docs: DataFrame, mix_: Mix | None = None) -> DataFrame:
    """The mix as documents: each with the words that the mix takes of it, those taken twice repeated after the rest.

    Columns as in ``docs``, with text and n_chars of what is taken; a document of which nothing is taken goes.
    Repeated rows (same doc_id, source and text) share one place in the mix and each return with it.
    """
    p = plan(docs, mix_, distinct=True)
    id_, source, h, held = fresh(docs, "doc_id", "source", "h", "parts")
    parts = p.assembled().groupBy("s", "start", "word_from", "n_words").agg(F.count("*").alias("uses"))
    parts = parts.groupBy("s", "start").agg(F.sort_array(F.collect_list(F.struct("word_from", "n_words", "uses"))).alias("parts"))
    parts = p.places.join(parts, ["s", "start"]).selectExpr(f"doc_id {id_}", f"source {source}", f"h {h}", f"parts {held}")
    same = docs["doc_id"].cast("long").eqNullSafe(parts[id_]) & (F.xxhash64(docs["text"]) == parts[h]) & docs["source"].cast("string").eqNullSafe(parts[source])
    joined = docs.join(parts, same).select(*(docs[c] for c in docs.columns), held)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in groups(rows(batch, held, "text")):
                here = batch.slice(at, len(group))
                at += len(group)
                texts = [cut(t, ranges) for ranges, t in group]
                out = {f.name: here.column(here.schema.names.index(f.name)) for f in schema}
                out["text"] = pa.array(texts, pa.string())
                if "n_chars" in out:
                    out["n_chars"] = pa.array([len(t) for t in texts], out["n_chars"].type)
                yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(run, schema)


def cut(text: bytes, parts: list[dict]) -> str:
    """The taken words of a text: runs of neighbouring parts as they stand in the text, one run to a line."""
    runs: list[list[int]] = []
    for time in range(max(p["uses"] for p in parts)):
        end = None
        for p in parts:
            if p["uses"] > time:
                if p["word_from"] == end:
                    runs[-1][1] = end = end + p["n_words"]
                else:
                    end = p["word_from"] + p["n_words"]
                    runs.append([p["word_from"], end])
    begin, end = word_spans(text, [a for a, _ in runs], [b - 1 for _, b in runs])
    return b"\n".join(text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)).decode()
