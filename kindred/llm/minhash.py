"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Documents with equal shingle sets form a class, by a digest of the set; classes are what is compared.
2. Every class posts its signature's coordinate-value pairs. A pair that only one class has is dropped.
   What two classes share of the posting coordinates follows Bin(coords, Jaccard), so a link of the wanted
   similarity has ``agree`` collisions or more but for a chance of ``Match.missed()``. Under one order of
   the pairs, rarest first, two classes with ``agree`` common pairs meet in their first
   ``coords - agree + 1`` ones; only this prefix is joined, which skips the pairs of passages that
   many unlike documents share.
3. Star round: within each posting every class meets the first, by doc_id. Links are confirmed on the full sets and
   contracted, so that a group of near copies is one component before pairs are listed.
4. Rest round: of the postings that still hold several components, classes go whose shingles other classes don't
   hold (see ``shared_enough``). In those that are still mixed, all classes outside the largest component meet the
   whole posting, in blocks. Pairs that collide often enough, and whose similarity has an upper
   bound (see ``upper``) high enough, are confirmed as well.

No posting is cut and no pair is left out; a group's copies never turn into all its pairs.

Rows: texts that are null or without words have an empty set and are linked with nothing. Rows with the same
doc_id are one node: what any of their texts reaches, all reach. A row without doc_id belongs to the class of its
text, if there is one. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.text import U64, binomial_tail, fresh, groups, lower_ascii, map_groups, mix, rows, segment_min, windows, word_hashes, written


@dataclass(frozen=True)
class Match:
    shingle: int = 5
    #: Link where 100 * intersection >= percent * union.
    percent: int = 85
    #: Posted coordinates of 64 bits, and collisions wanted among them.
    coords: int = 32
    agree: int = 16
    #: Bits of a set's bitmap for each shingle, and for all of them at most.
    bits_each: int = 16
    bits_most: int = 1 << 16
    #: Classes that meet in one block.
    block: int = 256
    seed: int = 7

    def missed(self) -> float:
        return binomial_tail(self.coords, self.percent / 100, self.agree)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        factor, shift = rng.integers(0, 1 << 63, (2, self.coords), np.uint64) << U64(1) | U64(1)
        return factor, shift


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence is one where it has fewer words."""
    words = lower_ascii(text or b"").split()
    return np.unique(windows(word_hashes(words), min(n, len(words)))) if words else np.empty(0, U64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) == 0 or len(b) == 0 or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, match: Match) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, and for non-empty sets the digest and the posted pairs."""

    def work(group: list[tuple]) -> dict:
        factor, shift = match.factors()
        sets = [shingle_set(text, match.shingle) for _, text, _ in group]
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        tokens = np.zeros((len(some), match.coords), np.int64)
        if len(some):
            held = np.concatenate([sets[i] for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            for c in range(match.coords):
                tokens[:, c] = mix(segment_min((held ^ shift[c]) * factor[c], starts) ^ U64(c + 1)).view(np.int64)
        at = dict(zip(some.tolist(), range(len(some)), strict=True))
        return {
            "doc_id": pa.array([i for i, _, _ in group], pa.int64()),
            "h": pa.array([h for _, _, h in group], pa.int64()),
            "n_shingles": pa.array(sizes, pa.int64()),
            "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "tokens": pa.array([tokens[at[i]] if i in at else None for i in range(len(group))], pa.list_(pa.int64())),
        }

    return map_groups(docs, ["doc_id", "text", "h"], work, "doc_id long, h long, n_shingles long, digest binary, tokens array<long>")


def postings(classes: DataFrame, match: Match) -> DataFrame:
    """Prefix pairs of the classes that share enough of theirs: class_id, doc_id, tokens, prefix array<long>."""
    each = classes.select("class_id", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = each.join(shared, "token").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    own = own.where(F.size("shared") >= match.agree).select("class_id", F.expr(f"transform(slice(shared, 1, size(shared) - {match.agree - 1}), x -> x.token)").alias("prefix"))
    return classes.join(own, "class_id")


def bitmap(held: np.ndarray, match: Match) -> np.ndarray:
    """Words of a bitmap with the bit of each shingle hash set; a power of two of them by the size of the set."""
    n = min(match.bits_most, 1 << max(6, (match.bits_each * len(held) - 1).bit_length()))
    bits = np.zeros(n, np.uint8)
    bits[held & U64(n - 1)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def bitmaps(texts: DataFrame, match: Match) -> DataFrame:
    """class_id, size and bitmap of each text's shingle set."""

    def work(group: list[tuple]) -> dict:
        sets = [shingle_set(text, match.shingle) for _, text in group]
        return {"class_id": pa.array([i for i, _ in group], pa.int64()), "size": pa.array([len(x) for x in sets], pa.int64()), "bits": pa.array([bitmap(x, match).tobytes() for x in sets], pa.binary())}

    return map_groups(texts, ["class_id", "text"], work, "class_id long, size long, bits binary")


def upper(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At most so many shingles has a set in common with each of some others, by their bitmaps.

    A bit that only one side has stands for a shingle, or more, that the other side lacks.
    """
    n = min(len(bits), others.shape[1])
    bits, others = fold(bits[None], n)[0], fold(others, n)
    own = size - np.bitwise_count(bits & ~others).sum(1, dtype=np.int64)
    return np.minimum(own, sizes - np.bitwise_count(others & ~bits).sum(1, dtype=np.int64))


def fold(bits: np.ndarray, n: int) -> np.ndarray:
    """The bitmaps that the same sets have with ``n`` words."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, n), axis=1)


def likely(left: pd.DataFrame, right: pd.DataFrame, match: Match) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of different components with enough collisions and a high enough upper bound."""
    lt, rt = np.stack(left.tokens.to_numpy()), np.stack(right.tokens.to_numpy())
    lc, rc = left.component.to_numpy(), right.component.to_numpy()
    ls, rs = left["size"].to_numpy(), right["size"].to_numpy()
    width = right.bits.map(len).to_numpy()
    parts = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        parts.append((at, np.frombuffer(b"".join(right.bits.iloc[at]), U64).reshape(len(at), -1)))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(len(left)):
        good = (rc != lc[i]) & (100 * np.minimum(rs, ls[i]) >= match.percent * np.maximum(rs, ls[i]))
        good[good] = (rt[good] == lt[i]).sum(1) >= match.agree
        bits = np.frombuffer(left.bits.iloc[i], U64)
        for at, others in parts:
            some = good[at]
            if some.any():
                at = at[some]
                common = upper(ls[i], bits, rs[at], others[some])
                at = at[100 * common >= match.percent * (ls[i] + rs[at] - common)]
                found.append((np.full(len(at), i), at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def star_pairs(posted: DataFrame, match: Match) -> DataFrame:
    """Each class with the one of the smallest doc_id in each of its postings, where they collide often enough."""
    flat = posted.select("class_id", "doc_id", F.explode("prefix").alias("token"))
    least = flat.groupBy("token").agg(F.min(F.struct("doc_id", "class_id")).alias("least"), F.count("*").alias("n")).where("n > 1").selectExpr("token", "least.class_id b")
    pairs = flat.join(least, "token").where("class_id <> b").selectExpr("class_id a", "b").distinct()
    pairs = pairs.join(posted.selectExpr("class_id a", "tokens ta"), "a").join(posted.selectExpr("class_id b", "tokens tb"), "b")
    hits = F.expr("aggregate(zip_with(ta, tb, (x, y) -> int(x = y)), 0, (s, x) -> s + x)")
    return pairs.where(hits >= match.agree).select("a", "b")


def mixed_postings(flat: DataFrame, match: Match) -> DataFrame:
    """The postings of (class_id, component, token) that hold several components, with the largest and the blocks they make."""
    parts = flat.groupBy("token", "component").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return mixed.selectExpr("token", "most.component main", f"int(ceil(n / {match.block})) chunks", f"int(ceil((n - most.k) / {match.block})) asks")


def shared_enough(texts: DataFrame, match: Match) -> DataFrame:
    """class_id of the texts of which other texts together hold enough shingles for a link.

    What no other text has can't be in an intersection; so unlike documents that share a passage go without being
    paired. Counts alone tell: a shingle that one text has is counted against that text.
    """

    def work(group: list[tuple]) -> dict:
        sets = [shingle_set(text, match.shingle) for _, text in group]
        return {"class_id": pa.array([i for i, _ in group], pa.int64()), "held": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))}

    sets = map_groups(texts, ["class_id", "text"], work, "class_id long, held array<long>")
    each = sets.select("class_id", F.explode("held").alias("shingle"))
    own = each.groupBy("shingle").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    own = own.groupBy("class_id").agg(F.sum(F.expr("int(n = 1)")).alias("alone"))
    sizes = sets.selectExpr("class_id", "size(held) size")
    return sizes.join(own, "class_id", "left").where(f"100 * (size - coalesce(alone, 0)) >= {match.percent} * size").select("class_id")


def rest_pairs(posted: DataFrame, texts: DataFrame, labels: DataFrame, match: Match) -> DataFrame:
    """Colliding pairs of different components, of each posting that holds several."""
    own = posted.join(labels.selectExpr("node class_id", "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    own = written(own.select("class_id", "component", "tokens", "prefix"), "members")
    flat = own.select("class_id", "component", F.explode("prefix").alias("token"))
    some = written(flat.join(mixed_postings(flat, match).select("token"), "token", "left_semi").select("class_id").distinct(), "mixed")
    some = written(shared_enough(texts.join(some, "class_id", "left_semi"), match), "mixed")
    bits = written(bitmaps(texts.join(some, "class_id", "left_semi"), match), "bitmaps")
    flat = flat.join(some, "class_id", "left_semi")
    flat = flat.join(mixed_postings(flat, match), "token").withColumn("h", F.xxhash64("class_id"))
    ask = flat.where("component <> main").selectExpr("token", "class_id", "1 asks", "int(pmod(h, asks)) q", "explode(sequence(0, chunks - 1)) c")
    told = flat.selectExpr("token", "class_id", "0 asks", "explode(sequence(0, asks - 1)) q", "int(pmod(h, chunks)) c")
    meet = ask.union(told).join(own.join(bits, "class_id"), "class_id")

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.asks == 1], group[group.asks == 0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        token = group.token.iloc[0]
        i, j = likely(left, right, match)
        lp, rp = [set(x) for x in left.prefix], [set(x) for x in right.prefix]
        first = np.array([min(lp[x] & rp[y]) == token for x, y in zip(i, j, strict=True)], bool)
        a, b = left.class_id.to_numpy()[i[first]], right.class_id.to_numpy()[j[first]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    return meet.groupBy("token", "q", "c").applyInPandas(pairs, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, match: Match) -> DataFrame:
    """The pairs that the full shingle sets link."""
    both = pairs.join(texts.selectExpr("class_id a", "text ta"), "a").join(texts.selectExpr("class_id b", "text tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}

        def shingles(text: bytes) -> np.ndarray:
            key = xxhash.xxh3_128_digest(text)
            if key not in held:
                if len(held) >= 256:
                    held.clear()
                held[key] = shingle_set(text, match.shingle)
            return held[key]

        for batch in batches:
            for group in groups((a, ta or b"", b, tb or b"") for a, ta, b, tb in rows(batch, "a", "ta", "b", "tb")):
                good = [(a, b) for a, ta, b, tb in group if linked(shingles(ta), shingles(tb), match.percent)]
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good, strict=True)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def hashed(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) h")


def grouped(docs: DataFrame, match: Match) -> DataFrame:
    """doc_id, h, n_shingles, class_id, group, head for every row of ``docs`` (doc_id, text, h).

    ``group`` numbers the texts that are linked, whatever their doc_ids, and ``head`` is the smallest doc_id in it.
    """
    drawn = written(sketches(docs, match), "sketches")
    # the rows that stand for a class: equal (doc_id, h) have equal texts, and so equal tokens
    least = drawn.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    least = written(least.selectExpr("digest", "first.doc_id", "first.h", "monotonically_increasing_id() class_id"), "classes")
    classes = drawn.select("digest", "doc_id", "h", "tokens").join(least, ["digest", "doc_id", "h"]).select("class_id", "doc_id", "tokens").dropDuplicates(["class_id"])
    posted = written(postings(classes, match), "postings")
    asked = least.join(posted.select("class_id"), "class_id", "left_semi").select("doc_id", "h", "class_id")
    texts = written(docs.join(asked, ["doc_id", "h"]).groupBy("doc_id", "h", "class_id").agg(F.first("text").alias("text")).select("class_id", "text"), "texts")
    links = written(confirmed(star_pairs(posted, match), texts, match), "links")
    labels = components(links)
    more = written(confirmed(rest_pairs(posted, texts, labels, match), texts, match), "links")
    labels = components(links.union(more))
    least = least.join(labels.selectExpr("node class_id", "component"), "class_id", "left").selectExpr("digest", "class_id", "doc_id", "coalesce(component, class_id) group")
    heads = least.groupBy("group").agg(F.min("doc_id").alias("head"))
    least = least.drop("doc_id").join(heads, "group")
    return written(drawn.select("doc_id", "h", "n_shingles", "digest").join(least, "digest", "left").drop("digest"), "groups")


def joined(found: DataFrame) -> DataFrame:
    """The rows of ``grouped`` with component_id: the smallest doc_id that a row's doc_id reaches.

    A doc_id that is repeated with unlike texts is an edge between their groups, and takes its empty texts along.
    """
    some = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count("*").alias("n"), F.count("group").alias("told"))
    some = written(some.where("a <> b or (0 < told and told < n)").select("doc_id", "a"), "repeated")
    if some.isEmpty():
        return found.withColumn("component_id", F.coalesce("head", "doc_id"))
    heads = written(found.where("group is not null").select("group", "head").distinct(), "heads")
    labels = components(found.where("group is not null").join(some, "doc_id").selectExpr("a", "group b").distinct())
    heads = heads.join(labels.selectExpr("node group", "component"), "group", "left").withColumn("component", F.coalesce("component", "group"))
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    heads = written(heads.join(least, "component").select("group", "component_id"), "heads")
    mine = some.join(heads.withColumnRenamed("group", "a"), "a").selectExpr("doc_id", "component_id own")
    return found.join(heads, "group", "left").join(mine, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "own", "doc_id"))


def near_duplicates(docs: DataFrame, match: Match | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id long, text string)."""
    found = joined(grouped(hashed(docs), match or Match()))
    return found.selectExpr("doc_id", "n_shingles", "component_id", "coalesce(doc_id = component_id, component_id is null) kept")


def keep_one(docs: DataFrame, match: Match | None = None) -> DataFrame:
    """The documents that stay: of each group of linked texts the one with the smallest doc_id, all columns unchanged.

    Rows without doc_id stay, and so do rows that share the doc_id and the group that stays. A doc_id that is
    repeated with unlike texts is judged text by text, so that a text goes only where one that is linked with it stays.
    """
    id_, h = fresh(docs, "gone", "h")
    gone = grouped(hashed(docs), match or Match()).where("doc_id <> head").selectExpr(f"doc_id {id_}", f"h {h}").distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[id_]) & (F.xxhash64(docs["text"]) == gone[h]), "left_anti")
