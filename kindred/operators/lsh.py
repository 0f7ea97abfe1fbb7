"""Sign random projections of token sets, and neighbours in hash order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.cluster import written


def sign(bit: Column, token: Column) -> Column:
    """+1 or -1 for a bit and a token: the probe's coordinate, the same in every engine. A digest serves 32 bits."""
    digest = F.md5(F.concat_ws(":", F.floor(bit / 32).cast("string"), token).cast("binary"))
    return F.when(F.substr(digest, (bit % 32 + 1).cast("int"), F.lit(1)) >= "8", 1).otherwise(-1)


def _sums(vectors: DataFrame, bits: int) -> DataFrame:
    """(id, s0, s1, ...): the tokens' coordinates on each probe, added up.

    A token's signs are computed once for all records that have it; sums are combined before they are shuffled.
    """
    flat = vectors.select("id", F.explode("tokens").alias("token"))
    signs = flat.select("token").distinct().select("token", F.array(*[sign(F.lit(k), F.col("token")) for k in range(bits)]).alias("signs"))
    return flat.join(signs, "token").groupBy("id").agg(*[F.sum(F.col("signs")[k]).alias(f"s{k}") for k in range(bits)])


def inner_products(vectors: DataFrame, bits: int) -> DataFrame:
    """(id, k, s): the sum of the tokens' coordinates on probe k."""
    return _sums(vectors, bits).select("id", F.posexplode(F.array(*[f"s{k}" for k in range(bits)])).alias("k", "s"))


#: Tokens whose signs a task remembers.
KNOWN_TOKENS = 1 << 18


def hashes(vectors: DataFrame, bits: int) -> DataFrame:
    """(id, hash): bit k is 1 where the tokens' coordinates on probe k add up to more than 0.

    Each id's tokens are added up where they are, instead of making a row for each token; a task makes the signs of a
    token, those of ``sign``, once.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def signs(token: str) -> np.ndarray:
            if token not in known:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                digits = "".join(hashlib.md5(f"{k}:{token}".encode()).hexdigest() for k in range((bits + 31) // 32))
                known[token] = np.where(np.frombuffer(digits.encode(), np.uint8)[:bits] >= ord("8"), 1, -1).astype(np.int32)
            return known[token]

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("tokens")
            words = tokens.flatten().dictionary_encode()
            table = np.stack([signs(t) for t in words.dictionary.to_pylist()])
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))[:-1]])
            sums = np.add.reduceat(table[words.indices.to_numpy()], starts, axis=0)
            letters = np.where(sums > 0, ord("1"), ord("0")).astype(np.uint8).tobytes().decode()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([letters[i * bits : (i + 1) * bits] for i in range(batch.num_rows)], pa.string())], ["id", "hash"])

    sets = vectors.where("size(tokens) > 0").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return sets.mapInArrow(each, T.StructType([vectors.schema["id"], T.StructField("hash", T.StringType())]))


def dense_hashes(df: DataFrame, id_col: str, vector: str, bits: int, width: int) -> DataFrame:
    """The same for arrays of numbers of one width."""
    def bit(k: int) -> Column:
        signs = F.array(*[sign(F.lit(k), F.lit(str(i))) for i in range(width)])
        total = F.aggregate(F.zip_with(vector, signs, lambda x, s: x.cast("double") * s), F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, "1").otherwise("0")

    return df.select(F.col(id_col).alias("id"), F.concat(*[bit(k) for k in range(bits)]).alias("hash"))


def permutation(bits: int, round_: int) -> list[int]:
    """Positions 1 to ``bits`` in an order that depends on the round; round 0 leaves them."""
    if not round_:
        return list(range(1, bits + 1))
    return sorted(range(1, bits + 1), key=lambda i: hashlib.md5(f"{round_}:{i}".encode()).hexdigest())


def permuted(hash_: Column, bits: int, round_: int) -> Column:
    return F.concat(*[F.substring(hash_, i, 1) for i in permutation(bits, round_)])


def all_permuted(hashed: DataFrame, bits: int, rounds: int) -> DataFrame:
    """Every row once for each round, ``_h`` being the hash in that round's permutation, as a number instead of a string."""
    if bits > 63:
        raise ValueError("hashes of more than 63 bits do not fit a number")
    orders = [np.array(permutation(bits, r)) - 1 for r in range(rounds)]
    kept = [f for f in hashed.schema if f.name != "hash"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.select([f.name for f in kept])
            letters = "".join(batch.column("hash").to_pylist()).encode()
            ones = np.frombuffer(letters, np.uint8).reshape(-1, bits) - ord("0")
            wide = np.zeros((batch.num_rows, 64), np.uint8)
            for r, order in enumerate(orders):
                wide[:, 64 - bits :] = ones[:, order]
                number = np.packbits(wide, axis=1).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.full(batch.num_rows, r, np.int32)), pa.array(number)], [*held.schema.names, "_round", "_h"])

    return hashed.mapInArrow(each, T.StructType([*kept, T.StructField("_round", T.IntegerType()), T.StructField("_h", T.LongType())]))


def numbered(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """``df`` with ``_i``, each row's place from 0 on within its group, in the order and then by id.

    Rows are sorted by ranges over all groups; a range's part of a group tells its offset. So no task sees a group.
    """
    held = df.repartitionByRange(*by, *order, "id").sortWithinPartitions(*by, *order, "id")
    held = written(held.withColumn("_m", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_m", 33))
    parts = held.groupBy(*by, "_p").agg(F.min("_m").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_low", F.col("_low") - F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return held.join(parts, [*by, "_p"]).withColumn("_i", F.col("_m") - F.col("_low")).drop("_m", "_p", "_low")


def runs(df: DataFrame, order: list[str], n: int, by: list[str], payload: str = "id", block: int = 8192) -> DataFrame:
    """(by, own, next): the numbers ``payload`` of up to ``block`` rows in the order within their group and then by id,
    and those of the ``n`` rows that follow them in the group.

    Rows are sorted by ranges over all groups, so no task sees a group, and any number of them may be equal. What
    follows a run is put together from the first ``n`` numbers of later runs.
    """
    keys = [df.schema[k] for k in by]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = np.zeros(size, bool)
            new[::block] = True
            for k in by:
                code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], size)
            numbers = batch.column("_number").to_numpy(zero_copy_only=False)
            heads = [numbers[x : min(y, x + n)] for x, y in zip(starts, ends, strict=True)]
            own = pa.ListArray.from_arrays(pa.array(np.append(starts, size), pa.int32()), pa.array(numbers))
            head = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(starts)) for k in by], pa.array(at + np.arange(len(starts))), own, head], [*by, "_at", "own", "head"])
            at += len(starts)

    held = df.select(*by, *order, "id", F.col(payload).cast("long").alias("_number")).repartitionByRange(*by, *order, "id").sortWithinPartitions(*by, *order, "id")
    numbers = T.ArrayType(T.LongType())
    schema = T.StructType([*keys, T.StructField("_at", T.LongType()), T.StructField("own", numbers), T.StructField("head", numbers)])
    held = written(held.select(*by, "_number").mapInArrow(cut, schema), "runs")
    later = Window.partitionBy(*by).orderBy("_at").rowsBetween(1, n)
    ahead = held.select(*by, "_at", "head").select("_at", F.slice(F.flatten(F.collect_list("head").over(later)), 1, n).alias("next"))
    return held.drop("head").join(ahead, "_at").select(*by, "own", "next")


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for own, following in zip(batch.column("own"), batch.column("next"), strict=True):
        yield tuple(x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, following))


def _met(own: np.ndarray, following: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every number of a run once with each of its ``n`` followers."""
    row = np.concatenate([own, following])
    ends = [min(len(own), len(row) - d) for d in range(1, n + 1)]
    return np.concatenate([row[: max(0, m)] for m in ends]), np.concatenate([row[d : d + max(0, m)] for d, m in enumerate(ends, 1)])


def neighbours(df: DataFrame, order: list[str], n: int, by: list[str], block: int = 8192) -> DataFrame:
    """(by, a, b): each row's ``n`` followers in the order within its group, which is each unordered pair once.

    Ids are whole numbers.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (own, following) in enumerate(_lists(batch)):
                x, y = _met(own, following, n)
                group = [batch.column(k).take(pa.array(np.full(len(x), i))) for k in by]
                yield pa.RecordBatch.from_arrays([*group, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], [*by, "a", "b"])

    schema = T.StructType([*[df.schema[k] for k in by], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return runs(df, order, n, by, block=block).mapInArrow(pairs, schema)


def hash_runs(df: DataFrame, hash_: str, by: list[str], payload: str = "id") -> DataFrame:
    """(a, b): a star over each run of equal hashes between neighbours by id; it has the components of all pairs.

    ``payload``: the numbers that stand for the rows.
    """
    w = Window.partitionBy(*by).orderBy("id")
    new = F.when(F.col(hash_).eqNullSafe(F.lag(hash_).over(w)), 0).otherwise(1)
    held = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    first = held.groupBy(*by, "_run").agg(F.min("id").alias("_first"), F.min_by(payload, "id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return held.join(first, [*by, "_run"]).where(F.col("id") > F.col("_first")).select("a", F.col(payload).alias("b"))


#: Pairs that are counted at once, about.
PACKET = 1 << 20


def _packets(found: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, a, k, b): the pairs of neighbours in ``found`` (own, next), packed: numbers ``a``, ``k`` larger ones in ``b`` for each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.iinfo(np.int64).min
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            row, around = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            bucket = _bucket(row, buckets)
            order = np.lexsort((row, bucket))
            row, around, bucket = row[order], around[order], bucket[order]
            larger = around > row[:, None]
            many = larger.sum(axis=1)
            some = many > 0
            yield from _packed(bucket[some], row[some], many[some], around[larger])

        for batch in batches:
            for own, following in _lists(batch):
                row = np.concatenate([own, following])
                around = np.full((len(row), 2 * n), least)
                for d in range(1, n + 1):
                    m = min(len(own), len(row) - d)
                    if m > 0:
                        around[:m, d - 1] = row[d : d + m]
                        around[d : d + m, n + d - 1] = row[:m]
                held.append((row, around))
                if sum(len(x) for x, _ in held) * n >= PACKET:
                    yield from flush()
        if held:
            yield from flush()

    return found.select("own", "next").mapInArrow(pack, "bucket int, a binary, k binary, b binary")


def _bucket(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _packed(bucket: np.ndarray, row: np.ndarray, many: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; numbers in four bytes where they fit."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(row))
    after = np.concatenate([[0], np.cumsum(many)])
    kind = np.uint32 if len(b) and row.min() >= 0 and b.max() < 1 << 32 else np.int64
    row, many, b = row.astype(kind), many.astype(np.uint32), b.astype(kind)
    parts = [(int(bucket[x]), row[x:y].tobytes(), many[x:y].tobytes(), b[after[x] : after[y]].tobytes()) for x, y in zip(starts, ends, strict=True)]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "a", "k", "b"])


def _packets_of_pairs(pairs: DataFrame, buckets: int) -> DataFrame:
    """The same for a table of pairs (a, b)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in "ab")
            row, b = np.minimum(x, y), np.maximum(x, y)
            bucket = _bucket(row, buckets)
            order = np.lexsort((row, bucket))
            yield from _packed(bucket[order], row[order], np.ones(len(row), np.int64), b[order])

    return pairs.selectExpr("cast(a as long) a", "cast(b as long) b").mapInArrow(pack, "bucket int, a binary, k binary, b binary")


def _counted(packets: DataFrame, least: int) -> DataFrame:
    """(a, b, count) of packed pairs met more than ``least`` times."""

    def count(table: pa.Table) -> pa.Table:
        xs, ys = [], []
        for a, k, b in zip(*[table.column(name) for name in "akb"], strict=True):
            many = np.frombuffer(k.as_buffer(), np.uint32)
            kind = np.uint32 if a.as_buffer().size == 4 * len(many) else np.int64
            xs.append(np.repeat(np.frombuffer(a.as_buffer(), kind).astype(np.int64), many))
            ys.append(np.frombuffer(b.as_buffer(), kind).astype(np.int64))
        x, y = np.concatenate(xs), np.concatenate(ys)
        rows, x = np.unique(x, return_inverse=True)
        base = int(y.min())
        others = None
        if (int(y.max()) - base + 1) * len(rows) >= 1 << 62:
            others, y = np.unique(y, return_inverse=True)
            base = 0
        width = int(y.max()) - base + 1
        key = np.sort(x * width + (y - base))
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        many = np.diff(np.append(starts, len(key)))
        keep = many > least
        x, y = np.divmod(key[starts[keep]], width)
        y = y + base if others is None else others[y]
        return pa.table({"a": rows[x], "b": y, "count": many[keep]})

    return packets.groupBy("bucket").applyInArrow(count, "a long, b long, count long")


def hash_neighbours(hashed: DataFrame, bits: int, rounds: int, n: int, by: list[str], payload: str = "id") -> DataFrame:
    """``runs`` of the rows (id, hash) under each round's permutation."""
    each = all_permuted(hashed.select(*dict.fromkeys(["id", payload, *by]), "hash"), bits, rounds)
    return runs(each, ["_h"], n, ["_round", *by], payload)


def candidate_pairs(hashed: DataFrame, bits: int, rounds: int, n: int, by: list[str], least: int = 0) -> DataFrame:
    """(a, b, count): pairs that are neighbours under more than ``least`` permutations of the bits, with how many.

    ``by``: groups in which neighbours are looked for; none for one order of all rows. Pairs travel packed, by a hash
    of the smaller id, and are counted a bucket at a time.
    """
    buckets = 1 + hashed.count() * rounds * n // PACKET
    return _counted(_packets(hash_neighbours(hashed, bits, rounds, n, by), n, buckets), least)


#: Rows that are sorted at once, about.
BLOCK = 1 << 18
#: Rows of a group whose orders a task holds at once, at about 150 bytes a row.
GROUP = 3_000_000
#: Pairs that a task makes, about.
TASK = 1 << 27


def packed_groups(df: DataFrame, by: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """(by, numbers, texts): the rows of a group packed, many in one row; ``numbers`` as eight bytes each, ``texts`` as lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            group = np.zeros(table.num_rows, np.int64)
            for k in by:
                group = np.unique(group * table.num_rows + table.column(k).chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            ends = np.append(starts[1:], len(order))
            own = [table.column(k).chunk(0).to_numpy(zero_copy_only=False).astype(np.int64)[order] for k in numbers]
            words = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), table.column(k).chunk(0).take(pa.array(order))) for k in texts]
            keys = [table.column(k).chunk(0).take(pa.array(order[starts])) for k in by]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([v[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for v in own], *words], [*by, *numbers, *texts])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK // 2:
                yield from flush()
        if held:
            yield from flush()

    schema = T.StructType([*[df.schema[k] for k in by], *[T.StructField(k, T.BinaryType()) for k in numbers], *[T.StructField(k, T.ArrayType(T.StringType())) for k in texts]])
    return df.select(*by, *[F.col(k).cast("long").alias(k) for k in numbers], *texts).mapInArrow(pack, schema)


class Group:
    """The rows of a group by ascending id, with ``numbers`` and ``texts`` of each, and the orders in which they are neighbours.

    A text is told by its place in the order of the group's values, from 1 on; 0 is null.
    """

    def __init__(self, names: pa.Table, hashes: pa.Table, numbers: list[str], texts: list[str], bits: int, rounds: int, n: int, near_names: int):
        ids = [self._whole(t, "id") for t in (names, hashes)]
        self.ids = np.unique(np.concatenate(ids))
        self.repeated = any(len(np.unique(x)) < len(x) for x in ids)
        at = [np.searchsorted(self.ids, x).astype(np.int32) for x in ids]
        self.numbers = {k: np.zeros(len(self.ids), np.int64) for k in numbers}
        for place, table in ((at[1], hashes), (at[0], names)):
            for k in numbers:
                if not table.column(k).null_count:
                    self.numbers[k][place] = self._whole(table, k)
        self.texts = {k: np.zeros(len(self.ids), np.int32) for k in texts}
        for k in texts:
            self.texts[k][at[0]] = self._places(names, k)
        self.orders: list[tuple[np.ndarray, int]] = []
        if len(at[0]):
            self._add(at[0], self._places(names, "NAME"), near_names)
        self.by_id = at[1][np.argsort(at[1], kind="stable")]
        self.equal = np.zeros(0, bool)
        if len(at[1]):
            letters = np.frombuffer("".join(w for x in hashes.column("hash").chunks for w in x.flatten().to_pylist()).encode(), np.uint8).reshape(-1, bits)
            ones = np.packbits(letters - ord("0"), axis=1)
            for r in range(rounds):
                order = np.array(permutation(bits, r)) - 1
                h = np.zeros(len(ones), np.int64)
                for x in range(0, len(h), BLOCK):
                    wide = np.zeros((len(ones[x : x + BLOCK]), 64), np.uint8)
                    wide[:, 64 - bits :] = np.unpackbits(ones[x : x + BLOCK], axis=1)[:, order]
                    h[x : x + BLOCK] = np.packbits(wide, axis=1).view(">i8").ravel()
                if not r:
                    of = h[np.argsort(at[1], kind="stable")]
                    self.equal = np.append(False, of[1:] == of[:-1])
                self._add(at[1], h, n)

    @staticmethod
    def _whole(table: pa.Table, k: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)]])

    @staticmethod
    def _places(table: pa.Table, k: str) -> np.ndarray:
        if not table.num_rows:
            return np.zeros(0, np.int32)
        words = pa.concat_arrays([x.flatten() for x in table.column(k).chunks]).dictionary_encode()
        place = np.zeros(len(words.dictionary) + 1, np.int32)  # the last is that of rows without a text
        place[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(1, len(place))
        return place[words.indices.fill_null(-1).to_numpy(zero_copy_only=False)]

    def _add(self, at: np.ndarray, key: np.ndarray, n: int) -> None:
        self.orders.append((at[np.lexsort((at, key))], n))

    def _every(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs, those that meet in several orders again and again."""
        for order, n in self.orders:
            for d in range(1, min(n, len(order) - 1) + 1):
                yield order[:-d], order[d:]
        yield self._stars()

    def _stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row of a run of equal hashes between neighbours by id, with the run's first."""
        head = np.maximum.accumulate(np.where(self.equal, 0, np.arange(len(self.equal))))
        return self.by_id[head[self.equal]], self.by_id[self.equal]

    def pairs(self, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the rows that meet, each pair in one of the parts and once: in the first order in which it is near."""
        if self.repeated:
            yield from self._distinct(part, parts)
            return
        size = len(self.ids)
        apart = max([1, *[n for _, n in self.orders]])
        ranks: list[np.ndarray] = []
        unit = 0
        for order, n in self.orders:
            own = [d for d in range(1, min(n, len(order) - 1) + 1) if (unit + d) % parts == part]
            unit += n
            met = [np.zeros(len(order) - d, bool) for d in own]
            for rank, (_, near) in zip(ranks, self.orders, strict=False):
                there = rank[order]
                for d, seen in zip(own, met, strict=True):
                    seen |= (there[d:] - there[:-d] + np.int32(near)).view(np.uint32) <= 2 * near
            for d, seen in zip(own, met, strict=True):
                new = ~seen
                yield order[:-d][new], order[d:][new]
            rank = np.arange(1, size + 1, dtype=np.int32) * np.int32(-apart - 1) - np.int32(apart)  # rows that an order lacks are near to none
            rank[order] = np.arange(len(order), dtype=np.int32)
            ranks.append(rank)
        if part == 0:
            x, y = self._stars()
            new = np.ones(len(x), bool)
            for rank, (_, near) in zip(ranks, self.orders, strict=True):
                new &= np.abs(rank[x] - rank[y]) > near
            yield x[new], y[new]

    def _distinct(self, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same where ids are repeated, so that a row has no one place: a share of the smaller ids at a time."""
        shares = parts * (1 + len(self.ids) * sum(n for _, n in self.orders) // (8 * PACKET))
        for share in range(part, shares, parts):
            keys = [np.zeros(0, np.int64)]
            for x, y in self._every():
                low, high = np.minimum(x, y).astype(np.int64), np.maximum(x, y)
                own = (low % shares == share) & (low != high)
                keys.append(np.unique(low[own] * len(self.ids) + high[own]))
            yield np.divmod(np.unique(np.concatenate(keys)), len(self.ids))


def as_group(table: pa.Table, numbers: list[str], texts: list[str], bits: int, rounds: int, n: int, near_names: int) -> Group:
    """The group of packed rows that ``grouped`` gives."""
    names, hashes = table.filter(pc.is_valid(table.column("NAME"))), table.filter(pc.is_valid(table.column("hash")))
    return Group(names, hashes, numbers, texts, bits, rounds, n, near_names)


def grouped(hashed: DataFrame, records: DataFrame, by: list[str], numbers: list[str], texts: list[str]) -> tuple[DataFrame, int]:
    """The rows (by, id, numbers, NAME, texts, hash) of both tables packed by group, names and hashes apart, and the rows of the largest group."""
    own = ["id", *[k for k in numbers if k != "id"]]
    parts = [packed_groups(records, by, own, ["NAME", *texts]), packed_groups(hashed, by, [k for k in own if k in hashed.columns], ["hash"])]
    held = written(parts[0].unionByName(parts[1], allowMissingColumns=True), "groups")
    sizes = held.groupBy(*by).agg(F.sum(F.when(F.col("NAME").isNotNull(), F.octet_length("id") / 8)).alias("r"), F.sum(F.when(F.col("hash").isNotNull(), F.octet_length("id") / 8)).alias("h"))
    most = sizes.agg(F.max(F.greatest("r", "h"))).first()[0]
    return held, int(most or 0)


def in_parts(held: DataFrame, by: list[str], parts: int) -> DataFrame:
    """The packed rows once for each part (``_part``), those of a group and a part in one task; tasks are not joined, however few bytes they read."""
    tasks = 4 * parts * held.select(*by).distinct().count()
    tasks = min(max(tasks, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 2000)
    return held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, *by, "_part")


def all_candidates(hashed: DataFrame, bits: int, rounds: int, n: int, records: DataFrame, near_names: int, by: list[str], payload: str = "id") -> DataFrame:
    """(a, b), each pair once: neighbours under permutations, neighbours by ``NAME``, and runs of equal hashes.

    ``payload``: the numbers that stand for the rows of both tables; equal hashes and names are in the order of ids.
    A task holds the orders of a group and gives a pair in the first one in which it is near, so that no pair is
    stored or counted. If a group is too large for that, all pairs travel packed and are counted a bucket at a time.
    """
    if bits > 63:
        raise ValueError("hashes of more than 63 bits do not fit a number")
    numbers = list(dict.fromkeys(["id", payload]))
    held, most = grouped(hashed, records, by, numbers, [])
    if most > GROUP:
        return _counted_candidates(hashed, bits, rounds, n, records, near_names, by, payload)
    parts = 1 + most * (rounds * n + near_names) // TASK

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = as_group(pa.Table.from_batches(list(batches)), numbers, [], bits, rounds, n, near_names)
        number = group.numbers[payload]
        for x, y in group.pairs(key[-1].as_py(), parts):
            for i in range(0, len(x), BLOCK):
                a, b = number[x[i : i + BLOCK]], number[y[i : i + BLOCK]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return in_parts(held, by, parts).groupBy(*by, "_part").applyInArrow(each, "a long, b long")


def _counted_candidates(hashed: DataFrame, bits: int, rounds: int, n: int, records: DataFrame, near_names: int, by: list[str], payload: str) -> DataFrame:
    buckets = 1 + hashed.count() * (rounds * n + near_names) // PACKET
    packets = _packets(hash_neighbours(hashed, bits, rounds, n, by, payload), n, buckets)
    packets = packets.union(_packets(runs(records, ["NAME"], near_names, by, payload), near_names, buckets))
    packets = packets.union(_packets_of_pairs(hash_runs(hashed, "hash", by, payload), buckets))
    return _counted(packets, 0).select("a", "b")


def identity_neighbours(hashed: DataFrame, bits: int, rounds: int, n: int, identities: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(identity1, identity2, count): what ``identity_pairs`` makes of the candidates over all rows.

    A count of pairs of records adds up to how often two identities are neighbours, so the pairs of records are not
    made: rows carry their identity's place in the order of identities, and the places that meet are counted, packed
    as one number for both. ``most``: of each bucket of pairs only as many of the most frequent ones, which the most
    frequent of all are among (of equals the first by ``identity1`` and ``identity2``).
    """
    counted, numbers = numbered_neighbours(hashed, bits, rounds, n, identities, least, most)
    named = counted.join(numbers.selectExpr("number identity1", "identity name1"), "identity1").join(numbers.selectExpr("number identity2", "identity name2"), "identity2")
    return named.selectExpr("name1 identity1", "name2 identity2", "count")


def numbered_neighbours(hashed: DataFrame, bits: int, rounds: int, n: int, identities: DataFrame, least: int = 1, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same by numbers instead of identities, in the same order, and the number of each (identity, number)."""
    heads = identities.where("identity is not null").groupBy("identity").agg(F.min("id").alias("id"))
    numbers = written(numbered(heads, ["identity"], []).select("identity", F.col("_i").cast("long").alias("number")), "numbers")
    width = max(1, numbers.count())
    rows = written(hashed.select("id", "hash").join(identities.select("id", "identity"), "id").join(numbers, "identity").select("id", "hash", "number"), "numbered")
    buckets = 1 + rows.count() * rounds * n // PACKET

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, following in zip(batch.column("own"), batch.column("next"), strict=True):
                x, y = _met(np.frombuffer(own.as_buffer(), np.int64), following.values.to_numpy(zero_copy_only=False).astype(np.int64), n)
                other = x != y
                x, y = x[other], y[other]
                key = np.sort(np.minimum(x, y) * width + np.maximum(x, y))
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                key, many = key[starts], np.diff(np.append(starts, len(key)))
                bucket = _bucket(key, buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
                key, many, bucket = key[order], many[order].astype(np.uint32), bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(starts[1:], len(key))
                parts = [[v[i:j].tobytes() for i, j in zip(starts, ends, strict=True)] for v in (key, many)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *[pa.array(v, pa.binary()) for v in parts]], ["bucket", "key", "many"])

    def total(table: pa.Table) -> pa.Table:
        key, many = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)]) for name, kind in (("key", np.int64), ("many", np.uint32)))
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        key, many = key[starts], np.add.reduceat(many[order].astype(np.int64), starts)
        keep = many > least
        key, many = key[keep], many[keep]
        if most is not None:
            first = np.lexsort((key, -many))[:most]
            key, many = key[first], many[first]
        x, y = np.divmod(key, width)
        return pa.table({"identity1": x, "identity2": y, "count": many})

    met = _packed_runs(rows, bits, rounds, n).mapInArrow(count, "bucket int, key binary, many binary")
    return met.groupBy("bucket").applyInArrow(total, "identity1 long, identity2 long, count long"), numbers


def _packed_runs(rows: DataFrame, bits: int, rounds: int, n: int, block: int | None = None) -> DataFrame:
    """(own, next): for each round, the ``number`` of the rows (id, hash, number) in the order of the permuted hash and
    then of the id, in runs of about ``block`` rows, and those of the ``n`` rows that follow a run.

    Rows are dealt packed to ranges of (permuted hash, id) and sorted a range at a time. The ranges' bounds come from
    a sample of the rows; they tell how many rows are sorted at once and nothing else. Any number of hashes may be equal.
    """
    if bits > 63:
        raise ValueError("hashes of more than 63 bits do not fit a number")
    size = rows.count()
    ranges = 1 + size // (block or BLOCK)
    wanted = 2000 + 20 * ranges
    some = (rows if size <= wanted else rows.sample(wanted / size, 7)).select("hash", "id").toArrow() if ranges > 1 else None
    orders = [np.array(permutation(bits, r)) - 1 for r in range(rounds)]

    def ones(hashes: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer("".join(hashes.to_pylist()).encode(), np.uint8).reshape(-1, bits) - ord("0")

    def number(held: np.ndarray, order: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(held), 64), np.uint8)
        wide[:, 64 - bits :] = held[:, order]
        return np.packbits(wide, axis=1).view(">i8").ravel().astype(np.int64)

    bounds: list[tuple[np.ndarray, np.ndarray]] = []
    for order in orders:
        h, i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if some is not None and some.num_rows:
            h, i = number(ones(some.column("hash")), order), some.column("id").to_numpy().astype(np.int64)
            at = np.lexsort((i, h))[np.arange(1, ranges) * len(h) // ranges]
            h, i = h[at], i[at]
        bounds.append((h, i))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            bit = ones(table.column("hash"))
            ids, own = (table.column(k).to_numpy().astype(np.int64) for k in ("id", "number"))
            for r, order in enumerate(orders):
                h = number(bit, order)
                high, higher = bounds[r]
                at = np.searchsorted(high, h, "left")
                past = np.searchsorted(high, h, "right")
                for low in np.unique(at[past > at]):  # bounds of this very hash: the id tells
                    same = (at == low) & (past > low)
                    top = past[same][0]
                    at[same] = low + np.searchsorted(higher[low:top], ids[same], "right")
                    past[same] = 0
                order_ = np.argsort(at, kind="stable")
                at = at[order_]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                ends = np.append(starts[1:], len(at))
                parts = [[v[order_[i:j]].tobytes() for i, j in zip(starts, ends, strict=True)] for v in (h, ids, own)]
                yield pa.RecordBatch.from_arrays([pa.array(r * ranges + at[starts], pa.int64()), *[pa.array(v, pa.binary()) for v in parts]], ["at", "hashes", "ids", "own"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK // 2:
                yield from flush()
        if held:
            yield from flush()

    def sort(table: pa.Table) -> pa.Table:
        h, ids, own = (np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in table.column(k)]) for k in ("hashes", "ids", "own"))
        own = own[np.lexsort((ids, h))]
        at = table.column("at")[0].as_py()
        return pa.table({"round": pa.array([at // ranges], pa.int32()), "at": pa.array([at], pa.int64()), "own": pa.array([own.tobytes()], pa.binary()), "head": pa.array([own[:n]], pa.list_(pa.int64()))})

    dealt = rows.select("id", "hash", "number").mapInArrow(deal, "at long, hashes binary, ids binary, own binary")
    held = written(dealt.groupBy("at").applyInArrow(sort, "round int, at long, own binary, head array<long>"), "runs")
    later = Window.partitionBy("round").orderBy("at").rowsBetween(1, n)
    ahead = held.select("round", "at", "head").select("at", F.slice(F.flatten(F.collect_list("head").over(later)), 1, n).alias("next"))
    return held.select("at", "own").join(ahead, "at").select("own", "next")


def identity_pairs(pairs: DataFrame, identities: DataFrame, least: int = 1) -> DataFrame:
    """(identity1, identity2, count): pairs of different identities met more than ``least`` times."""
    a = identities.selectExpr("id a", "identity ia")
    b = identities.selectExpr("id b", "identity ib")
    held = pairs.join(a, "a").join(b, "b").where("ia <> ib")
    weight = F.sum("count") if "count" in pairs.columns else F.count("*")
    counted = held.groupBy(F.least("ia", "ib").alias("identity1"), F.greatest("ia", "ib").alias("identity2")).agg(weight.alias("count"))
    return counted.where(F.col("count") > least)


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent pairs."""
    return pairs.orderBy(F.desc("count"), "identity1", "identity2").limit(n)
