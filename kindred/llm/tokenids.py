"""Token-ID output: documents to ids, ids to Huffman-coded chunks, chunks back to ids.

1. Texts are encoded by the tokenizers library and kept as packed ids in the shared folder.
2. Each task counts its ids as it goes; the code lengths follow from the global sums on the driver, whose part is
   bounded by the vocabulary.
3. Documents are range-partitioned and sorted by doc_id; every partition writes its chunks (see huffman.py) as the
   rows of a Parquet file, so that any store that Spark writes to will do and a lost task is done again.

Rows: a null text is empty and has the end id alone. Rows with the same doc_id follow one another, by a hash of their
ids, those without doc_id come first. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.huffman import Code, code_lengths, pack, unpack
from kindred.llm.text import groups, lower_ascii, rows, shared_dir, written


@dataclass(frozen=True)
class Output:
    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    #: The tokenizer drops white space and case, so that words can be encoded apart from each other, and lowered.
    by_words: bool = True
    end_id: int = 1
    block_ids: int = 512
    #: A chunk is closed with the document that takes it to so many ids; a shard has about so many.
    chunk_ids: int = 1 << 20
    shard_ids: int = 8 << 20
    #: Words whose ids a Python worker remembers, in each of two generations.
    memo: int = 800_000


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level BPE has for each byte: its own, where that is printable."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: Slots that tell whether a word was seen before, less one; two words in one slot are both kept at once.
SEEN = (1 << 22) - 1


class WordIds:
    """Packed ids of a text, word by word, by a tokenizer that drops white space.

    Words that are Latin-1 letters, with full stops or commas after them, go to the library's model without its
    normaliser and splitter, which would only lower them and cut before the stops; all others are encoded in full.
    """

    def __init__(self, output: Output) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(output.tokenizer)
        self.size = max(self.tokenizer.get_vocab_size(), output.end_id + 1)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self.packed([output.end_id])
        self.letters, self.limit = byte_letters(), output.memo
        self.model = self.tokenizer.model if output.by_words else None
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN + 1)
        owner = self

        class Memo(dict):
            """Keeps a word's ids from the second time on, as most distinct words occur once."""

            def __missing__(self, word: bytes) -> bytes:
                found = owner.old.get(word)
                if found is None:
                    found = owner.found(word)
                    at = hash(word) & SEEN
                    if not owner.seen[at]:
                        owner.seen[at] = 1
                        return found
                if len(self) >= owner.limit:
                    owner.old = dict(self)
                    owner.seen = bytearray(SEEN + 1)
                    self.clear()
                self[word] = found
                return found

        self.memo = Memo()

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def found(self, word: bytes) -> bytes:
        """The ids of a word that is not remembered; the plainest words take the shortest way."""
        if word.isalpha() and word.islower():
            return array(self.code, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        if word[-1] in b".," and word[:-1].isalpha():
            return self.memo[word[:-1]] + self.memo[word[-1:]]
        return self.encode(word.decode("utf-8", "replace"))

    def encode(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if core.isalpha() and max(core) <= "\xff":
            plain = core.lower()
            if plain != word:
                found = self.memo[plain.encode()]
                return found + self.memo[word[len(core) :].encode()] if len(core) < len(word) else found
            return self.packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: bytes) -> bytes:
        if self.model is None:
            return self.packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids) + self.end
        plain = lower_ascii(text)
        if any(s in plain for s in self.special):  # special strings are told by case
            plain = text
        return b"".join(map(self.memo.__getitem__, plain.split())) + self.end


_encoders: dict[Output, WordIds] = {}


def encoder(output: Output) -> WordIds:
    """The Python worker's own encoder, kept from task to task for what it remembers."""
    if output not in _encoders:
        _encoders.clear()
        _encoders[output] = WordIds(output)
    return _encoders[output]


def encoded(docs: DataFrame, output: Output) -> DataFrame:
    """doc_id and packed ids of every document; and how often each id occurs (ids null, counts), once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(output)
        total = np.zeros(make.size, np.int64)

        def out(doc_ids: list, ids: list, counts: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc_ids, ids, counts), kinds, strict=True)], names=["doc_id", "ids", "counts"])

        for batch in batches:
            for group in groups(rows(batch, "doc_id", "text")):
                ids = [make(t or b"") for _, t in group]
                total += np.bincount(np.frombuffer(b"".join(ids), make.kind), minlength=make.size)
                yield out([i for i, _ in group], ids, [None] * len(ids))
        some = np.flatnonzero(total)
        yield out([None], [None], [np.concatenate([some, total[some]]).tobytes()])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return written(docs.mapInArrow(run, "doc_id long, ids binary, counts binary"), "ids")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often every id occurs over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (packed,) in rows(batch, "counts"):
                some, n = np.frombuffer(packed, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": some, "n": n})

    counts = np.zeros(size, np.int64)
    each = ids.select("counts").where("counts is not null").mapInArrow(run, "id long, n long")
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, path: str, output: Output | None = None) -> None:
    """Write the ids of ``docs`` (doc_id long, text string) under ``path``: codebook and chunks."""
    output = output or Output()
    spark = docs.sparkSession
    make = WordIds(output)
    ids = encoded(docs, output)
    counts = id_counts(ids, make.size)
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    shards = max(1, -(-int(counts.sum()) // output.shard_ids))
    kind = make.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()
        code, shard = Code(lengths), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        before = total = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, before, total, number
            chunk = pack(code, held, output.block_ids, before)
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (number, pa.int64()), (total, pa.int64()), (chunk, pa.binary()))], names=["shard", "number", "n_ids", "chunk"])
            held, before, total, number = [], before + total, 0, number + 1
            return out

        for batch in batches:
            for doc_id, packed in rows(batch, "doc_id", "ids"):
                held.append((doc_id, np.frombuffer(packed, kind)))
                total += len(held[-1][1])
                if total >= output.chunk_ids:
                    yield close()
        if held:
            yield close()

    # rows of one doc_id, or without one, are told apart by a hash, so that they may fill several shards
    sorted_ = ids.where("ids is not null").select("doc_id", F.xxhash64("ids").alias("h"), "ids").repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    sorted_.mapInArrow(run, "shard long, number long, n_ids long, chunk binary").write.option("compression", "none").parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str, each: Callable[[list, np.ndarray, np.ndarray, int], dict], schema: str) -> DataFrame:
    """Apply ``each`` to every chunk's doc_ids, sizes, ids and the ids of all shards and chunks before it."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    chunks = spark.read.schema("shard long, number long, n_ids long, chunk binary").parquet(f"{path}/chunks")
    # one number for each shard, that is for about 8 million ids
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    held = np.zeros(max((r.shard for r in sizes), default=0) + 2, np.int64)
    for r in sizes:
        held[r.shard + 1] = r.n
    starts = spark.sparkContext.broadcast(np.cumsum(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()
        code = Code(lengths)
        for batch in batches:
            for shard, chunk in rows(batch, "shard", "chunk"):
                doc_ids, sizes, ids, inside = unpack(code, chunk)
                yield pa.RecordBatch.from_pydict(each(doc_ids, sizes, ids, int(starts.value[shard]) + inside))

    return chunks.select("shard", "chunk").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids array<int> of every document written under ``path``."""

    def each(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, before: int) -> dict:
        end = np.cumsum(sizes)
        parts = np.split(ids.astype(np.int32), end[:-1])
        return {"doc_id": pa.array(doc_ids, pa.int64()), "start": before + end - sizes, "ids": pa.array(parts, pa.list_(pa.int32()))}

    return read_chunks(spark, path, each, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian u32 of every document under ``path``."""

    def each(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, before: int) -> dict:
        end = np.cumsum(sizes)
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), end.tolist(), strict=True)]
        return {"doc_id": pa.array(doc_ids, pa.int64()), "start": before + end - sizes, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())}

    return read_chunks(spark, path, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_ids(docs: DataFrame, output: Output | None = None) -> DataFrame:
    """Write the ids of ``docs`` in the shared folder and read their digests back."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, output)
    return read_digests(docs.sparkSession, path)
