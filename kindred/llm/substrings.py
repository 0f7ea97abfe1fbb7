"""Substring dedup: repeated windows of words, found in an FM-index per shard.

A shard is not a set of documents, which every other document would have to visit, but of all places where the
text around a window has the same anchor: the least hash among the window's runs of four words. Equal windows have
equal anchors, so they meet in one shard. Neighbouring windows with one anchor form a segment of at most 22 words.

1. Anchors. Each group of documents sends every anchor once to the anchor's bucket, which answers those that
   another document has too; anchors that two documents of the group share are known to be live at once.
2. Segments. Documents with live anchors send those segments, each distinct one once a group with the smallest
   doc_id that has it there, to the shard of the anchor.
3. Each shard builds an FM-index over its distinct segments, streams them through it for matching statistics, and
   answers for each window the smallest doc_id of the rows that match at least the window's length.
4. The answers go back to the group, from there to the documents, and words covered by a window with a smaller
   doc_id go.

What a common passage sends to one place is one segment a group, not one a document.

Rows: null and empty texts have no words. Rows with the same doc_id don't remove from each other. A row without
doc_id loses nothing and takes nothing. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.fmindex import FMIndex
from kindred.llm.text import U64, groups, map_groups, mix, removed, rows, windows, word_hashes, written

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Repeats:
    window: int = 13
    #: Words of an anchor.
    anchor: int = 4
    #: Bytes of text whose anchors, and whose live segments, one bucket or shard is expected to get.
    bucket_bytes: int = 16 << 20
    group_bytes: int = 4 << 20


def runs(hashes: np.ndarray, docs: np.ndarray, spec: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents, the segments: first window, number of windows, anchor."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    n = len(hashes) - spec.window + 1
    if n <= 0:
        return empty
    least = windows(hashes, spec.anchor)
    wide, span = 1, spec.window - spec.anchor + 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    at = np.flatnonzero(docs[:n] == docs[spec.window - 1 :])
    if not len(at):
        return empty
    held = least[at]
    new = np.concatenate([[True], (held[1:] != held[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % span == 0)
    return at[first], np.diff(np.append(first, len(at))), held[first]


def read_group(group: list[tuple], spec: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each word's document, each document's first word, and the doc_ids of (key, text, doc_id, ...) tuples."""
    words = [word_hashes((g[1] or b"").split()) for g in group]
    sizes = np.array([len(w) for w in words])
    ids = np.array([NO_ID if g[2] is None else g[2] for g in group], np.int64)
    return np.concatenate(words), np.repeat(np.arange(len(group)), sizes), np.cumsum(sizes) - sizes, ids


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    if not len(values):
        return []
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def blobs(parts: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Bytes of the columns for each bucket."""
    order = np.argsort(bucket, kind="stable")
    for a, b in spans(bucket[order]):
        some = order[a:b]
        yield int(bucket[some[0]]), {k: v[some].tobytes() for k, v in parts.items()}


def by_key(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for key, cols in blobs({"v": values}, keys):
        yield key, cols["v"]


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def anchors(docs: DataFrame, spec: Repeats, buckets: int) -> DataFrame:
    """Rows to buckets (bucket, anchor, key, doc_id, start, live) and known live starts (own, key, start)."""

    def work(group: list[tuple]) -> dict:
        hashes, doc, first, ids = read_group(group, spec)
        start, _, anchor = runs(hashes, doc, spec)
        owner = doc[start] if len(start) else np.empty(0, np.int64)
        keys = np.array([g[0] for g in group], np.int64)
        order = np.lexsort((ids[owner], anchor))
        start, anchor, owner = start[order], anchor[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
        size = np.diff(np.append(new, len(anchor)))
        live = ids[owner[new]] != ids[owner[new + size - 1]]
        all_live = np.repeat(live, size)
        at = (start - first[owner]).astype(np.uint32)
        send = ~all_live
        send[new] = True
        out = {k: [] for k in ("bucket", "anchor", "key", "doc_id", "start", "live", "own")}
        parts = {"anchor": (anchor >> U64(32)).astype(np.uint32), "key": keys[owner], "doc_id": ids[owner], "start": at, "live": all_live.astype(np.uint8)}
        for bucket, cols in blobs({k: v[send] for k, v in parts.items()}, (anchor[send] % U64(buckets)).astype(np.int64)):
            for k, v in (cols | {"bucket": bucket, "own": None}).items():
                out[k].append(v)
        for own, cols in blobs({"key": keys[owner[all_live]], "start": at[all_live]}, keys[owner[all_live]] % buckets):
            for k, v in (dict.fromkeys(("bucket", "anchor", "doc_id", "live")) | cols | {"own": own}).items():
                out[k].append(v)
        kinds = {"bucket": pa.int64(), "own": pa.int64()}
        return {k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()}

    schema = "bucket long, anchor binary, key binary, doc_id binary, start binary, live binary, own long"
    return map_groups(docs, ["key", "text", "doc_id"], work, schema, spec.group_bytes)


def live_starts(sent: DataFrame, buckets: int) -> DataFrame:
    """key, starts: for each document, the segments whose anchor another document has as well."""

    def meet(table: pa.Table) -> pa.Table:
        anchor, key, doc_id, start, live = (joined(table[c], k) for c, k in (("anchor", np.uint32), ("key", np.int64), ("doc_id", np.int64), ("start", np.uint32), ("live", np.uint8)))
        order = np.lexsort((doc_id, anchor))
        anchor, doc_id, live = anchor[order], doc_id[order], live[order]
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(new, len(anchor)))
        good = (doc_id[new] != doc_id[new + size - 1]) | np.maximum.reduceat(live, new).astype(bool)
        some = order[np.repeat(good, size) & (live == 0)]
        found = list(blobs({"key": key[some], "start": start[some]}, key[some] % buckets))
        return pa.table({"own": pa.array([k for k, _ in found], pa.int64())} | {c: pa.array([v[c] for _, v in found], pa.binary()) for c in ("key", "start")})

    def part(table: pa.Table) -> pa.Table:
        found = list(by_key(joined(table["key"], np.int64), joined(table["start"], np.uint32)))
        return pa.table({"key": pa.array([k for k, _ in found], pa.int64()), "starts": pa.array([s for _, s in found], pa.binary())})

    asked = sent.where("bucket is not null").select("bucket", "anchor", "key", "doc_id", "start", "live")
    found = asked.groupBy("bucket").applyInArrow(meet, "own long, key binary, start binary").union(sent.where("bucket is null").select("own", "key", "start"))
    return found.groupBy("own").applyInArrow(part, "key long, starts binary")


def segments(docs: DataFrame, spec: Repeats, shards: int) -> DataFrame:
    """Segments to shards (shard, gid, ...), and for each group where its segments are (shard null, gid, ...)."""

    def work(group: list[tuple]) -> dict:
        hashes, doc, first, ids = read_group(group, spec)
        start, count, anchor = runs(hashes, doc, spec)
        owner = doc[start] if len(start) else np.empty(0, np.int64)
        wanted = [np.unique(np.frombuffer(g[3], np.uint32)) for g in group]
        code = np.concatenate([w.astype(np.int64) + (d << 32) for d, w in enumerate(wanted)])
        good = np.isin((start - first[owner]) + (owner << 32), code)
        start, count, anchor, owner = start[good], count[good], anchor[good], owner[good]
        gid = uuid.uuid4().int >> 65
        full = windows(hashes, spec.window)
        content = mix(full[start] + mix(full[start + count - 1] + count.astype(U64))) if len(start) else np.empty(0, U64)
        _, one, at, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        least = np.full(len(one), NO_ID)
        np.minimum.at(least, at, ids[owner])
        out = {k: [] for k in ("shard", "gid", "number", "content", "count", "least", "many", "words", "key", "doc_id", "start")}
        size = count[one] + spec.window - 1
        shard = (anchor[one] % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        number, size = np.arange(len(one))[order], size[order]
        spot = np.repeat(start[one][order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        words, ends = hashes[spot], np.cumsum(size)
        for a, b in spans(shard[order]):
            some = order[a:b]
            out["shard"].append(int(shard[some[0]]))
            out["words"].append(words[ends[a] - size[a] : ends[b - 1]].tobytes())
            for k, v in (("number", number[a:b].astype(np.uint32)), ("content", content[one[some]]), ("count", count[one[some]].astype(np.uint8)), ("least", least[some]), ("many", (times[some] > 1).astype(np.uint8))):
                out[k].append(v.tobytes())
            for k in ("key", "doc_id", "start"):
                out[k].append(None)
        keys = np.array([g[0] for g in group], np.int64)
        for k, v in (("number", at.astype(np.uint32)), ("key", keys[owner]), ("doc_id", ids[owner]), ("start", (start - first[owner]).astype(np.uint32))):
            out[k].append(v.tobytes())
        for k in ("shard", "content", "count", "least", "many", "words"):
            out[k].append(None)
        out["gid"] = [gid] * len(out["shard"])
        return {k: pa.array(v, pa.int64() if k in ("shard", "gid") else pa.binary()) for k, v in out.items()}

    schema = "shard long, gid long, number binary, content binary, count binary, least binary, many binary, words binary, key binary, doc_id binary, start binary"
    return map_groups(docs, ["key", "text", "doc_id", "starts"], work, schema, spec.group_bytes)


def answers(sent: DataFrame, spec: Repeats) -> DataFrame:
    """gid, number, count, least: for each window of a segment the smallest doc_id that has it."""

    def search(table: pa.Table) -> pa.Table:
        content, count, least, many, words = (joined(table[c], k) for c, k in (("content", U64), ("count", np.uint8), ("least", np.int64), ("many", np.uint8), ("words", U64)))
        _, one, at = np.unique(content, return_index=True, return_inverse=True)
        owner = np.full(len(one), NO_ID)
        np.minimum.at(owner, at, least)
        size = count.astype(np.int64) + spec.window - 1
        begin = np.cumsum(size) - size
        own = size[one]
        words = words[np.repeat(begin[one] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        index = FMIndex(words, own, owner)
        length, row = index.matching(words, own)
        n = own - spec.window + 1
        spot = np.repeat((np.cumsum(own) - own) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        assert (length[spot] >= spec.window).all()
        starts, owners = index.least_owner(spec.window)
        found = owners[np.searchsorted(starts, row[spot], side="right") - 1]
        low = np.minimum.reduceat(found, np.cumsum(n) - n)
        useful = (many == 1) | (low[at] < least)
        out = {"gid": [], "number": [], "count": [], "least": []}
        offset, done = np.cumsum(n) - n, 0
        for gid, numbers in zip(table["gid"].to_pylist(), table["number"].to_pylist(), strict=True):
            number = np.frombuffer(numbers, np.uint32)
            mine = np.flatnonzero(useful[done : done + len(number)])
            which = at[done + mine]
            done += len(number)
            if len(mine):
                m = n[which]
                out["gid"].append(gid)
                out["number"].append(number[mine].tobytes())
                out["count"].append(m.astype(np.uint8).tobytes())
                out["least"].append(found[np.repeat(offset[which] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "gid" else pa.binary()) for k, v in out.items()})

    asked = sent.where("shard is not null").select("shard", "gid", "number", "content", "count", "least", "many", "words")
    return asked.groupBy("shard").applyInArrow(search, "gid long, number binary, count binary, least binary")


def removed_windows(sent: DataFrame, found: DataFrame) -> DataFrame:
    """key, owner, start: the doc_id of a key, and first words of the windows that a document with a smaller doc_id has."""
    places = sent.where("shard is null").select("gid", F.col("number").alias("at"), "key", "doc_id", "start")
    per_group = found.groupBy("gid").agg(F.collect_list(F.struct("number", "count", "least")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, key, doc_id, start, answers_ in rows(batch, "at", "key", "doc_id", "start", "found"):
                at, key, doc_id, start = (np.frombuffer(x, k) for x, k in ((at, np.uint32), (key, np.int64), (doc_id, np.int64), (start, np.uint32)))
                number, count, least = (np.frombuffer(b"".join(a[c] for a in answers_), k) for c, k in (("number", np.uint32), ("count", np.uint8), ("least", np.int64)))
                size = np.zeros(int(at.max()) + 1, np.int64)
                first = np.zeros(len(size), np.int64)
                size[number] = count
                first[number] = np.cumsum(count.astype(np.int64)) - count
                n = size[at]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                gone = least[np.repeat(first[at], n) + inside] < np.repeat(np.where(doc_id == NO_ID, np.iinfo(np.int64).min, doc_id), n)
                values = (np.repeat(start, n) + inside.astype(np.uint32))[gone]
                pairs = list(by_key(np.repeat(key, n)[gone], values))
                owner = dict(zip(key.tolist(), doc_id.tolist(), strict=True))
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in pairs], pa.int64()), "owner": pa.array([owner[k] for k, _ in pairs], pa.int64()), "start": pa.array([v for _, v in pairs], pa.binary())})

    return places.join(per_group, "gid").mapInArrow(run, "key long, owner long, start binary")


def marked(docs: DataFrame, spec: Repeats | None = None) -> DataFrame:
    """key, doc_id, text and the first words of the repeated windows, as packed u32, of every row."""
    spec = spec or Repeats()
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / spec.bucket_bytes))
    asked = written(anchors(docs, spec, buckets), "anchors")
    starts = written(live_starts(asked, buckets), "starts")
    removed(asked)
    sent = written(segments(docs.join(starts, "key"), spec, buckets), "segments")
    found = written(answers(sent, spec), "answers")
    # a key is a hash: of all documents, two may share one, but not with the doc_id
    gone = written(removed_windows(sent, found), "windows").groupBy("key", "owner").agg(F.collect_list("start").alias("gone"))
    return docs.join(gone, (docs.key == gone.key) & (docs.doc_id == gone.owner), "left").select(docs.key, "doc_id", "text", "gone")


def kept_words(text: bytes | None, gone: list[bytes] | None, window: int) -> tuple[list[bytes], int]:
    """The words that stay and the number of those that go."""
    words = (text or b"").split()
    if not gone:
        return words, 0
    start = np.unique(np.frombuffer(b"".join(gone), np.uint32)).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def without_repeats(docs: DataFrame, spec: Repeats | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, and the words that stay, joined by one space."""
    spec = spec or Repeats()

    def work(group: list[tuple]) -> dict:
        kept = [kept_words(t, gone, spec.window) for _, t, gone in group]
        return {
            "doc_id": pa.array([g[0] for g in group], pa.int64()),
            "n_words": pa.array([len(w) + n for w, n in kept], pa.int64()),
            "n_removed": pa.array([n for _, n in kept], pa.int64()),
            "text": pa.array([b" ".join(w) for w, _ in kept], pa.binary()).cast(pa.string()),
        }

    return map_groups(marked(docs, spec), ["doc_id", "text", "gone"], work, "doc_id long, n_words long, n_removed long, text string")
