"""Token counts by a compiled tokenizer.

A byte-level BPE tokenizer cuts a text into pieces by a pattern and each piece into tokens by its merges. Both are
compiled into deterministic transducers:

* ``TRANSITIONS`` is the pattern as a machine over character classes; a transition names the cuts that it settles.
  The classes of all code points come from the library itself, so its Unicode version holds. A text is cut into
  chunks; a chunk's map says for every state in which it may begin the state in which it ends. Maps compose
  associatively: a parallel prefix scan over the chunks of all texts at hand gives each chunk's true first state, and
  so all cuts.
* ``Merges`` is the merges as a machine over the bytes of a piece, whose transitions say by how much the number of
  tokens changes. After a prefix of a piece the last token of its encoding is known, and a longer prefix ends in the
  longest token whose pair with the last token before it is left alone by the merges. So a state holds, for each place
  at which a later token may begin, the part of that token which was read, the last token before the place, and the
  tokens up to it. States are numbered as they are met and transitions are kept in a hash table, all pieces of some
  texts advancing together, a byte at a time. The table is cleared once it is full, as in lazily built automata.

Rows: a null text counts as empty and has no tokens. Rows with the same doc_id are counted one by one. Extra columns
are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.text import map_groups
from kindred.llm.tokenids import byte_letters

LETTER, NUMBER, OTHER, SPACE, WHITE = "letter", "number", "other", "space", "white"
#: Fixed by the pattern: what may follow an apostrophe that begins a piece.
ONE, TWO = "stmd", {"r": "e", "v": "e", "l": "l"}


def machine() -> dict[tuple[str, str], tuple[str, tuple[int, ...]]]:
    """(state, class) to next state and the cuts that are settled: so many characters before the present one."""
    letters = (LETTER, *"stmdrvle")
    base = {c: LETTER for c in letters} | {NUMBER: NUMBER, OTHER: OTHER, "'": OTHER}
    begin = base | {"'": "quote", SPACE: "space1", WHITE: "white1"}
    out: dict[tuple[str, str], tuple[str, tuple[int, ...]]] = {}

    def rule(state: str, kinds: dict[str, str], cuts: tuple[int, ...]) -> None:
        for c, to in kinds.items():
            out.setdefault((state, c), (to, cuts))

    rule("begin", begin, ())
    for c in letters:
        out[LETTER, c] = (LETTER, ())
    out[NUMBER, NUMBER] = (NUMBER, ())
    out[OTHER, OTHER] = out[OTHER, "'"] = (OTHER, ())
    for state in (LETTER, NUMBER, OTHER, "done"):
        rule(state, begin, (0,))
    for c in ONE:
        out["quote", c] = ("done", ())
    for c in TWO:
        out["quote", c] = (f"quote {c}", ())
    out["quote", OTHER] = out["quote", "'"] = (OTHER, ())
    rule("quote", begin, (0,))
    for c, d in TWO.items():
        out[f"quote {c}", d] = ("done", ())
        for k in letters:
            out.setdefault((f"quote {c}", k), (LETTER, (1,)))
        rule(f"quote {c}", begin, (1, 0))
    for n in ("1", "2"):
        early = (1,) if n == "2" else ()
        for state in ("space", "white"):
            rule(state + n, {SPACE: "space2", WHITE: "white2"}, ())
        rule("space" + n, base, early)
        rule("white" + n, begin, (*early, 0))
    return out


TRANSITIONS = machine()


@functools.cache
def unicode_classes(tokenizer: str) -> tuple[np.ndarray, list[str]]:
    """Where the class of code points changes, and the classes, as the library's splitter has them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
    kinds = np.full(0x110000, OTHER, dtype=object)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 1 << 15):
        some = points[at : at + (1 << 15)]
        # x?7 tells letters and numbers: they stay with one neighbour; x?! tells others from white space
        for mark, test in (("7", {(0, 2): LETTER, (1, 3): NUMBER}), ("!", {(1, 2): WHITE})):
            for _, (a, b) in split("".join(f"x{chr(p)}{mark}\n" for p in some)):
                found = test.get((a % 4, a % 4 + b - a))
                if found and (found != WHITE or kinds[some[a // 4]] == OTHER):
                    kinds[some[a // 4]] = found
    kinds[0x20] = SPACE
    change = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    return change, kinds[change].tolist()


@dataclass(frozen=True)
class Counting:
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    special: str = "<|endoftext|>"
    limit: int = 512
    #: Characters of a chunk, and pieces that advance together.
    chunk: int = 128
    pieces: int = 1 << 17
    #: So few pieces advance one by one.
    few: int = 48
    #: Transitions of the merges' machine that a Python worker keeps.
    memo: int = 400_000


class Cutter:
    """The pattern's machine in tables."""

    def __init__(self, classes: tuple[np.ndarray, list[str]], chunk: int) -> None:
        self.chunk = chunk
        names = [LETTER, NUMBER, OTHER, SPACE, WHITE, *"'stmdrvle"]
        states = ["begin", *sorted({to for to, _ in TRANSITIONS.values()} - {"begin"})]
        self.n_states, self.pad = len(states), len(names)
        width = len(names) + 1
        self.width = width
        self.next = np.zeros((len(states), width), np.uint8)
        #: Bit 0: a cut before the present character, bit 1: one before the character before it.
        self.cuts = np.zeros((len(states), width), np.uint8)
        for (state, c), (to, back) in TRANSITIONS.items():
            at = states.index(state), names.index(c)
            self.next[at] = states.index(to)
            self.cuts[at] = sum(1 << k for k in back)
        self.next[:, self.pad] = np.arange(len(states))
        self.open = np.array([s.startswith("quote ") for s in states])
        change, kinds = classes
        self.kinds = np.repeat(np.array([names.index(k) for k in kinds], np.uint8), np.diff([*change, 0x110000]))
        for c in "'stmdrvle":
            self.kinds[ord(c)] = names.index(c)

    def maps(self, kinds: np.ndarray) -> np.ndarray:
        """The last state of each chunk (a row of classes) for each first state."""
        ends = np.broadcast_to(np.arange(self.n_states, dtype=np.uint16), (len(kinds), self.n_states))
        flat = self.next.ravel().astype(np.uint16)
        for c in range(kinds.shape[1]):
            ends = flat[ends * np.uint16(self.width) + kinds[:, c, None]]
        return ends

    @staticmethod
    def scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Compositions of the maps from each chunk's ``first`` one up to itself, in log2 parallel steps."""
        maps, step, at = maps.copy(), 1, np.arange(len(maps))
        while len(later := np.flatnonzero(at - step >= first)):
            maps[later] = np.take_along_axis(maps[later], maps[later - step].astype(np.intp), axis=1)
            step *= 2
        return maps

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pieces begin in texts that end at ``ends`` (ascending, none empty) of a row of code points."""
        sizes = np.diff(ends, prepend=0)
        chunks = -(-sizes // self.chunk)
        last = np.cumsum(chunks)
        first = np.repeat(last - chunks, chunks)
        at = np.repeat(ends - sizes, chunks) + (np.arange(last[-1]) - first) * self.chunk
        kinds = np.full((len(at), self.chunk), self.pad, np.uint8)
        place = np.arange(self.chunk)
        inside = place < np.minimum(self.chunk, np.repeat(ends, chunks) - at)[:, None]
        kinds[inside] = self.kinds[points]
        done = self.scan(self.maps(kinds), first)
        state = np.where(np.arange(len(at)) == first, 0, np.roll(done[:, 0], 1)).astype(np.uint16)
        flat = self.next.ravel().astype(np.uint16)
        cuts = np.empty_like(kinds)
        flags = self.cuts.ravel()
        for c in range(self.chunk):
            key = state * np.uint16(self.width) + kinds[:, c]
            cuts[:, c] = flags[key]
            state = flat[key]
        cut = cuts[inside]
        out = cut & 1
        out[:-1] |= cut[1:] >> 1
        out[ends - sizes] = 1
        open_ = self.open[state[last - 1]]
        out[ends[open_] - 1] = 1
        return np.flatnonzero(out)


#: Odd multiplier of the hash table; no state.
SPREAD, NONE = np.uint64(0x9E3779B97F4A7C15), -1


class Merges:
    """The merges' machine, built as far as the pieces need it."""

    def __init__(self, tokenizer: str, memo: int) -> None:
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)["model"]
        bytes_of = {c: b for b, c in byte_letters().items()}
        vocab = {bytes(bytes_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in bytes_of for c in token)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (bytes(bytes_of[c] for c in part) for part in (a, b))
            self.rank.setdefault((vocab[x], vocab[y]), (n, vocab[x + y]))
        self.bytes = {i: t for t, i in vocab.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.child: dict[int, int] = {}
        self.token: list[int] = [NONE]
        self.inner: list[bool] = [False]
        for t, i in vocab.items():
            if self.merged(t) == [i]:  # others are never the result of merges
                self._add(t, i)
        self.memo = memo
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def _add(self, token: bytes, i: int) -> None:
        node = 0
        for b in token:
            self.inner[node] = True
            to = self.child.get(node << 8 | b)
            if to is None:
                to = self.child[node << 8 | b] = len(self.token)
                self.token.append(NONE)
                self.inner.append(False)
            node = to
        self.token[node] = i

    def merged(self, text: bytes) -> list[int]:
        """The tokens of a short text: always the first merge of the list that applies."""
        held = [self.single[b] for b in text]
        while len(held) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(held, held[1:]))))
            if best[0] == 1 << 60:
                break
            held[best[2] : best[2] + 2] = [best[1]]
        return held

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``b`` after token ``a`` as it is."""
        if a == NONE:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            found = (a, b) not in self.rank and self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
            if len(self.pairs) >= 4 * self.memo:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.number(((0, NONE, 0),))
        self.used, self.bits = 0, 16
        self._room()

    def _room(self) -> None:
        self.keys, self.values = np.full(1 << self.bits, NONE, np.int64), np.zeros(1 << self.bits, np.int64)

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def compiled(self, state: int, byte: int) -> int:
        """The transition: next state and change of the number of tokens, in one number."""
        last, tokens, going = NONE, 0, []
        for node, before, n in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if last == NONE and token != NONE and self.apart(before, token):
                last, tokens = token, n + 1
            if self.inner[node]:
                going.append((node, before, n))
        return self.number((*((node, before, n - tokens) for node, before, n in going), (0, last, 0))) << 8 | tokens + 128

    def store(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            held = self.keys != NONE
            more = self.keys[held], self.values[held]
            while 2 * (self.used + len(keys)) > 1 << self.bits:
                self.bits += 1
            self._room()
            self.used = 0
            self.store(*more)
        at, mask = self.slot(keys), (1 << self.bits) - 1
        self.used += len(keys)
        while len(keys):
            free = self.keys[at] == NONE
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], at[~done] + 1 & mask

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The transitions of many states."""
        keys = state << 8 | byte
        at, mask = self.slot(keys), (1 << self.bits) - 1
        found, out = self.keys[at], self.values[at]
        left = np.flatnonzero(found != keys)
        while len(left):
            empty = found[left] == NONE
            if empty.any():
                new = np.unique(keys[left[empty]])
                self.store(new, np.array([self.compiled(k >> 8, k & 255) for k in new.tolist()], np.int64))
                mask = (1 << self.bits) - 1
                at[left] = self.slot(keys[left])
            else:
                at[left] = at[left] + 1 & mask
            found[left], out[left] = self.keys[at[left]], self.values[at[left]]
            left = left[found[left] != keys[left]]
        return out

    def alone(self, piece: bytes, state: int) -> int:
        """Tokens that a piece, or what is left of one, adds from a state on, byte by byte."""
        total, held = 0, {}
        for b in piece:
            v = held.get(state << 8 | b)
            if v is None:
                if len(self.states) > 2 * self.memo:  # a piece that is very long meets new states all the way
                    here = self.states[state]
                    self.clear()
                    held.clear()
                    state = self.number(here)
                v = held[state << 8 | b] = self.compiled(state, b)
            state = v >> 8
            total += (v & 255) - 128
        return total

    def counts(self, text: bytes, starts: np.ndarray, ends: np.ndarray, few: int) -> np.ndarray:
        """Tokens of each piece, all of which advance together."""
        if self.used > self.memo or len(self.states) > self.memo:
            self.clear()
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        data = np.frombuffer(text, np.uint8)
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        open_ = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="left").tolist()  # pieces longer than so many bytes
        for j in range(int(sizes[0])):
            k = open_[j]
            if k <= few:
                held = [self.states[n] for n in state[:k].tolist()]  # numbers change when the machine is cleared
                for i in range(k):
                    total[i] += self.alone(text[starts[i] + j : starts[i] + sizes[i]], self.number(held[i]))
                break
            v = self.step(state[:k], data[starts[:k] + j].astype(np.int64))
            state[:k] = v >> 8
            total[:k] += (v & 255) - 128
        out = np.empty_like(total)
        out[order] = total
        return out


class Transducer:
    def __init__(self, counting: Counting, classes: tuple[np.ndarray, list[str]]) -> None:
        self.counting = counting
        self.cutter, self.merges = Cutter(classes, counting.chunk), Merges(counting.tokenizer, counting.memo)
        self.special = counting.special.encode()

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; the special string is one token and parts its text."""
        parts = [t.split(self.special) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        total = np.bincount(owner, minlength=len(texts)) - 1
        flat = [part.decode("utf-8", "replace") for p in parts for part in p]
        some = [i for i, part in enumerate(flat) if part]
        if not some:
            return total.tolist()
        whole = "".join(flat)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(flat[i]) for i in some])
        starts = self.cutter.starts(points, ends)
        data = whole.encode()
        if len(data) > len(points):
            offsets = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        else:
            offsets = np.arange(len(points) + 1)
        mine = owner[some][np.searchsorted(ends, starts, side="right")]
        begin = offsets[starts]
        end = np.append(begin[1:], len(data))
        for at in range(0, len(starts), self.counting.pieces):
            piece = slice(at, at + self.counting.pieces)
            n = self.merges.counts(data, begin[piece], end[piece], self.counting.few)
            total += np.bincount(mine[piece], n, minlength=len(texts)).astype(np.int64)
        return total.tolist()


_made: dict[Counting, Transducer] = {}


def transducer(counting: Counting, classes: tuple[np.ndarray, list[str]]) -> Transducer:
    """The Python worker's own transducer, kept from task to task with what it has compiled."""
    if counting not in _made:
        _made.clear()
        _made[counting] = Transducer(counting, classes)
    return _made[counting]


def token_counts(docs: DataFrame, counting: Counting | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id long, text string); no shuffle."""
    counting = counting or Counting()
    classes = unicode_classes(counting.tokenizer)

    def work(group: list[tuple]) -> dict:
        counts = transducer(counting, classes).count([t or b"" for _, t in group])
        return {
            "doc_id": pa.array([i for i, _ in group], pa.int64()),
            "n_bytes": pa.array([len(t or b"") for _, t in group], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array([n > counting.limit for n in counts]),
        }

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return map_groups(docs, ["doc_id", "text"], work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
