"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of three: the normaliser (a space reads as U+2581, and
one stands in front), the pieces (from their characters to their id), and byte fallback
(from a character that is no piece to the ids of its UTF-8 bytes). It is compiled once into
numbered states with arcs by character; a state at which a symbol ends carries the
symbol's ids. Walking its arcs from a place of the input composes it with the input: what
comes out are the arcs of a lattice over the input's places. The encoding is the shortest
path in the tropical semiring.

In a unigram model an arc weighs minus the piece's score. In a BPE model all arcs weigh
nothing but the join of two arcs is restricted: pieces a and b may follow each other only
if merging their text gives back a, b (else the join weighs infinity). That is decided by
going back through the two pieces' own merges, from the latest: the join fails if the two
symbols that then meet would have merged before. A sequence of pieces in which every
neighbouring pair holds is what merging the whole text gives, so exactly one path to each
place has a finite weight, and a depth-first search that tries the longest arc first and
leaves a place for good once its arcs are used up finds it.

Between two characters that are neighbours in no piece the lattice has a cut, above all
before every run of U+2581: its shortest path is put together from those of the parts
between cuts, and each distinct part is solved once and kept.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
Decoding an encoding gives the text back, but for U+2581 in it, which decodes as a space.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Segments whose ids a Python worker keeps.
KEPT = 800_000
#: Segments up to this length are searched side by side, so many at once.
SIDE_BY_SIDE, TOGETHER = 48, 50_000
#: Characters of the texts encoded together.
BLOCK = 1_000_000
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Kept:
    """The ids of texts solved lately: at most KEPT of them, in two halves of which the older goes."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, text: str) -> tuple[int, ...] | None:
        """What ``young`` lacks: looked up in the older half, and taken over from it."""
        ids = self.old.get(text)
        if ids is not None:
            self.put(text, ids)
        return ids

    def take(self, texts: set[str]) -> tuple[dict[str, tuple[int, ...]], set[str]]:
        """(the ids of those ``texts`` that are kept, the other texts)."""
        young, old = self.young, self.old
        missing = texts.difference(young)
        fresh = missing.difference(old)
        here, again = texts - missing, missing - fresh
        moved = dict(zip(again, map(old.__getitem__, again)))
        found = dict(zip(here, map(young.__getitem__, here)))
        found.update(moved)
        self.add(moved)
        return found, fresh

    def add(self, solved: dict[str, tuple[int, ...]]) -> None:
        """Several at once; the young half may outgrow its size by one such call's texts."""
        if len(self.young) + len(solved) > KEPT // 2:
            self.old, self.young = self.young, {}
        self.young.update(solved)

    def put(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= 64:
            if len(self.young) >= KEPT // 2:
                self.old, self.young = self.young, {}
            self.young[text] = ids


class _Table:
    """Numbers to numbers (-1: absent), looked up for whole arrays: open addressing with linear steps."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(4, (4 * len(entries) + 1).bit_length())
        keys = np.fromiter(entries.keys(), np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int64, len(entries))
        self.keys = np.full((1 << self.bits), -1, np.int64)
        self.values = np.full((1 << self.bits), -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several the last stays, the others go on
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class Transducer:
    """Compiled pieces: ``pieces`` maps text to (id, score), ``bytes`` maps a byte to its id."""

    def __init__(self, pieces: list[tuple[str, float, int]], model_type: int, dummy_prefix: bool = True):
        self.type, self.dummy_prefix = model_type, dummy_prefix
        self.pieces = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.text = [p if kind in (NORMAL, USER) else "" for p, _, kind in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.pieces), default=1)
        self.least = min((s for _, s in self.pieces.values()), default=0.0)
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p in self.pieces)
        # neighbours inside some piece, as the input spells them; between any others the lattice has a cut
        spelt = lambda c: (c, " ") if c == SPACE else (c,)
        self.inner = {a + b for p in self.pieces for x, y in zip(p, p[1:]) for a in spelt(x) for b in spelt(y)}
        # the input in segments: a run of spaces with what follows, and each character that is in
        # no piece of several by itself
        joined = "".join(re.escape(c) for c in sorted({c for x in self.inner for c in x} - {" ", SPACE}))
        self.segment = re.compile(f"[ {SPACE}]+[{joined}]*|[{joined}]+|." if joined else ".", re.DOTALL)
        self.joins: dict[int, bool] = {}
        self.kept, self.parts = Kept(), Kept()
        self.together = False
        if model_type == BPE:
            self._compile()

    def _compile(self) -> None:
        """States and arcs, and for each symbol its place in the order of merges and its two halves.

        Symbols are the characters of all pieces, then the pieces that merging their own text gives.
        """
        chars = sorted({c for p in self.pieces for c in p})
        longer = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: -self.pieces[p][1])
        self.symbols = chars + [p for p in longer if self.merged(p) == [p]]
        number = {p: i for i, p in enumerate(self.symbols)}
        self.count = len(self.symbols)
        self.length = [len(p) for p in self.symbols]
        self.output = [tuple(self.ids_of(p)) for p in self.symbols]
        # -1 for characters; pieces of equal score share a rank and are judged by merging, as are
        # pieces that score better than a half of theirs
        at = {s: i for i, s in enumerate(sorted({self.pieces[p][1] for p in longer}, reverse=True))}
        rank = {p: at[self.pieces[p][1]] for p in longer}
        shared = Counter(rank.values())
        self.rank = [-1] * len(chars) + [rank[p] for p in self.symbols[len(chars):]]
        self.halves: list[tuple[int, int]] = [(-1, -1)] * self.count
        self.odd = [False] * self.count
        for p in self.symbols[len(chars):]:
            i = number[p]
            x, y = (number.get(h, -1) for h in self.merged(p, leave=2))
            self.halves[i] = x, y
            self.odd[i] = shared[rank[p]] > 1 or min(x, y) < 0 or max(self.rank[x], self.rank[y]) >= rank[p] or self.odd[x] or self.odd[y]
        #: Two symbols, as one number -> rank of the piece that they make.
        self.unions = {number[p[:i]] * self.count + number[p[i:]]: rank[p]
                       for p in longer for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.unsure = {r for r, n in shared.items() if n > 1}
        self.arcs_from: list[dict[str, int]] = [{}]
        self.symbol_at = [-1]
        for i, p in enumerate(self.symbols):
            state = 0
            for c in p:
                arcs = self.arcs_from[state]
                if c not in arcs:
                    arcs[c] = len(self.arcs_from)
                    if c == SPACE:
                        arcs[" "] = arcs[c]  # the normaliser
                    self.arcs_from.append({})
                    self.symbol_at.append(-1)
                state = arcs[c]
            self.symbol_at[state] = i
        self._arrays(chars)

    def _arrays(self, chars: list[str]) -> None:
        """The same states, arcs and merges as arrays, for many segments at once."""
        spelt = sorted({*chars, " "} if SPACE in chars else chars)
        self.together = self.cuts and SPACE in chars  # then a segment of several characters has letters only
        self.letters = np.zeros(0x110000, np.int32)  # code point -> letter, 0 for what begins no symbol
        for i, c in enumerate(spelt, 1):
            self.letters[ord(c)] = i
        self.alphabet = len(spelt) + 1
        place = {c: i for i, c in enumerate(spelt, 1)}
        self.first = np.full(self.alphabet, -1, np.int32)
        for c, state in self.arcs_from[0].items():
            self.first[place[c]] = state
        self.arc_table = _Table({s * self.alphabet + place[c]: t for s, arcs in enumerate(self.arcs_from) if s for c, t in arcs.items()})
        self.final = np.array(self.symbol_at, np.int32)
        self.lengths = np.array(self.length, np.int32)
        self.ranks, self.left = np.array(self.rank, np.int64), np.array([h[0] for h in self.halves], np.int64)
        self.right, self.odds = np.array([h[1] for h in self.halves], np.int64), np.array(self.odd)
        unsure = max(self.rank, default=0) + 1  # stands for a rank that several pieces share
        self.union_table = _Table({k: unsure if r in self.unsure else r for k, r in self.unions.items()})
        self.unsure_rank = unsure
        # symbols of one id, as all are but characters that are no piece
        self.single = np.array([x[0] if len(x) == 1 else -1 for x in self.output], np.int64)

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``join`` of many pairs at once."""
        holds = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), np.iinfo(np.int64).max)
        judged = []
        while len(at):
            union = self.union_table.get(x * self.count + y)
            odd = self.odds[x] | self.odds[y] | (union == self.unsure_rank)
            if odd.any():
                judged.extend(at[odd].tolist())
            fails = ~odd & (union >= 0) & (union < before)
            holds[at[fails]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            first = rx > ry
            go = ~odd & ~fails & (first | (ry >= 0))
            at, x, y, rx, ry, first = at[go], x[go], y[go], rx[go], ry[go], first[go]
            before = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        for i in judged:
            holds[i] = self.join(int(a[i]), int(b[i]))
        return holds

    def solve_many(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The ids of segments whose characters are all letters of the transducer, searched side by side."""
        letters = self.letters[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")]
        sizes = np.array([len(x) for x in segments])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        limit = np.repeat(ends, sizes)
        # compose: the symbol of each length that starts at each place, and the next shorter one's length
        symbol = np.full((self.longest + 1, len(letters)), -1, np.int32)
        shorter = np.zeros((self.longest + 2, len(letters)), np.int8)
        at, state = np.arange(len(letters)), self.first[letters]
        for n in range(1, self.longest + 1):
            alive = state >= 0
            at, state = at[alive], state[alive]
            symbol[n, at] = self.final[state]
            shorter[n + 1] = np.where(symbol[n] >= 0, n, shorter[n])
            on = at + n < limit[at]
            at, state = at[on], state[on]
            state = self.arc_table.get(state * np.int64(self.alphabet) + letters[at + n])
        untried = shorter[self.longest + 1].copy()
        last = np.full(len(letters) + 1, -1, np.int32)  # the symbol that ends before a place
        word, place = np.arange(len(segments)), starts.copy()
        while len(word):
            size = untried[place]
            back = size == 0
            if back.any():  # nothing leads on from these places
                came = last[place[back]]
                if (place[back] == starts[word[back]]).any():
                    raise ValueError("no path")
                place[back] -= self.lengths[came]
            on = ~back
            w, p, n = word[on], place[on], size[on].astype(np.int64)
            s = symbol[n, p]
            untried[p] = shorter[n, p]
            inside = p > starts[w]
            holds = np.ones(len(w), bool)
            holds[inside] = self._joins(last[p[inside]], s[inside])
            last[p[holds] + n[holds]] = s[holds]
            p[holds] += n[holds]
            place[on] = p
            more = place < ends[word]
            word, place = word[more], place[more]
        # the paths, from their ends
        found, where = [], []
        word, place = np.arange(len(segments)), ends.copy()
        while len(word):
            s = last[place]
            place = place - self.lengths[s]
            found.append(s)
            where.append(place)
            more = place > starts[word]
            word, place = word[more], place[more]
        where, found = np.concatenate(where), np.concatenate(found)
        order = np.argsort(where)
        where, found = where[order], found[order]
        cut = np.searchsorted(where, ends).tolist()
        single = self.single[found]
        ids = single.tolist()
        out = [tuple(ids[i:j]) for i, j in zip([0, *cut], cut)]
        for k in np.unique(np.searchsorted(cut, np.flatnonzero(single < 0), "right")).tolist():  # symbols of several ids
            out[k] = tuple(x for s in found[cut[k - 1] if k else 0:cut[k]].tolist() for x in self.output[s])
        return out

    @classmethod
    def load(cls, path: str) -> "Transducer":
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, norm.add_dummy_prefix)

    def merged(self, text: str, cut: int = 0, leave: int = 1) -> list[str] | None:
        """``text`` by merging: the neighbours whose union scores best, the first of equals, until none is a piece.

        None as soon as a merge crosses the place ``cut``, if that is not 0. Stops at ``leave`` parts.
        """
        score = lambda x: self.pieces[x][1] if x in self.pieces else -math.inf
        parts = list(text)
        scores = [score(a + b) for a, b in zip(parts, parts[1:])]
        ends = list(range(1, len(parts) + 1))
        while scores and len(parts) > leave:
            best = max(scores)
            if best == -math.inf:
                break
            i = scores.index(best)
            if ends[i] == cut:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i], ends[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i])
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1])
        return parts

    def join(self, a: int, b: int) -> bool:
        """Whether symbol ``b`` may follow symbol ``a``."""
        key = a * self.count + b
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > KEPT:
                self.joins.clear()
            known = self.joins[key] = self._meet(a, b)
        return known

    def _meet(self, left: int, right: int) -> bool:
        a, b, before = left, right, math.inf
        while True:
            union = self.unions.get(a * self.count + b)
            if self.odd[a] or self.odd[b] or union in self.unsure:
                x, y = self.symbols[left], self.symbols[right]
                return self.merged(x + y, len(x)) == [x, y]
            if union is not None and union < before:
                return False  # these two would have merged before one of them grew
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.halves[a][1]
            elif self.rank[b] >= 0:
                before, b = self.rank[b] + 1, self.halves[b][0]  # of equal merges the first goes first
            else:
                return True

    def arcs(self, text: str, end: int) -> Iterator[tuple[int, str, float]]:
        """(start, piece, weight) of the unigram arcs that end at a place, longest piece first."""
        for start in range(max(0, end - self.longest), end):
            got = self.pieces.get(text[start:end])
            if got:
                yield start, text[start:end], -got[1]
        if text[end - 1:end] not in self.pieces:
            yield end - 1, text[end - 1:end], UNKNOWN_PENALTY - self.least

    def path_ids(self, text: str) -> list[int]:
        """The ids on the shortest path through the lattice of a part between cuts."""
        if self.type != BPE:
            return [x for p in self.shortest(text.replace(" ", SPACE)) for x in self.ids_of(p)]
        if text[0] not in self.arcs_from[0]:
            return self.ids_of(text)  # byte fallback: a character of no piece is a part of its own
        return [x for s in self._merging(text) for x in self.output[s]]

    def shortest(self, text: str) -> list[str]:
        """The pieces on the lightest path through the lattice of ``text`` in a unigram model."""
        last, out, end = self._lightest(text), [], len(text)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _merging(self, text: str) -> list[int]:
        """The symbols on the one path of finite weight."""
        arcs_from, symbol_at, length, join = self.arcs_from, self.symbol_at, self.length, self.join
        untried: list[list[int] | None] = [None] * len(text)
        path: list[int] = []
        place, before = 0, -1
        while place < len(text):
            left = untried[place]
            if left is None:  # compose: the arcs from here, the longest last
                left = untried[place] = []
                state = 0
                for at in range(place, len(text)):
                    state = arcs_from[state].get(text[at])
                    if state is None:
                        break
                    if symbol_at[state] >= 0:
                        left.append(symbol_at[state])
            while left:
                s = left.pop()
                if before < 0 or join(before, s):
                    path.append(s)
                    place, before = place + length[s], s
                    break
            else:  # nothing leads on from this place
                if not path:
                    raise ValueError("no path")
                place -= length[path.pop()]
                before = path[-1] if path else -1
        return path

    def _lightest(self, text: str) -> list[str]:
        """The last piece of the lightest path to each place."""
        best, last = [0.0] + [math.inf] * len(text), [""] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start, piece, weight in self.arcs(text, end):
                if best[start] + weight < best[end]:
                    best[end], last[end] = best[start] + weight, piece
        return last

    def ids_of(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got:
            return [got[0]]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def _solve(self, segment: str) -> tuple[int, ...]:
        """The ids of a segment: those of its parts between cuts, each solved once."""
        inner = self.inner
        at = [i for i, x in enumerate(map(str.__add__, segment, segment[1:]), 1) if x not in inner]
        if not at:
            return tuple(self.path_ids(segment))
        out: list[int] = []
        for i, j in zip([0] + at, at + [len(segment)]):
            part = segment[i:j]
            ids = self.parts.young.get(part) or self.parts.get(part)
            if ids is None:
                ids = tuple(self.path_ids(part))
                self.parts.put(part, ids)
            out.extend(ids)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of texts; what is new in them is solved together, a long segment by itself."""
        split = self.segment.findall if self.cuts else lambda x: [x]
        prefix = " " * self.dummy_prefix
        segments = [split(prefix + x) if x else [] for x in texts]
        known, fresh = self.kept.take(set(chain.from_iterable(segments)))
        most = SIDE_BY_SIDE if self.together else 0
        alone = [x for x in fresh if not 1 < len(x) <= most]
        solved = dict(zip(alone, map(self._solve, alone)))
        self.kept.add({x: ids for x, ids in solved.items() if len(x) <= 64})
        known.update(solved)
        fresh = [x for x in fresh if 1 < len(x) <= most]
        for i in range(0, len(fresh), TOGETHER):
            part = fresh[i:i + TOGETHER]
            solved = dict(zip(part, self.solve_many(part)))
            self.kept.add(solved)
            known.update(solved)
        return [list(chain.from_iterable(map(known.__getitem__, x))) for x in segments]

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        if self.byte_of.keys().isdisjoint(ids) and self.unknown not in ids:
            out, ids = list(map(self.text.__getitem__, ids)), []
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(" ⁇ " if i == self.unknown else self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@contextmanager
def no_collection() -> Iterator[None]:
    """The cycle collector at rest: coding makes many small tuples and strings, and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(2)
def transducer(path: str) -> Transducer:
    """Compiled once in each Python worker; the collector need not look at its tables again."""
    got = Transducer.load(path)
    gc.freeze()
    return got


def encoder(path: str):
    """Column function: text -> array<int> of ids, by the model file at ``path`` on the workers."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        out: list[np.ndarray] = []
        block: list[str | None] = []
        size = 0
        for i, x in enumerate(texts, 1):
            block.append(x)
            size += len(x or "")
            if size >= BLOCK or i == len(texts):
                out.extend(np.array(y, np.int32) for y in t.encode_many(block))
                block, size = [], 0
        return pd.Series(out, dtype=object)
    return encode


def decoder(path: str):
    """Column function: array<int> of ids -> text; a null array gives an empty text."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series(["" if x is None else t.decode(x.tolist()) for x in ids], dtype=object)
    return decode


def encode_table(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) of every row."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       encoder(model)(F.col(f"`{text_col}`")).alias("ids"))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts that begin with the text in which a next BLOCK of characters ends."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def encode_checked(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row: its ids, their number, and whether they decode to the text.

    One pass: a block of texts is encoded and decoded before the next is looked at, so a
    worker holds the ids of one block only. U+2581 in a text reads as a space.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            for part in _blocks(batch):
                texts = part.column("text").to_pylist()
                with no_collection():
                    ids = t.encode_many(texts)
                    same = [t.decode(x) == (text or "").replace(SPACE, " ") for x, text in zip(ids, texts)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes), pa.array(same)], names=schema.names)

    return rows.mapInArrow(check, schema)


def round_trip(ids: Column, text: Column, model: str) -> Column:
    """Whether the ids decode to the text, U+2581 read as a space."""
    return decoder(model)(ids) == F.translate(F.coalesce(text, F.lit("")), SPACE, " ")
