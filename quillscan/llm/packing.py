"""Packing of token streams into windows by an order-preserving dynamic programme.

A task takes its documents in the order they arrive, as one token stream, and chooses
where windows end. Cuts fall on document ends (free), sentence ends (a penalty each) or,
inside a sentence longer than a window, at the token where the window is full (a larger
penalty). A window costs the padding up to the window size, or a small fixed sum
when its length is a smaller power of two, plus the penalty of its cut. The cheapest cuts follow from
``best[j] = min over i of best[i] + size - (pos[j] - pos[i]) + penalty[j]`` with
``pos[j] - pos[i] <= size``: the minimum of ``best[i] + pos[i]`` over a sliding window,
kept in a monotone queue; powers of two are looked up one by one. Streams are solved in
blocks of bounded length, so memory does not grow with the partition, and no row moves
between tasks.

Defined results: a null text counts as empty; an empty text has one piece, of its final
token; repeated rows and null ids are packed like any other row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Tokens of a stream that are solved at once.
STREAM = 1 << 18
#: What a cut costs, in tokens of padding.
SENTENCE_CUT, FORCED_CUT = 1, 64
#: What a window shorter than full costs where its length, a power of two, needs no padding.
SHORT = 16
#: Powers of two, from half the window down, that a short window may have where its cut is not free.
HALVINGS = 4
#: Words whose ids a Python worker keeps (and those of one round of texts), and texts it handles at once.
KEPT, CHUNK = 600_000, 256
#: Sequence ids are this many apart from task to task.
TASK_IDS = 1 << 33


_SENTENCE_END = (b".", b"!", b"?", "…".encode(), "。".encode())
# punctuation that ends a word; after a letter or digit the vocabulary parts it there anyway
_TAIL = b".,!?;:%*#$&"
_LETTER = re.compile(rb"[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]").fullmatch
# small Latin letters, which no normaliser or parting changes
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable byte stands for itself, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Numbers(dict):
    """Words numbered as they come; ``new`` holds those not learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokenizer:
    """Token ids by a lower-casing vocabulary file whose words never span white space.

    The ids of a text are then those of its words in order, so each distinct word is
    encoded once and kept. Text is split at ASCII white space only; whatever else the
    vocabulary takes as white space stays inside a word and is left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.at = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.count, self.ends = np.zeros(KEPT, np.int32), np.zeros(KEPT, np.int32), np.zeros(KEPT, bool)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.at)
        if n > len(self.start):
            grow = lambda x: np.concatenate([x, np.zeros(n - len(x), x.dtype)])
            self.start, self.count, self.ends = grow(self.start), grow(self.count), grow(self.ends)
        parts = []
        for w in words:
            core = w.rstrip(_TAIL)
            cut = len(core) < len(w) and (_LETTER(core[-1:]) or _LETTER(core[-2:])) and b"<|" not in w
            parts.append((core, w[len(core):]) if cut else (w,))
        known: dict[bytes, list[int]] = {}
        tokenize, rest = self.tokenizer.model.tokenize, []
        for piece in set(chain.from_iterable(parts)):
            # one piece for the vocabulary, too; most need no pattern
            if piece.isalpha() and piece.islower() or _PLAIN(piece):
                known[piece] = [t.id for t in tokenize(piece.decode("latin-1").translate(self.letters))]
            else:
                rest.append(piece)
        texts = [w.decode("utf-8", "surrogatepass") for w in rest]
        known |= zip(rest, (e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)))
        got = [known[p[0]] if len(p) == 1 else known[p[0]] + known[p[1]] for p in parts]
        count = np.fromiter(map(len, got), np.int64, len(got))
        new = np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(new)), np.uint32)])
        self.ids[self.used:self.used + len(new)] = new
        i = n - len(words)
        self.start[i:n], self.count[i:n] = self.used + np.cumsum(count) - count, count
        self.ends[i:n] = [w.rstrip(b"\"')]").endswith(_SENTENCE_END) for w in words]
        self.used += len(new)

    @classmethod
    @lru_cache(1)
    def shared(cls, path: str) -> "WordTokenizer":
        """One in each Python worker: its words are kept from task to task."""
        return cls(path)

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return raw.split() if b"<|" in raw else raw.lower().split()  # ASCII letters only

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and the numbers of ids before each sentence end in it."""
        if len(self.at) > KEPT:
            self._forget()
        split = [self.words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        w = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        if self.at.new:
            self._learn(self.at.new)
            self.at.new = []
        count = self.count[w]
        after = np.cumsum(count, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[w] - after + count, count) + np.arange(int(after[-1]) if len(w) else 0)]
        after = np.concatenate([[0], after])
        ends, out, i = self.ends[w], [], 0
        for words in split:
            j = i + len(words)
            out.append((ids[after[i]:after[j]], after[i + 1:j + 1][ends[i:j]] - after[i]))
            i = j
        return out


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indexes into ``pos`` (0 first, the end last) of the cheapest window ends.

    No two neighbours of ``pos`` are more than ``window`` apart. A window may be short, with
    the length of a power of two: any at a free cut, else one of the largest ``HALVINGS``.
    """
    p, pen = pos.tolist(), penalty.tolist()
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    halves = powers[-HALVINGS:]
    at = {x: i for i, x in enumerate(p)}
    best, back = [0] * len(p), [0] * len(p)
    keys: deque = deque([(0, 0, 0)])  # (best + position, position, index), rising
    for j in range(1, len(p)):
        x = p[j]
        while x - keys[0][1] > window:
            keys.popleft()
        cost, _, i = keys[0]
        cost += window - x
        for k in powers if not pen[j] else halves:
            i2 = at.get(x - k)
            if i2 is not None and best[i2] + SHORT < cost:
                cost, i = best[i2] + SHORT, i2
        cost += pen[j]
        best[j], back[j] = cost, i
        key = cost + x
        while keys and keys[-1][0] >= key:
            keys.pop()
        keys.append((key, x, j))
    out, j = [], len(p) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def stops(ends: np.ndarray, sentences: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stream, and what each place costs.

    ``ends`` are document ends, ``sentences`` sentence ends; a longer stretch without any
    gets a place after each full window. The last document end closes the stream.
    """
    pos = np.unique(np.concatenate([[0], ends, sentences]))
    pen = np.where(np.isin(pos, ends), 0, SENTENCE_CUT)
    gaps = np.diff(pos)
    wide = np.nonzero(gaps > window)[0]
    if len(wide):
        more = np.concatenate([np.arange(pos[i] + window, pos[i + 1], window) for i in wide])
        pos, pen = np.concatenate([pos, more]), np.concatenate([pen, np.full(len(more), FORCED_CUT)])
        order = np.argsort(pos, kind="stable")
        pos, pen = pos[order], pen[order]
    # the tail may close at powers of two, which need no padding
    tail = np.array([int(ends[-1]) - k for k in (1 << np.arange(window.bit_length() - 1)) if k < ends[-1]], np.int64)
    tail = tail[~np.isin(tail, pos)]
    pos, pen = np.concatenate([pos, tail]), np.concatenate([pen, np.full(len(tail), FORCED_CUT)])
    order = np.argsort(pos, kind="stable")
    return pos[order], pen[order]


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, stream: int = STREAM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary file on the workers. A document's ids are
    those of its text and then ``end_id``. ``ids`` holds a piece's ids as little-endian
    unsigned 32-bit numbers.
    """

    def flush(held: list, sequence: int) -> tuple[pd.DataFrame, int]:
        sizes = np.array([len(h[1]) + 1 for h in held], np.int64)
        ends = np.cumsum(sizes)
        flat = np.full(int(ends[-1]), end_id, "<u4")
        for h, e, n in zip(held, ends.tolist(), sizes.tolist()):
            flat[e - n:e - 1] = h[1]
        raw = flat.tobytes()
        sentences = np.concatenate([h[2] + e - n for h, e, n in zip(held, ends, sizes)])
        pos, pen = stops(ends, sentences, window)
        cuts = pos[choose_cuts(pos, pen, window)]
        marks = np.union1d(cuts, ends)  # a piece ends at each
        begins = np.concatenate([[0], marks[:-1]])
        doc, seq = np.searchsorted(ends, begins, "right"), np.searchsorted(cuts, begins, "right")
        opened = np.concatenate([[0], cuts])[seq]
        start = begins - (ends - sizes)[doc]
        length = marks - begins
        ids = [raw[4 * b:4 * m] for b, m in zip(begins.tolist(), marks.tolist())]
        return pd.DataFrame({
            "doc_id": pd.Series([held[d][0] for d in doc.tolist()], dtype=object), "start": start, "length": length,
            "ids": ids, "doc_tokens": sizes[doc], "sequence_id": sequence + seq, "offset": begins - opened}), sequence + len(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = WordTokenizer.shared(tokenizer)
        sequence = TaskContext.get().partitionId() * TASK_IDS
        held, tokens = [], 0
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                part = pdf.iloc[i:i + CHUNK]
                for doc_id, (ids, sentences) in zip(part["doc_id"], encode(part["text"].tolist())):
                    held.append((None if pd.isna(doc_id) else doc_id, ids, sentences))
                    tokens += len(ids) + 1
                if tokens >= stream:
                    out, sequence = flush(held, sequence)
                    yield out
                    held, tokens = [], 0
        if held:
            out, sequence = flush(held, sequence)
            yield out

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, {SCHEMA}")
