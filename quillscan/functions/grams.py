"""n-grams of many texts at once, as numbers (vectoriser analyzers, H12-H14).

A text is a row of symbols: its characters, those of its padded words, or its words. The symbols of a
slice of texts are numbered from 1, so that an n-gram is a number to the base of their count and one:
n-grams are made, told apart and counted by numpy, and only different ones become strings. Where a
slice has so many symbols that these numbers don't fit 63 bits, its n-grams are made as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

SLICE_BYTES = 1 << 19


class Grams:
    """An analyzer: ``kind`` char, char_wb or word, n-grams of ``lo`` to ``hi`` symbols; called, the array of them in order."""

    def __init__(self, kind: str, lo: int, hi: int, slice_bytes: int = SLICE_BYTES):
        self.kind, self.lo, self.hi, self.slice_bytes = kind, lo, hi, slice_bytes

    def __call__(self, c: Column) -> Column:
        return {"char": tx.char_ngrams, "char_wb": tx.char_wb_ngrams, "word": tx.word_ngrams}[self.kind](c, self.lo, self.hi)

    def source(self, c: Column) -> Column:
        """The text that the n-grams are made of."""
        return {"char": tx.char_source, "char_wb": tx.char_wb_source, "word": tx.word_source}[self.kind](c)

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(term number, row) of each n-gram of ``texts`` (sources), and the terms by number."""
        ids, segment, row, symbols = (_words if self.kind == "word" else _characters)(texts, self.kind == "char_wb")
        base = len(symbols) + 1
        if base ** self.hi >= 1 << 63:
            return self._strings(texts)
        codes, rows, code = [], [], ids
        for k in range(1, self.hi + 1):
            if k > 1:
                code = code[:-1] * base + ids[k - 1:]
            if not len(code):
                break
            if k >= self.lo:
                whole = segment[:len(code)] == segment[k - 1:]
                codes.append(code[whole])
                rows.append(row[:len(code)][whole])
        none = np.zeros(0, np.int64)
        found = pa.array(np.concatenate([none, *codes])).dictionary_encode()
        digits, rest = [], found.dictionary.to_numpy(zero_copy_only=False).copy()
        for _ in range(self.hi):
            digits.insert(0, rest % base)
            rest //= base
        terms = (_joined if self.kind == "word" else _spelled)(np.stack(digits, 1), symbols)
        return found.indices.to_numpy(zero_copy_only=False), np.concatenate([none, *rows]), terms

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(first row, texts) of slices of about ``slice_bytes``, at least one text each."""
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        start = 0
        while start < len(texts):
            stop = max(int(np.searchsorted(sizes, sizes[start] + self.slice_bytes, side="right")) - 1, start + 1)
            yield start, texts.slice(start, stop - start)
            start = stop

    def _strings(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        pieces = {"char": tx.char_pieces, "char_wb": tx.char_wb_pieces, "word": tx.word_pieces}[self.kind](self.lo, self.hi)
        lists = pa.array([None if t is None else pieces(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        found = pc.list_flatten(lists).dictionary_encode()
        return (found.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary)


def _characters(texts: pa.Array, padded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, segment, row) of each character and the symbols' code points; ``padded``: words between spaces, each a segment."""
    raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = bytes(memoryview(raw.buffers()[2])[at[0]:at[-1]]) if at[-1] > at[0] else b""
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    row = np.repeat(np.arange(len(texts)), np.diff(before[at - at[0]]))
    segment = row
    if padded:
        letter = cp != 32
        start = letter.copy()
        start[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
        word = np.cumsum(start)[letter] - 1
        length = np.bincount(word) + 2 if len(word) else np.zeros(0, np.int64)
        out = np.full(int(length.sum()), 32, np.int64)
        out[np.arange(len(word)) + 2 * word + 1] = cp[letter]
        cp, segment, row = out, np.repeat(np.arange(len(length)), length), np.repeat(row[start], length)
    there = np.zeros(0x110000, bool)
    there[cp] = True
    symbols = np.flatnonzero(there)
    number = np.zeros(0x110000, np.int64)
    number[symbols] = np.arange(1, len(symbols) + 1)
    return number[cp], segment, row, symbols


def _words(texts: pa.Array, _: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    flat = pc.list_flatten(lists)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)       # an empty text is no word
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[some]
    found = flat.filter(pa.array(some)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, row, row, found.dictionary


def _spelled(digits: np.ndarray, symbols: np.ndarray) -> pa.Array:
    used = digits > 0
    cp = symbols[digits[used] - 1] if len(symbols) else np.zeros(0, np.int64)
    size = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(used.sum(1))])]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(digits), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))


def _joined(digits: np.ndarray, symbols: pa.Array) -> pa.Array:
    parts = [symbols.take(pa.array(d - 1, mask=d == 0)) for d in digits.T]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def numbers(term: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, number) of the different pairs, in order."""
    keys = np.sort(row.astype(np.int64) * max(width, 1) + term)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] // max(width, 1), keys[first] % max(width, 1), np.diff(first, append=len(keys))
