"""Language identification by hyperdimensional letter-n-gram profiles.

Every letter gets a random vector of +1/-1 (from its code point alone, so all workers
agree). An n-gram's vector binds the letters' vectors, each permuted by its place, by
multiplying them. A text's vector bundles (sums) its n-gram vectors; a language's
prototype bundles those of all its training texts. A document takes the language whose
prototype has the largest cosine with its own vector.

Bundling is linear, so a prototype is the n-gram counts of its language times the n-gram
vectors: the counts are aggregated over the corpus by Spark, by (language, n-gram), and
only then turned into vectors, in blocks of n-grams.

Defined results: ``und`` with score 0 for a null text, a text without letters, and when
there is no training row; in ``identify`` documents with a null id take no part in training
and are not held out; ties go to the language that sorts first; a score below 0 is given as 0; each
input row gives one result row; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen

UNKNOWN = "und"
N = 3
DIMENSIONS = 1024
#: N-gram vectors that a Python worker keeps at once (4 kB each).
KEPT = 12_000
#: N-grams of texts that a Python worker holds beside their sums before it adds them up.
COUNTED = 200_000
BITS = 21  # of a code point


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 (a break) for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter n-grams; runs of other characters are one break."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    x = _letters()[points]
    x = np.concatenate([[0], x, [0]])
    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]  # a break once
    if not x.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(x) - N + 1, np.int64)
    for k in range(N):
        code = (code << BITS) | x[k:len(x) - N + 1 + k]
    return np.unique(code, return_counts=True)


def counted(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all texts' n-grams together, each code once."""
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add_up() -> list[tuple[np.ndarray, np.ndarray]]:
        codes, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, inverse, np.concatenate([h[1] for h in held]))
        return [(codes, n)]

    for text in texts:
        held.append(ngrams(text))
        size += len(held[-1][0])
        if size > COUNTED:
            held, size = add_up(), 0
    return add_up()[0]


@lru_cache(20_000)
def _letter_vector(point: int, place: int, dimensions: int) -> np.ndarray:
    v = np.random.Generator(np.random.PCG64(point)).integers(0, 2, dimensions, np.int8) * 2 - 1
    return np.roll(v, place)


def vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """N-gram vectors, a row for each code."""
    out = np.ones((len(codes), dimensions), np.float32)
    for k in range(N):
        part = (codes >> (BITS * (N - 1 - k))) & ((1 << BITS) - 1)
        points, inverse = np.unique(part, return_inverse=True)
        rows = np.stack([_letter_vector(int(p), N - 1 - k, dimensions) for p in points])
        out *= rows[inverse]
    return out


class _Bundler:
    """Texts' vectors; keeps the vectors of n-grams seen lately, up to KEPT."""

    def __init__(self, dimensions: int):
        self.table = np.zeros((KEPT, dimensions), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted codes and their rows of the table

    def __call__(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.table.shape[1], np.float64)
        for i in range(0, len(codes), KEPT // 2):
            rows = self._rows(codes[i:i + KEPT // 2])
            out += counts[i:i + KEPT // 2].astype(np.float32) @ self.table[rows]
        return out

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            if len(self.codes) + (~known).sum() > KEPT:  # start anew with this text's own
                self._forget()
                known[:] = False
            new, used = codes[~known], len(self.codes)
            self.table[used:used + len(new)] = vectors(new, self.table.shape[1])
            codes_now = np.concatenate([self.codes, new])
            order = np.argsort(codes_now, kind="stable")
            self.codes, self.rows = codes_now[order], np.concatenate([self.rows, np.arange(used, used + len(new))])[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> prototype of unit length, from all rows of ``docs`` with a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang", sort=False)["text"]:
                codes, n = counted(texts)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for i in range(0, len(part), 2048):
                    rows = vectors(part["code"].to_numpy()[i:i + 2048], dimensions).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + part["n"].to_numpy(np.float64)[i:i + 2048] @ rows
        for lang, v in sums.items():  # whole numbers: exact in any order of adding
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dimensions, dtype=np.int32), "x": v.astype(np.int64)})

    labelled = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = (labelled.mapInPandas(count, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    sums = (counts.mapInPandas(bundle, "lang string, dim int, x long")
            .groupBy("lang", "dim").agg(F.sum("x").alias("x")))
    out: dict[str, np.ndarray] = {}
    for r in frozen(sums, "langid").collect():  # languages x dimensions
        out.setdefault(r.lang, np.zeros(dimensions))[r.dim] = r.x
    return {k: v / max(np.linalg.norm(v), 1e-300) for k, v in sorted(out.items())}


def predictor(prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
    """text -> struct<lang, score> as a vectorised function for ``predict``."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, dimensions))

    @F.pandas_udf("lang string, score double")
    def predict_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bundler = _Bundler(dimensions)
        for texts in batches:
            rows = []
            for text in texts:
                codes, counts = ngrams(text)
                v = bundler(codes, counts) if len(codes) and names else None
                size = np.linalg.norm(v) if v is not None else 0
                if not size:
                    rows.append((UNKNOWN, 0.0))
                    continue
                cosine = matrix @ v / size
                k = int(np.argmax(cosine))
                rows.append((names[k], float(min(1.0, max(0.0, cosine[k])))))
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return predict_batch


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
            out_col: str = "prediction") -> DataFrame:
    """``docs`` with ``out_col``: struct of the predicted language and the best cosine, 0 to 1."""
    dimensions = len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS
    return docs.withColumn(out_col, predictor(prototypes, dimensions)(F.col(f"`{text_col}`")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    prototypes = train(training_rows(docs, id_col), text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict(rows, prototypes).select(
        "doc_id", "held_out", F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))


def keep_known(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known with a cosine of at least ``least``.

    Cosines fall with a text's length, so ``least`` is meant to reject only what has no
    letters or is far from every language.
    """
    prototypes = train(docs, text_col, lang_col)  # nothing is held out: no row is left to be tested on
    judged = predict(docs, prototypes, text_col, "__prediction")
    return judged.where((F.col("__prediction.lang") != UNKNOWN) & (F.col("__prediction.score") >= least)).drop("__prediction")
