"""Text splitting and normalising as Column expressions (operators H1-H14, G3).

Everything here is built-in Spark expressions (regex, array and higher-order
functions) and runs in the JVM; functions with a lambda fall back from generated code
to interpreted evaluation. Unicode NFC has no built-in and is an Arrow-batched pandas UDF;
n-grams are made in Arrow batches, as a lambda's step for each of them takes microseconds.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------
# whitespace (Python str.split / str.strip semantics)
# ----------------------------------------------------------------------------

def py_strip(c: ColumnOrName) -> Column:
    """``str.strip()``: remove leading/trailing whitespace of every kind."""
    return F.btrim(_c(c), F.lit(K.PY_WS_CHARS))


def ws_to_space(c: ColumnOrName) -> Column:
    """Every whitespace character -> one space (same length; a per-character map)."""
    return F.translate(_c(c), K.PY_WS_CHARS, " " * len(K.PY_WS_CHARS))


def collapse_whitespace(c: ColumnOrName) -> Column:
    """Whitespace runs -> one space."""
    return F.regexp_replace(_c(c), f"{K.PY_WS}+", " ")


def normalize_newlines(c: ColumnOrName) -> Column:
    """CRLF and CR -> LF."""
    return F.replace(F.replace(_c(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def words(c: ColumnOrName) -> Column:
    """H6 ``str.split()``: maximal runs of non-whitespace."""
    return F.regexp_extract_all(ws_to_space(c), F.lit("[^ ]+"), 0)


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated words (BIGINT), 0 for empty text."""
    return F.coalesce(F.regexp_count(ws_to_space(c), F.lit("[^ ]+")), F.lit(0)).cast("bigint")


def whitespace_count(c: ColumnOrName) -> Column:
    return (F.length(_c(c)) - F.length(F.replace(ws_to_space(c), F.lit(" "), F.lit("")))).cast("bigint")


# ----------------------------------------------------------------------------
# sentence splitters
# ----------------------------------------------------------------------------

def _split_strip(c: Column, pattern: str) -> Column:
    return F.transform(F.split(c, pattern), py_strip)


def split_screening(c: ColumnOrName, min_chars: int = K.MIN_SENTENCE_CHARS,
                    long_chars: int = K.LONG_SENTENCE_CHARS,
                    chunk: int = K.CHUNK_CHARS, chunk_lone_long: bool = True) -> Column:
    """H1 + H2: screening sentences of an essay, as an array.

    CRLF/CR -> LF, split on runs of ``. ! ? danda LF``, strip, keep >= 4 chars;
    a lone sentence over 200 chars is cut into 120-char chunks (H2).
    """
    kept = F.filter(_split_strip(normalize_newlines(c), K.SCREEN_SPLIT),
                    lambda s: F.length(s) >= min_chars)
    if not chunk_lone_long:
        return kept
    # evaluate the split once: the chunk rule reads it up to four times
    return bind(kept, lambda k: chunk_long(k, long_chars, chunk))


def chunk_long(sentences: Column, long_chars: int = K.LONG_SENTENCE_CHARS,
               chunk: int = K.CHUNK_CHARS) -> Column:
    """H2: if exactly one sentence and it is longer than ``long_chars``, cut it."""
    first = F.element_at(sentences, 1)
    n_chunks = F.ceil(F.length(first) / F.lit(chunk)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1),
                         lambda i: F.substring(first, i * chunk + 1, F.lit(chunk)))
    return F.when((F.size(sentences) == 1) & (F.length(first) > long_chars), chunks) \
        .otherwise(sentences)


def split_basic(c: ColumnOrName) -> Column:
    """H3: split on single ``. ! ?``, keep non-empty stripped pieces."""
    return F.filter(_split_strip(_c(c), K.BASIC_SPLIT), lambda s: s != "")


def split_pattern(c: ColumnOrName) -> Column:
    """H4: split on runs of ``. LF danda`` (``!``/``?`` do not split), non-empty strip."""
    return F.filter(_split_strip(_c(c), K.PATTERN_SPLIT), lambda s: s != "")


def split_lines(c: ColumnOrName) -> Column:
    """H5: LF-separated lines, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(_c(c), "\n"), py_strip), lambda s: s != "")


# ----------------------------------------------------------------------------
# Unicode: NFC, graphemes, repetition
# ----------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (no Spark built-in); Arrow-batched."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else x)


def graphemes(c: ColumnOrName) -> Column:
    """H8: extended grapheme clusters (Java regex ``\\X``)."""
    return F.regexp_extract_all(_c(c), F.lit(r"\X"), 0)


def sinhala_graphemes(g: ColumnOrName) -> Column:
    """H9: the clusters of a grapheme array with at least one Sinhala code point.

    Most are told by their first character; the pattern is for longer clusters of other letters."""
    def sinhala(x: Column) -> Column:
        return F.when((x >= F.lit("\u0d80")) & (x < F.lit("\u0e00")), F.lit(True)) \
            .otherwise((F.octet_length(x) > 1) & x.rlike(K.SINHALA))
    return F.filter(_c(g), sinhala)


def stabilize_repetition(c: ColumnOrName) -> Column:
    """Runs of 3+ equal grapheme clusters become exactly 2.

    The cluster array is bound once as a lambda variable, so the look-back reads
    an array instead of re-segmenting the text for every element."""
    def keep(g: Column) -> Column:
        return F.array_join(
            F.filter(g, lambda x, i: ~((i >= 2) & (x == F.get(g, i - 1)) & (x == F.get(g, i - 2)))), "")
    return bind(graphemes(c), keep)


def proxy_reference(c: ColumnOrName) -> Column:
    """H7 (but NFC) then H10 (the input must not come from a Python UDF; see ``with_proxy``)."""
    return stabilize_repetition(collapse_whitespace(py_strip(_c(c))))


def with_proxy(df, in_col: str, out_col: str = "proxy_reference"):
    """H11 on a DataFrame: NFC (Arrow UDF) in one projection, then strip, collapse and
    the grapheme-run rule as built-in expressions in the next. The generator of one row keeps
    the lambda of that rule out of what is selected next: it may be a Python function's input."""
    tmp = df.withColumn("_nfc", nfc(F.col(in_col)))
    return tmp.select(*df.columns, F.explode_outer(F.array(proxy_reference("_nfc"))).alias(out_col))


def adjacent_equal(arr: ColumnOrName) -> Column:
    """Count of positions i >= 1 with ``arr[i] == arr[i-1]`` (BIGINT)."""
    return bind(_c(arr), lambda a: F.size(F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1))))) \
        .cast("bigint")


# ----------------------------------------------------------------------------
# n-grams (vectoriser analyzers)
# ----------------------------------------------------------------------------

def analyzer_preprocess(c: ColumnOrName) -> Column:
    """Vectoriser preprocessing: lowercase, runs of 2+ whitespace -> one space."""
    return F.regexp_replace(F.lower(_c(c)), f"{K.PY_WS}{K.PY_WS}+", " ")


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable (lambda bodies
    otherwise re-evaluate a captured expression for every array element)."""
    return F.transform(F.array(value), fn)[0]


GRAM_ROWS = 500


def _gram_lists(pieces):
    """Arrow function: each text's n-grams in order, ``pieces`` of it, a few texts at a time; null stays null."""
    rows = GRAM_ROWS

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def grams(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return pa.concat_arrays([pa.array([None if t is None else pieces(t) for t in texts.slice(at, rows).to_pylist()], kind)
                                 for at in range(0, max(len(texts), 1), rows)])
    return grams


def char_pieces(lo: int, hi: int):
    return lambda t: [t[i:i + k] for k in range(lo, min(hi, len(t)) + 1) for i in range(len(t) - k + 1)]


def char_source(c: ColumnOrName) -> Column:
    return F.coalesce(analyzer_preprocess(c), F.lit(""))


def char_ngrams(c: ColumnOrName, lo: int, hi: int) -> Column:
    """Character n-grams (analyzer ``char``) for n in [lo, hi]; none for a null text."""
    return _gram_lists(char_pieces(lo, hi))(char_source(c))


def char_wb_pieces(lo: int, hi: int):
    return lambda t: [w[i:i + k] for w in [f" {w} " for w in t.split(" ") if w]
                      for k in range(lo, min(hi, len(w)) + 1) for i in range(len(w) - k + 1)]


def char_wb_source(c: ColumnOrName) -> Column:
    return ws_to_space(analyzer_preprocess(c))


def char_wb_ngrams(c: ColumnOrName, lo: int, hi: int) -> Column:
    """N-grams inside space-padded words (analyzer ``char_wb``)."""
    return _gram_lists(char_wb_pieces(lo, hi))(char_wb_source(c))


WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_pieces(lo: int, hi: int):
    def pieces(t):
        tokens = t.split(" ") if t else []       # no token holds a space
        return [" ".join(tokens[i:i + k]) for k in range(lo, hi + 1) for i in range(len(tokens) - k + 1)]
    return pieces


def word_source(c: ColumnOrName) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_TOKEN), 0), " ")


def word_ngrams(c: ColumnOrName, lo: int = 1, hi: int = 2) -> Column:
    """Word uni/bigrams of tokens matching ``\\w\\w+`` (analyzer ``word``)."""
    return _gram_lists(word_pieces(lo, hi))(word_source(c))
