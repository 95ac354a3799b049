"""TF-IDF (operators D22, D23, B14, F4, C7, I1-I4, I6).

A document is a row ``(doc_id, counts)`` with ``counts`` an array of its distinct terms
and their numbers, made in Arrow batches inside the task that holds the document and not
stored. The vocabulary is an aggregate over terms, summed for each Arrow batch first, capped
(``max_features``) by a top-k. ``term_sums``, ``found_grams`` and ``text_summary`` do the same from
texts, with n-grams as numbers (``functions.grams``), and are what the queries use. ``weighted`` explodes the counts and joins the vocabulary,
its common terms by broadcast; a document's terms are folded again in one aggregate, whose
partial step leaves one row for each document and task.

Formulas follow the usual vectoriser defaults: smooth idf ``ln((1+N)/(1+df)) + 1``,
optional sublinear tf ``1 + ln(tf)``, L2-normalised rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams as gr
from . import windows as win


#: Terms that most documents' rows meet: the vocabulary's first by document frequency are broadcast
#: (about 20 MB), rows of other terms are shuffled.
COMMON_TERMS = 1 << 17

_COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


@F.arrow_udf(_COUNTED)
def term_counts(grams: pa.Array) -> pa.Array:
    """array<struct<term, tf>> of an n-gram array: the distinct terms with their numbers, none for null."""
    terms, n = pc.list_flatten(grams).dictionary_encode(), len(grams)
    width = max(len(terms.dictionary), 1)
    at, tf = np.unique(pc.list_parent_indices(grams).to_numpy(zero_copy_only=False).astype(np.int64) * width
                       + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(at // width, minlength=n))])
    pairs = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(at % width)), pa.array(tf, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


_SUMMED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("tf", T.LongType())]))


@F.arrow_udf(_SUMMED)
def batch_counts(grams: pa.Array) -> pa.Array:
    """array<struct<term, df, tf>> of n-gram arrays: the sums over a whole Arrow batch, all in its first row.

    A term is one row a batch to what aggregates it, not one a document that holds it.
    """
    terms, n = pc.list_flatten(grams).dictionary_encode(), len(grams)
    width = len(terms.dictionary)
    ids = terms.indices.to_numpy(zero_copy_only=False)
    each = np.unique(pc.list_parent_indices(grams).to_numpy(zero_copy_only=False).astype(np.int64) * max(width, 1) + ids)
    df, tf = np.bincount(each % max(width, 1), minlength=width)[:width], np.bincount(ids, minlength=width)
    sums = pa.StructArray.from_arrays([terms.dictionary, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["term", "df", "tf"])
    return pa.ListArray.from_arrays(pa.array([0] + [width] * n, pa.int32()), sums)


_FOUND = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("w", T.DoubleType())]))


def found_terms(table: pa.Table):
    """Arrow function of n-gram arrays: array<struct<index, w>>, their terms in ``table`` (term, index ascending, idf).

    ``w`` is sublinear tf times idf, before normalising; none for null.
    """
    terms = table["term"].combine_chunks()
    index, idf = (table[c].to_numpy() for c in ("index", "idf"))
    width = max(len(terms), 1)

    @F.arrow_udf(_FOUND)
    def found(grams: pa.Array) -> pa.Array:
        at = pc.index_in(pc.list_flatten(grams), value_set=terms)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        pairs, tf = np.unique(pc.list_parent_indices(grams).to_numpy(zero_copy_only=False)[known].astype(np.int64) * width + at, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=len(grams)))])
        at = pairs % width
        entries = pa.StructArray.from_arrays([pa.array(index[at], pa.int32()), pa.array((1.0 + np.log(tf)) * idf[at], pa.float64())], ["index", "w"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return found


@F.arrow_udf(T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
def unit_rows(entries: pa.Array) -> pa.Array:
    """struct<indices, values> of entries (index, w): ascending, with L2 norm 1."""
    flat, row = pc.list_flatten(entries), pc.list_parent_indices(entries).to_numpy(zero_copy_only=False).astype(np.int64)
    index, w = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("index", "w"))
    order = np.lexsort((w, index, row))
    row, index, w = row[order], index[order], w[order]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(entries)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(entries)))]), pa.int32())
    parts = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((index, pa.int32()), (w / norm[row], pa.float64()))]
    return pa.StructArray.from_arrays(parts, ["indices", "values"])


def fit_vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """D22 + B14 + F4: ``(term, df, total_tf, idf, index)``; index in term order."""
    return _vocabulary(counts, counts.select(F.explode("counts").alias("e")).select("e.term", F.lit(1).alias("df"), "e.tf"), min_df, max_features)


def fit_gram_vocabulary(docs: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """The same vocabulary from documents with their n-gram arrays as ``grams``, summed for each Arrow batch first."""
    return _vocabulary(docs, docs.select(F.explode(batch_counts(F.col("grams"))).alias("e")).select("e.*"), min_df, max_features)


#: Rows of terms that a worker sums up before it adds them to those it holds, and that it holds at most.
HELD_TERMS = 1 << 20


def term_sums(docs: DataFrame, text: Column, grams: gr.Grams, flag: Column | None = None) -> DataFrame:
    """(term, df, tf, flagged): sums over the documents of a task; ``flagged``: documents with the term that ``flag`` holds for."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.Table:
            total = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([(c, "sum") for c in ("df", "tf", "flagged")])
            return total.select(["term", "df_sum", "tf_sum", "flagged_sum"]).rename_columns(["term", "df", "tf", "flagged"])

        for batch in batches:
            flags = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for at, texts in grams.slices(batch.column(0)):
                term, row, terms = grams.counted(texts)
                its_row, its_term, _ = gr.numbers(term, row, len(terms))
                df, tf = (np.bincount(x, minlength=len(terms)) for x in (its_term, term))
                flagged = np.bincount(its_term[flags[at + its_row]], minlength=len(terms))
                held.append(pa.table({"term": terms, "df": pa.array(df, pa.int64()), "tf": pa.array(tf, pa.int64()), "flagged": pa.array(flagged, pa.int64())}))
                size += len(terms)
                if size > 2 * HELD_TERMS:
                    held = [added()]
                    size = len(held[0])
                    if size > HELD_TERMS:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, size = [], 0
        if held:
            yield from added().to_batches(max_chunksize=50_000)

    return docs.select(grams.source(text).alias("text"), (F.lit(False) if flag is None else flag).alias("flag")) \
        .mapInArrow(sums, "term string, df long, tf long, flagged long")


def fit_text_vocabulary(docs: DataFrame, text: Column, grams: gr.Grams, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """The same vocabulary from documents with a text, summed by each task first."""
    return _vocabulary(docs, term_sums(docs, text, grams), min_df, max_features)


def found_grams(table: pa.Table, grams: gr.Grams):
    """Arrow function of texts (the analyzer's sources): what ``found_terms`` gives for their n-grams."""
    terms = table["term"].combine_chunks()
    index, idf = (table[c].to_numpy() for c in ("index", "idf"))

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.struct([("index", pa.int32()), ("w", pa.float64())])))]
        for _, part in grams.slices(texts):
            row, at, tf = _known(grams, part, terms)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
            entries = pa.StructArray.from_arrays([pa.array(index[at], pa.int32()), pa.array((1.0 + np.log(tf)) * idf[at], pa.float64())], ["index", "w"])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries))
        return pa.concat_arrays(out)

    return found


def _known(grams: gr.Grams, texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``terms``, number) of the texts' n-grams that are in ``terms``, in order."""
    term, row, own = grams.counted(texts)
    place = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
    return gr.numbers(place[place >= 0], row[place >= 0], len(terms))


_PARTS = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("s", "m", "q")]])


def text_summary(docs: DataFrame, text: Column, grams: gr.Grams, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """``doc_summary`` of documents (doc_id and a text): terms, sum, maximum and squares of a document's weights come from its task.

    The vocabulary's common terms go to the tasks; n-grams that are none of them are shuffled, if it has more.
    """
    table = vocab.orderBy(F.desc("df"), "term").limit(COMMON_TERMS).select("term", "idf").toArrow()  # bounded
    terms, idf = table["term"].combine_chunks(), table["idf"].to_numpy()

    @F.arrow_udf(_PARTS)
    def parts(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.struct([("n", pa.int64()), *[(c, pa.float64()) for c in "smq"]]))]
        for _, part in grams.slices(texts):
            row, at, tf = _known(grams, part, terms)
            w = ((1.0 + np.log(tf)) if sublinear else tf) * idf[at]
            n = np.bincount(row, minlength=len(part))
            most = np.zeros(len(part))
            if len(row):
                most[n > 0] = np.maximum.reduceat(w, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])))
            sums = [np.bincount(row, weights=x, minlength=len(part)) for x in (w, w * w)]
            out.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), *[pa.array(x, pa.float64()) for x in (sums[0], most, sums[1])]], ["n", "s", "m", "q"]))
        return pa.concat_arrays(out)

    @F.arrow_udf(_COUNTED)
    def others(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))]
        for _, part in grams.slices(texts):
            term, row, own = grams.counted(part)
            rare = pc.is_null(pc.index_in(own, value_set=terms)).to_numpy(zero_copy_only=False)[term]
            row, at, tf = gr.numbers(term[rare], row[rare], len(own))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([own.take(pa.array(at)), pa.array(tf, pa.int64())], ["term", "tf"])))
        return pa.concat_arrays(out)

    source = grams.source(text)
    per = docs.select("doc_id", parts(source).alias("p")).select("doc_id", "p.*").where("n > 0")
    if len(table) == COMMON_TERMS:
        rest = vocab.join(F.broadcast(vocab.orderBy(F.desc("df"), "term").limit(COMMON_TERMS).select("term")), "term", "left_anti")
        rare = docs.select("doc_id", F.explode(others(source)).alias("e")).select("doc_id", "e.*").join(rest.select("term", "idf"), "term")
        w = ((F.lit(1.0) + F.log("tf")) if sublinear else F.col("tf").cast("double")) * F.col("idf")
        per = per.unionByName(rare.select("doc_id", F.lit(1).cast("bigint").alias("n"), w.alias("s"), w.alias("m"), (w * w).alias("q")))
    per = per.groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.sum("s").alias("_sum"), F.max("m").alias("_max"), F.sqrt(F.sum("q")).alias("_norm"))
    over = lambda c: F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).otherwise(F.lit(0.0))
    return per.select("doc_id", "n_terms", over("_sum").alias("sum_tfidf"), over("_max").alias("max_tfidf"))


def _vocabulary(docs: DataFrame, sums: DataFrame, min_df: int, max_features: int | None) -> DataFrame:
    stats = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total_tf")).where(F.col("df") >= min_df)
    if max_features is not None:
        stats = stats.orderBy(F.desc("total_tf"), F.asc("term")).limit(max_features)
    n = F.lit(float(docs.count()))
    stats = stats.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    return win.consecutive_index(stats, ["term"], out="index")


def weighted(counts: DataFrame, vocab: DataFrame, sublinear: bool = True, max_features: int | None = None) -> DataFrame:
    """``(doc_id, index, w)``, the weights before normalising.

    A document's common terms meet the broadcast part of the vocabulary where they are; only
    those of a vocabulary larger than that (``max_features``, null: any) are shuffled.
    """
    e = counts.select("doc_id", F.explode("counts").alias("e")).select("doc_id", "e.term", "e.tf")
    vocab = vocab.select("term", "index", "idf", "df")
    if max_features is not None and max_features <= COMMON_TERMS:
        found = e.join(F.broadcast(vocab), "term")
    else:
        common = F.broadcast(vocab.orderBy(F.desc("df"), "term").limit(COMMON_TERMS))
        rest = vocab.join(common.select("term"), "term", "left_anti")
        found = e.join(common, "term").unionByName(e.join(F.broadcast(common.select("term")), "term", "left_anti").join(rest, "term"))
    tf = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    return found.select("doc_id", "index", (tf * F.col("idf")).alias("w"))


def doc_summary(counts: DataFrame, vocab: DataFrame, sublinear: bool = True, max_features: int | None = None) -> DataFrame:
    """Per-document digest of the L2-normalised TF-IDF rows: terms, sum and max weight."""
    per = weighted(counts, vocab, sublinear, max_features).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("w").alias("_sum"), F.max("w").alias("_max"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    over = lambda c: F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).otherwise(F.lit(0.0))
    return per.select("doc_id", "n_terms", over("_sum").alias("sum_tfidf"), over("_max").alias("max_tfidf"))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per-feature mean and population std (zero std -> 1)."""
    return df.agg(*[x for c in cols for x in (
        F.avg(c).alias(f"{c}__mean"),
        F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"{c}__std"))])
