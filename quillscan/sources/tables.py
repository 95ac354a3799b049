"""Input tables and the derived test views (operators A1, A2 and the fixtures).

The driver tables carry no Sinhala text, so the ``essays`` view transliterates one
code point to one code point (``translate(lower(text), SRC, DST)``); the same
function exists in DuckDB, which the SQL oracle uses.  ``pairs`` derives a paired
clean/dyslexic corpus from essay sentences by a fixed rule keyed on ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# ----------------------------------------------------------------------------
# Transliteration of the test data (36 letters -> Sinhala)
# ----------------------------------------------------------------------------
TRANSLIT_SRC = "abcdefghijklmnoprstuvwyzéèêçäöüßóáíñ"
TRANSLIT_DST = "".join(chr(c) for c in [
    0x0DCF, 0x0DB6, 0x0DA0, 0x0DAF, 0x0DD9, 0x0DC6, 0x0D9C, 0x0DCA, 0x0DD2, 0x0DA2,
    0x0D9A, 0x0DBD, 0x0DB8, 0x0DB1, 0x0DDC, 0x0DB4, 0x0DBB, 0x0DC3, 0x0DAD, 0x0DD4,
    0x0DC0, 0x0DC1, 0x0DBA, 0x0DC5, 0x0DDA, 0x0DD3, 0x0DD6, 0x0D9B, 0x0DD0, 0x0DDD,
    0x0D8B, 0x0DC2, 0x0D94, 0x0D85, 0x0D89, 0x0DAB])

# Pair rule: phonetic confusions used to derive dyslexic sentences.
PHONETIC_SRC = "".join(chr(c) for c in [0x0D9A, 0x0D9C, 0x0DA0, 0x0DAD, 0x0DB6, 0x0DC0, 0x0DC3])
PHONETIC_DST = "".join(chr(c) for c in [0x0D9B, 0x0D9D, 0x0DA1, 0x0DAE, 0x0DB8, 0x0DC2, 0x0DC4])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

ESSAYS_SCHEMA = T.StructType([T.StructField("essay_id", T.LongType()),
                              T.StructField("text", T.StringType())])
PAIRS_SCHEMA = T.StructType([T.StructField("essay_id", T.LongType()),
                             T.StructField("pos", T.IntegerType()),
                             T.StructField("clean_sentence", T.StringType()),
                             T.StructField("dyslexic_sentence", T.StringType()),
                             T.StructField("error_type", T.StringType())])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet); Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transliterate(c: Column) -> Column:
    return F.translate(F.lower(c), TRANSLIT_SRC, TRANSLIT_DST)


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: ``essays(essay_id, text)`` from ``documents`` (transliterated).

    The scan's own splits are the partitions. Benches over one small file, which is one
    split, may name a number of partitions in the setting ``quillscan.input.partitions``.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    partitions = spark.conf.get("quillscan.input.partitions", "")
    if partitions:
        docs = docs.repartition(int(partitions), "doc_id")
    return docs.select(F.col("doc_id").alias("essay_id"), transliterate(F.col("text")).alias("text"))


def read_essays(spark: SparkSession, path: str) -> DataFrame:
    """A2 for an essay table already stored as parquet (explicit schema)."""
    return spark.read.schema(ESSAYS_SCHEMA).parquet(path)


def pairs_from_essays(ess: DataFrame) -> DataFrame:
    """Paired corpus derived by rule from every screening sentence; key ``(essay_id, pos)``."""
    sent = ess.select("essay_id", tx.split_screening("text").alias("s")) \
        .select("essay_id", F.posexplode_outer("s").alias("pos", "clean")).where(F.col("pos").isNotNull())
    k = F.substring(F.md5(F.col("clean")), 1, 1)
    t = F.col("clean")
    swapped = F.concat(F.substring(t, 2, 1), F.substring(t, 1, 1), F.expr("substring(clean, 3)"))
    dys = (F.when(k.isin("0", "1", "2", "3"), F.replace(t, F.lit("්"), F.lit("")))
           .when(k.isin("4", "5", "6", "7"), F.translate(t, PHONETIC_SRC, PHONETIC_DST))
           .when(k.isin("8", "9", "a"), swapped)
           .when(k.isin("b", "c"), F.expr("substring(clean, 1, length(clean) - 1)"))
           .when(k == "d", F.replace(t, F.lit(" "), F.lit("")))
           .otherwise(t))
    etype = (F.when(k.isin("0", "1", "2", "3"), "Spelling")
             .when(k.isin("4", "5", "6", "7"), "phonetic_confusion")
             .when(k.isin("8", "9", "a"), "Visual Scrambling")
             .when(k.isin("b", "c"), "tense_error")
             .when(k == "d", "Spoken_case")
             .when(k == "e", "other"))
    return sent.select("essay_id", "pos", t.alias("clean_sentence"), dys.alias("dyslexic_sentence"),
                       etype.cast("string").alias("error_type"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the paired corpus ``pairs(essay_id, pos, clean_sentence, dyslexic_sentence, error_type)``."""
    return pairs_from_essays(essays(spark, sf_dir))


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1 for a stored paired corpus: fixed schema, no inference."""
    return spark.read.schema(PAIRS_SCHEMA).format(fmt).load(path)
