"""File sources and sinks (operators A3-A6, A8): CSV, JSON lines, Parquet.

Schemas are always declared; nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

V1_SENTENCE_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("char_addition", "char_omission", "char_substitution",
                                              "word_count_diff")]
    + [T.StructField(c, T.BooleanType()) for c in ("has_addition", "has_omission", "has_substitution",
                                                   "has_spacing_issue", "has_diacritic_loss")]
    + [T.StructField(c, T.StringType()) for c in ("clean_sentence", "dyslexic_sentence", "writing_pattern")])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A5: UTF-8 CSV with a header row, no index column; quotes protect commas/newlines."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A5: read back with an explicit schema (multi-line quoted fields allowed)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
