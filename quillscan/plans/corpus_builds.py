"""I23 / I24 — training-corpus builds as Spark jobs.

Both keep the first row per text in source order (dyslexic rows before clean rows
before the added clean list), so a text present on both sides keeps label 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import corpus as co
from ..operators import windows as win
from . import versions

PAIR_COLUMNS = ["clean_sentence", "dyslexic_sentence", "error_type"]
KEY = ["essay_id", "pos"]
#: Documented parameter: the original draws at most this many normal rows (E5); it bounds
#: the labelled rows of ``pattern_corpus`` and of what is fitted on it.
NORMAL_CAP = 3000


def extra_clean(spark: SparkSession) -> DataFrame:
    rows = [(i, t) for i, t in enumerate(co.EXTRA_CLEAN)]
    return spark.createDataFrame(rows, "idx int, text string")


def binary_corpus(corpora: list[DataFrame], extra: DataFrame | None = None,
                  times: int = co.EXTRA_TIMES) -> DataFrame:
    """G1 + G2 + B3 + D16: ``(text, label)``; dyslexic side 1, clean side and extra list 0."""
    # the first row of a text has its label, and that follows from the side alone
    u = binary_union(corpora, extra, times).where(co.min_length("text", K.MIN_SENTENCE_CHARS))
    first = u.groupBy("text").agg(F.min("side").alias("side"))
    return first.select("text", F.when(F.col("side") == 0, 1).otherwise(0).alias("label"))


def binary_union(corpora: list[DataFrame], extra: DataFrame | None = None, times: int = co.EXTRA_TIMES) -> DataFrame:
    """G1 + G2: ``(text, side)``, side 0 dyslexic, 1 clean, 2 the added clean list."""
    parts = [co.to_labelled(c, "dyslexic_sentence", 0, "side") for c in corpora]
    parts += [co.to_labelled(c, "clean_sentence", 1, "side") for c in corpora]
    if extra is not None:
        parts.append(co.to_labelled(co.augment(extra, times), "text", 2, "side"))
    return co.union_all(parts)


def binary_stage_counts(corpora: list[DataFrame], extra: DataFrame | None = None, times: int = co.EXTRA_TIMES) -> DataFrame:
    """Rows after union, length filter and keep-first, in one pass over the union."""
    return co.stage_counts(binary_union(corpora, extra, times), "text",
                           {"union": F.lit(True), "min_length": co.min_length("text", K.MIN_SENTENCE_CHARS)}, "dedup")


def pattern_corpus(corpora: list[DataFrame], normal_cap: int = NORMAL_CAP,
                   keep_key: bool = False) -> DataFrame:
    """B1 + G1 + D16 + B5 + H57 + B2 + E5 + B8 + B6: ``(dyslexic_sentence, macro_label)``."""
    parts = [co.select_shared(c, PAIR_COLUMNS + KEY).withColumn("_corpus", F.lit(i))
             for i, c in enumerate(corpora)]
    u = co.union_all(parts)
    for c in PAIR_COLUMNS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("string"))
    # rows are sorted by a text's hash first, as texts are often alike in their first letters; whether the
    # text is null is a column of the kept row, for a filter on the key itself would go below the aggregate
    # of the one branch, which would then be computed apart from the other's
    u = u.withColumn("_order", F.struct("_corpus", *KEY)) \
        .withColumns({"_hash": F.xxhash64("dyslexic_sentence"), "_null": F.col("dyslexic_sentence").isNull()})
    dedup = win.keep_first(u.select(*PAIR_COLUMNS, "_order", "_hash", "_null"), ["_hash", "dyslexic_sentence"], ["_order"])
    clean = co.drop_junk(dedup, "dyslexic_sentence")
    labelled = clean.withColumn("macro_label", co.normalize_label(F.col("error_type")))
    key = lambda kind: F.concat_ws(":", F.lit(kind), *[F.col(f"_order.{c}").cast("string")
                                                       for c in ["_corpus", *KEY]]).alias("row_key")
    normal = labelled.select(F.col("clean_sentence").alias("dyslexic_sentence"),
                             F.lit("Normal").alias("macro_label"), key("n")) \
        .where(F.col("dyslexic_sentence").isNotNull() & co.min_length("dyslexic_sentence", 5, strict=True))
    normal = win.cap_class(normal, normal_cap, "dyslexic_sentence", ["row_key"])
    dys = labelled.where((F.col("macro_label") != K.MACRO_DEFAULT) & ~F.col("_null")) \
        .select("dyslexic_sentence", "macro_label", key("d"))
    out = co.union_all([dys, normal])
    return out if keep_key else out.drop("row_key")


def pages_as_pairs(pages: DataFrame) -> DataFrame:
    """Second corpus: raw page HTML, which the junk filter removes, and page titles, most of
    which survive it; both as dyslexic text without a clean side."""
    html = pages.select(F.col("page_id").alias("essay_id"), F.lit(0).alias("pos"), F.col("html").alias("dyslexic_sentence"),
                        F.lit(None).cast("string").alias("error_type"))
    title = pages.select(F.col("page_id").alias("essay_id"), F.lit(1).alias("pos"),
                         F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("dyslexic_sentence"),
                         F.lit("Grammar").alias("error_type"))
    return html.unionByName(title.where("dyslexic_sentence <> ''"))


def cached_dataset(spark: SparkSession, path: str, build) -> DataFrame:
    """A3: read-through Parquet cache of a prepared corpus; what an interrupted write left is no hit."""
    if versions.manifest(spark, path) is None:
        if versions.holds_files(spark, path):
            raise FileExistsError(f"{path} holds files that are no version")
        versions.freeze(build(), path)
    return spark.read.parquet(f"{path}/data")


def snapshot(df: DataFrame, path: str) -> None:
    """A4: freeze a dataset version as columnar files with a manifest (a finished one is never written again)."""
    versions.freeze(df, path)
